"""What leaves the engine: notes, JSON rows, snapshots, upserted tables."""
