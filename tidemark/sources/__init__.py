"""Readers and parsers of transcripts, documents and pages."""
