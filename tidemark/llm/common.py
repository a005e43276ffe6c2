"""What the corpus operators share: staged tables, a bounded id filter, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Least and most bits of an id filter: 1 MB to 16 MB in rows of 4 KB, whatever the input.
FILTER_BITS, FILTER_MOST = 1 << 23, 1 << 27
_ROW_BITS = 32768
#: Frees the shuffle files of a table once it is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to a Python worker at once: whole texts and sets among them, so fewer than the 10,000 that are usual.
_BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
#: Methods of whole-stage code above so many bytes, which a JVM doesn't compile, give way to code in small methods; Spark's own limit is 65,535.
_METHOD, BYTES = "spark.sql.codegen.hugeMethodLimit", 8000
#: Edges that one task of the union-find takes.
EDGES = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that only Spark need be able to read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own if there is one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows that go to a Python worker at once to ROWS, from now on in this session: for tables that are returned unwritten, whose
    reader's setting it is that counts. A smaller bound stays, and no result depends on it."""
    if not 0 < int(spark.conf.get(_BATCH)) <= ROWS:
        spark.conf.set(_BATCH, str(ROWS))


class Stage:
    """Tables written under the shared folder, so that lineage ends there and a lost executor costs no more than its tasks."""

    def __init__(self, spark: SparkSession, label: str, small_methods: bool = False):
        self.spark = spark
        self.small_methods = small_methods
        self.root = f"{shared_dir(spark).rstrip('/')}/tidemark-{label}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        before = {k: self.spark.conf.get(k) for k in (_CLEANUP, _BATCH, _METHOD)}
        self.spark.conf.set(_CLEANUP, "true")
        small_batches(self.spark)
        if self.small_methods:
            self.spark.conf.set(_METHOD, str(BYTES))
        try:
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        # The schema is known, so that an empty table reads back as well.
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path
        return out

    def write_parts(self, parts: list[DataFrame], name: str = "t") -> DataFrame:
        """One table of several of the same schema, written one after the other: only one's shuffle files are there at a time."""
        held = [self.write(part, name) for part in parts]
        out = self.spark.read.schema(parts[0].schema).parquet(*[x._staged_path for x in held])
        out._staged_parts = held
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that no later plan reads."""
        for part in getattr(df, "_staged_parts", []):
            self.drop(part)
        if not hasattr(df, "_staged_path"):
            return
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def filter_size(ids: int) -> int:
    """Bits for so many ids: eight or more each, up to the most; beyond that more rows pass in vain, and none is lost."""
    return min(max(FILTER_BITS, 1 << (8 * ids - 1).bit_length()), FILTER_MOST) if ids else FILTER_BITS


def bounded_filter(ids: DataFrame, column: str, size: int = FILTER_BITS) -> DataFrame:
    """At most size / 32768 rows (bucket, bits): a bit for each hash of an id."""
    slot = F.pmod(F.xxhash64(F.col(column)), F.lit(size))
    return (
        ids.select(slot.alias("slot"))
        .groupBy((F.col("slot") / _ROW_BITS).cast("int").alias("_tm_bucket"))
        .agg(F.expr(f"bitmap_construct_agg(slot % {_ROW_BITS})").alias("_tm_bits"))
    )


def keep_likely(df: DataFrame, key, bits: DataFrame, size: int = FILTER_BITS) -> DataFrame:
    """df's rows whose key may be among the ids of the filter: none of those is lost, a few others may stay. No shuffle of df."""
    return maybe(df, key, bits, size).where("_maybe").drop("_maybe")


def maybe(df: DataFrame, key, bits: DataFrame, size: int = FILTER_BITS) -> DataFrame:
    """df with a column _maybe: false only where key isn't among the filter's ids. Columns of callers must not be named so, nor begin with _tm_."""
    slot = F.pmod(F.xxhash64(key), F.lit(size))
    byte = F.expr(f"conv(hex(substring(_tm_bits, cast((_tm_slot % {_ROW_BITS}) div 8 as int) + 1, 1)), 16, 10)").cast("int")
    hit = F.getbit(byte, (F.col("_tm_slot") % 8).cast("int")) == 1
    return (
        df.withColumn("_tm_slot", slot)
        .withColumn("_tm_bucket", (F.col("_tm_slot") / _ROW_BITS).cast("int"))
        .join(F.broadcast(bits), "_tm_bucket", "left")
        .withColumn("_maybe", F.coalesce(hit, F.lit(False)))
        .drop("_tm_slot", "_tm_bucket", "_tm_bits")
    )


def _united(batches):
    """Rows (node, root) of all edges of one task, by union-find."""
    import pyarrow as pa

    up: dict = {}

    def find(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([find(x) for x in nodes])], names=["node", "root"])


def components(edges: DataFrame, stage: Stage, native: bool = False) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root being the least node reachable.

    Up to EDGES edges are united in one task, unless the way of column expressions is asked for; more go through rounds.

    Alternating stars (large: each larger neighbour goes to the least one; small: each smaller one too),
    every round from one written table to the next. The node that ends as a hub of many edges is met by joins
    between written tables, whose large partitions Spark splits, and by aggregates that sum up before a shuffle.
    Nodes may be of any orderable type. Null ends and loops are ignored.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, mark = stage.write(pairs.distinct(), "edges"), None
    # As many tasks as there are edges for; where that is one, no partition is large enough to need splitting.
    many = now.count()
    if many <= EDGES and not native:
        kind = dict(now.dtypes)["a"]
        return now.coalesce(1).mapInArrow(_united, f"node {kind}, root {kind}")
    tasks = many // EDGES + 1
    settle = (lambda df, name: stage.write(df.coalesce(tasks), name)) if tasks > 1 else (lambda df, name: df.coalesce(1))
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stage.write(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).coalesce(tasks), "large")
        least2 = settle(large.groupBy("a").agg(F.min("b").alias("m")), "least2")
        ends = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        small = stage.write(large.join(least2, "a").select(ends).select("e.a", "e.b").where("a <> b").distinct().coalesce(tasks), "small")
        seen = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for old in (now, least, large, least2):
            if hasattr(old, "_staged_path"):
                stage.drop(old)
        now = small
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = tuple(seen)
