"""Fuzzy duplicate lines by MinHash, in DataFrame operations only.

Lines are compared trimmed and lower-cased. Equal lines become one by a 128-bit hash. Of the others' character 8-shingles
(on UTF-8 bytes) the hashes are dealt to BANDS ranges of equal size, and the ROWS least hashes of a range make a band; lines that
agree in a band are compared. A range with fewer hashes goes on into the next one, behind its border. Whether two lines are near
copies is decided by the exact Jaccard similarity of the same shingles, at least 80 %. Links are joined by a distributed
union-find, and one line of each component stays: the first by document and place.

Each line is first compared with the least line of the buckets that it shares most often; where lines of different components are
left in a bucket, with a centre drawn there by hash, so that a family of copies costs as much as its size. What then still has
different components in a bucket is compared pair by pair, in blocks of BLOCK lines, so any two lines that share a bucket are compared
or in one component. Of buckets that hold the same lines one is looked at. PARITY words of 64 bits each tell beforehand which
pairs can't be near: a bit is the parity of the shingles that fall on it, so the bits in which two lines differ are no more than the
shingles in which they do. A line's bands are made in the row it stands in, so no signature is shuffled; a text is, once, only where
its line shares a bucket. A family of copies shares BANDS buckets, so its rows are dealt to as many tasks; other
rows of a text or component meet in aggregates and in joins of written tables, which Spark can split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, bounded_filter, components, filter_size, keep_likely, maybe

ROWS, BANDS = 3, 10
SHINGLE, PERCENT = 8, 80
CENTRES, BLOCK = 2, 512
#: Words of the parities, a power of two.
PARITY = 16
#: Shingles that go into the parities at once.
FOLD = 4
#: Lines whose sets one task makes.
LINES = 4096
#: Buckets are gathered in so many passes, by their bands: their rows are the most that is shuffled, and only one pass's are on disk.
PASSES = 3


def normalised(line: Column) -> Column:
    return F.lower(F.trim(line))


def shingles(line: Column, width: int = SHINGLE) -> Column:
    """The character shingles of a line, on its UTF-8 bytes, repeated ones too; a shorter line is one shingle."""
    last = F.greatest(F.octet_length(line) - width + 1, F.lit(1))
    # The outer array of one makes the bytes a value that the inner function takes as it is; otherwise each step would encode the line anew.
    made = F.transform(F.array(line.cast("binary")), lambda raw: F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.substring(raw, i, F.lit(width)))))
    return F.get(made, F.lit(0))


def shingle_set(line: Column, width: int = SHINGLE) -> Column:
    """The distinct ones of a line's shingles."""
    return F.array_distinct(shingles(line, width))


def banded(lines: DataFrame, rows: int = ROWS, bands: int = BANDS, width: int = SHINGLE) -> DataFrame:
    """lines with their buckets in place of _line: for each range of hashes a hash of the least distinct ones from its border on.

    In steps, each a plain expression of columns that the step before made, so that all but the hashing is compiled. The hashes are sorted
    once, borders among them, and repeated ones are told apart only behind each border, and in the whole line where a range lacks some.
    """
    rest = [c for c in lines.columns if c != "_line"]
    borders = [F.lit((1 << 32) * b // bands - (1 << 31)).cast("int") for b in range(bands)]
    line = F.col("_line")
    last = F.greatest(F.octet_length(line) - width + 1, F.lit(1))
    made = F.transform(F.array(line.cast("binary")), lambda raw: F.transform(F.sequence(F.lit(1), last), lambda i: F.hash(F.substring(raw, i, F.lit(width)))))
    lines = lines.select(*rest, F.sort_array(F.concat(F.get(made, F.lit(0)), F.array(*borders))).alias("_y"))
    lines = lines.select(*rest, "_y", *[F.array_position("_y", border).cast("int").alias(f"_at{b}") for b, border in enumerate(borders)])
    ends = [F.col(f"_at{b + 1}") for b in range(bands - 1)] + [F.size("_y") + 1]
    # A hash that is a border itself stands behind it and is left out here as below.
    near = [F.slice("_y", F.col(f"_at{b}") + 1, F.least(F.lit(2 * rows), end - F.col(f"_at{b}") - 1)) for b, end in enumerate(ends)]
    lines = lines.select(*rest, "_y", *[F.array_distinct(x).alias(f"_x{b}") for b, x in enumerate(near)])
    full = [(F.size(f"_x{b}") >= rows) & (F.get(f"_x{b}", F.lit(0)) > border) for b, border in enumerate(borders)]
    lines = lines.select(*rest, "_y", *[f"_x{b}" for b in range(bands)], reduce(lambda x, y: x & y, full).alias("_full"))
    # In a line with too few in some range, all distinct hashes without the borders; behind the last one it goes on from the first.
    lines = lines.select(*rest, *[f"_x{b}" for b in range(bands)], "_full", F.when(~F.col("_full"), F.array_distinct("_y")).alias("_y"), F.when(~F.col("_full"), F.array_except("_y", F.array(*borders))).alias("_x"))
    lines = lines.withColumn("_x", F.concat("_x", F.slice("_x", 1, rows)))
    least = [F.when(F.col("_full"), F.slice(f"_x{b}", 1, rows)).otherwise(F.slice("_x", F.greatest(F.array_position("_y", border) - b, F.lit(1)).cast("int"), rows)) for b, border in enumerate(borders)]
    return lines.select(*rest, F.array(*[F.xxhash64(F.lit(b), x) for b, x in enumerate(least)]).alias("buckets"))


def _parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows _id, line_no (from 0), _raw of all lines that hold more than blanks, as they are."""
    # Cut at blanks' runs only when compared: the line itself is kept as it is.
    parts = docs.select(F.col(id_col).alias("_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_no", "_raw"))
    return parts.where(F.trim("_raw") != "")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows _id, line_no (from 0), _line (normalised) of all lines that hold more than blanks."""
    return _parts(docs, id_col, text_col).select("_id", "line_no", normalised(F.col("_raw")).alias("_line"))


def _key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2")]


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, bands: int = BANDS, percent: int = PERCENT) -> DataFrame:
    """One row per line that holds more than blanks: id_col, line_no, keep_id, keep_line, kept.

    keep_id and keep_line name the line of its component that stays, the least by (id, line_no), null ids last. Null and empty texts
    have no lines. Repeated rows of docs have the same lines, of which one row stays. Ties can't occur otherwise. Lines of any length
    are taken whole. Other columns are left out, whatever their names. An empty table gives an empty one.
    """
    stage = Stage(docs.sparkSession, "lines", small_methods=True)
    lines = lines_of(docs, id_col, text_col)
    key = _key(F.col("_line"))
    seen = stage.write(banded(lines.select("_id", "line_no", *key, F.monotonically_increasing_id().alias("_row"), "_line"), rows, bands), "seen")
    place = F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("line_no").alias("l"), F.col("_row").alias("r"))
    # Equal lines go by the number of their first row.
    firsts = stage.write(seen.groupBy("h1", "h2").agg(F.min("_row").alias("cid"), F.min(place).alias("first"), F.count("*").alias("copies")), "firsts")
    own = Window.partitionBy("bucket")
    copied = firsts.where("copies > 1").select("h1")
    size = filter_size(copied.count())
    bits = stage.write(bounded_filter(copied, "h1", size), "bits")
    one = stage.write(_first_rows(seen, firsts, bits, size).select(F.col("_row").alias("cid"), *[F.col("buckets")[b].alias(f"_b{b}") for b in range(bands)]), "one")
    # The buckets go; each pass reads its own columns of the table of one row a line.
    whole, seen = seen, stage.write(seen.drop("buckets"), "rows")
    stage.drop(whole)
    parts = []
    for i in range(min(PASSES, bands)):
        spread = one.select("cid", F.explode(F.array(*[f"_b{b}" for b in range(i, bands, PASSES)])).alias("bucket"))
        spread = spread.withColumn("centre", F.min("cid").over(own)).withColumn("_last", F.max("cid").over(own))
        parts.append(spread.where("centre <> _last").drop("_last"))
    shared = stage.write_parts(parts, "shared")
    stage.drop(one)
    texts = _texts(stage, _parts(docs, id_col, text_col), shared, firsts)
    sketches = stage.write(_sketches(texts), "sketches")

    links = None
    often = shared.where("cid <> centre").repartition("cid").groupBy("cid", "centre").agg(F.count("*").alias("times"))
    pairs = often.groupBy("cid").agg(F.max_by("centre", F.struct("times", -F.col("centre"))).alias("a")).select("a", F.col("cid").alias("b"))
    left = shared.select("bucket", "cid")
    for turn in range(CENTRES + 1):
        found = _check(stage, pairs, texts, sketches, percent)
        links = stage.write(found if links is None else links.union(found), "links")
        roots = stage.write(components(links, stage, native=True).withColumnRenamed("node", "cid"), "roots")
        if turn < CENTRES:
            left = _mixed(stage, left, roots)
            pairs = stage.write(_centred(stage, left) if turn + 1 < CENTRES else _crossing(left, sketches, percent), "pairs")
    for done in (shared, texts, sketches, left):
        stage.drop(done)

    named = stage.write(_moved(stage, firsts, roots), "named")
    size = filter_size(named.count())
    marked = maybe(seen, F.col("h1"), stage.write(bounded_filter(named, "h1", size), "bits"), size)
    own_place = F.struct(F.col("_id").alias("i"), F.col("line_no").alias("l"), F.col("_row").alias("r"))
    other = F.when(F.col("keep").isNotNull(), F.struct("keep.i", "keep.l", "keep.r")).otherwise(own_place)
    # Only rows of lines that have copies or links, as the filter tells, are shuffled; any other line stays itself.
    met = marked.where("_maybe").join(named, ["h1", "h2"], "left").select("_id", "line_no", "_row", other.alias("keep"))
    out = marked.where("not _maybe").select("_id", "line_no", "_row", own_place.alias("keep")).union(met)
    return out.select(
        F.col("_id").alias(id_col), F.col("line_no").cast("long").alias("line_no"), F.col("keep.i").alias("keep_id"), F.col("keep.l").cast("long").alias("keep_line"), (F.col("keep.r") == F.col("_row")).alias("kept")
    )


def _moved(stage: Stage, firsts: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (h1, h2, keep) of the lines that have links or copies: the place that stays."""
    size = filter_size(roots.count())
    linked = keep_likely(firsts, F.col("cid"), stage.write(bounded_filter(roots, "cid", size), "bits"), size).join(roots, "cid")
    linked = stage.write(linked.select("h1", "h2", "first", "root"), "linked")
    keep = linked.groupBy("root").agg(F.min("first").alias("keep"))
    copied = firsts.where("copies > 1").join(roots, "cid", "left_anti").select("h1", "h2", F.col("first").alias("keep"))
    return linked.join(keep, "root").select("h1", "h2", "keep").union(copied)


def _first_rows(seen: DataFrame, firsts: DataFrame, bits: DataFrame, size: int) -> DataFrame:
    """The rows of seen that stand for their line. Only rows of lines that may have copies, as the filter tells, are shuffled."""
    marked = maybe(seen.select("_row", "h1", "buckets"), F.col("h1"), bits, size)
    # A line that the filter holds in vain has no copies: its only row is its first.
    leads = keep_likely(firsts, F.col("h1"), bits, size).select("cid")
    doubt = marked.where("_maybe").join(leads, F.col("_row") == F.col("cid"), "left_semi")
    return marked.where("not _maybe").select("_row", "buckets").union(doubt.select("_row", "buckets"))


def _texts(stage: Stage, parts: DataFrame, shared: DataFrame, firsts: DataFrame) -> DataFrame:
    """The lines that share a bucket, each once: cid, _line."""
    active = stage.write(shared.select("cid").distinct().join(firsts.select("cid", "h1", "h2", F.xxhash64("first.i", "first.l").alias("at")), "cid"), "active")
    many = active.count()
    size = filter_size(many)
    # Little data and much work: as many tasks as there are lines for.
    active_tasks = many // LINES + 1
    bits = stage.write(bounded_filter(active, "at", size), "bits")
    wanted = keep_likely(parts.select(F.xxhash64("_id", "line_no").alias("_at"), "_raw"), F.col("_at"), bits, size).select("_at", normalised(F.col("_raw")).alias("_line"))
    # Where ids repeat, a place holds several lines, of which the hashes tell; and equal ones, of which one is enough.
    wanted = wanted.select("_at", "_line", *_key(F.col("_line"))).repartition(active_tasks, "h1", "h2").join(active, ["h1", "h2"]).where("_at = at").dropDuplicates(["h1", "h2"])
    return stage.write(wanted.select("cid", "_line"), "texts")


def _sketches(texts: DataFrame) -> DataFrame:
    """Of each line: cid, n (its shingles), p (their parities). A row for each FOLD shingles, so that the folding is compiled; each line's are summed up in their own task."""
    made = texts.select("cid", shingle_set(F.col("_line")).alias("_s"))
    made = made.select("cid", "_s", F.explode(F.sequence(F.lit(0), F.size("_s") - 1, F.lit(FOLD))).alias("_i"))
    # A shingle's word and bit are made once, for all words' sums; behind the last shingle they are null.
    some = [F.get("_s", F.col("_i") + k) for k in range(FOLD)]
    made = made.select("cid", F.size("_s").alias("_n"), *[_word(x).alias(f"_w{k}") for k, x in enumerate(some)], *[_bit(x).alias(f"_b{k}") for k, x in enumerate(some)])
    flips = lambda j: reduce(lambda x, y: x.bitwiseXOR(y), [F.when(F.col(f"_w{k}") == j, F.col(f"_b{k}")).otherwise(F.lit(0).cast("long")) for k in range(FOLD)])
    made = made.groupBy("cid").agg(F.max("_n").alias("n"), *[F.bit_xor(flips(j)).alias(f"_p{j}") for j in range(PARITY)])
    return made.select("cid", "n", F.array(*[F.col(f"_p{j}") for j in range(PARITY)]).alias("p"))


def _mixed(stage: Stage, left: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (bucket, cid, label, m) of the buckets of several labels, one of those that hold the same lines; m: its lines."""
    labelled = stage.write(left.select("bucket", "cid").join(roots, "cid", "left").select("bucket", "cid", F.coalesce("root", "cid").alias("label")), "labelled")
    held = labelled.groupBy("bucket").agg(F.min("label").alias("u"), F.max("label").alias("v"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("cid")).alias("f"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("g"))
    several = stage.write(held.where("u <> v").groupBy("m", "f", "g").agg(F.min("bucket").alias("bucket")).select("bucket", "m"), "several")
    return stage.write(labelled.join(several, "bucket").select("bucket", "cid", "label", "m"), "mixed")


def _centred(stage: Stage, mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of a centre drawn in each bucket with the bucket's lines of other labels."""
    drawn = stage.write(mixed.groupBy("bucket").agg(F.min_by(F.struct("cid", "label"), F.xxhash64("bucket", "cid")).alias("c")), "drawn")
    return mixed.join(drawn, "bucket").where("label <> c.label").select(F.least("cid", "c.cid").alias("a"), F.greatest("cid", "c.cid").alias("b")).distinct()


def _word(x: Column) -> Column:
    """The word of the parities that a shingle's hash falls on."""
    return F.shiftright(x, 6).bitwiseAND(F.lit(PARITY - 1)).cast("int")


def _bit(x: Column) -> Column:
    """The bit that it flips there."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))


def parities(shingles: Column) -> Column:
    """PARITY words of 64 bits: each bit the parity of the shingles that fall on it."""
    fold = lambda j: F.aggregate(shingles, F.lit(0).cast("long"), lambda seen, x: F.when(_word(x) == j, seen.bitwiseXOR(_bit(x))).otherwise(seen))
    return F.array(*[fold(j) for j in range(PARITY)])


def _may(x: str, y: str, percent: int) -> Column:
    """Whether the sizes and parities of two lines leave it open that they are near."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    gap = sum((F.bit_count(F.col(f"{x}.p")[j].bitwiseXOR(F.col(f"{y}.p")[j])) for j in range(PARITY)), F.lit(0))
    # The difference is at most 100 - percent % of the union, which is (n + m + difference) / 2.
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * gap <= (100 - percent) * (n + m))


def _crossing(mixed: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different labels in a bucket that no bound excludes; n: both sizes' sum."""
    # Each line meets its own block and all others of its bucket, a pair of blocks in one task.
    count = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = mixed.withColumn("own", F.pmod(F.xxhash64("cid"), count).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"), "own", "cid", "label").join(sketches, "cid")
    x, y = dealt.alias("x"), dealt.alias("y")
    met = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("bucket", "s", "t")]
    # A block meets itself with each pair once; two blocks meet as lower and upper.
    once = F.when(F.col("x.s") == F.col("x.t"), F.col("x.cid") < F.col("y.cid")).otherwise(F.col("x.own") < F.col("y.own"))
    may = (F.col("x.label") != F.col("y.label")) & _may("x", "y", percent)
    return x.join(y, [*met, once & may]).select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"), (F.col("x.n") + F.col("y.n")).alias("n")).distinct()


def _tasks(df: DataFrame) -> int:
    """As many tasks as a shuffle has, for steps whose work their bytes don't tell."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _check(stage: Stage, pairs: DataFrame, texts: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose lines are near enough; only those that the bounds leave open meet their texts, and only their texts are shuffled. Pairs with n are held against the bounds already."""
    open_ = pairs
    if "n" not in pairs.columns:
        x, y = sketches.alias("x"), sketches.alias("y")
        open_ = pairs.join(x, F.col("a") == F.col("x.cid")).join(y, (F.col("b") == F.col("y.cid")) & _may("x", "y", percent))
        open_ = stage.write(open_.select("a", "b", (F.col("x.n") + F.col("y.n")).alias("n")), "open")
    size = filter_size(2 * open_.count())
    bits = stage.write(bounded_filter(open_.select(F.explode(F.array("a", "b")).alias("cid")), "cid", size), "bits")
    texts = keep_likely(texts, F.col("cid"), bits, size)
    first, second = texts.select(F.col("cid").alias("a"), F.col("_line").alias("x")), texts.select(F.col("cid").alias("b"), F.col("_line").alias("y"))
    both = open_.join(first, "a").join(second, "b").repartition(_tasks(pairs))
    # The intersection's shingles are distinct ones.
    both = both.select("a", "b", "n", F.size(F.array_intersect(shingles(F.col("x")), shingles(F.col("y")))).alias("i"))
    return both.where(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and text of docs without the lines that don't stay; lines of blanks only stay, and a null text stays null.

    Of rows that repeat an id, null ids included, all lose the lines that any of them loses at that place.
    """
    gone = line_classes(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("_id"), "line_no")
    by_doc = gone.groupBy("_id").agg(F.collect_set("line_no").alias("_gone"))
    rows = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text")).join(by_doc, F.col("_own").eqNullSafe(F.col("_id")), "left")
    parts = F.split("_text", "\n")
    kept = F.filter(parts, lambda x, i: F.col("_gone").isNull() | ~F.array_contains(F.col("_gone"), i.cast("long")))
    return rows.select(F.col("_own").alias(id_col), F.array_join(kept, "\n").alias(text_col))
