"""Exact Jaccard join of word-shingle sets as a metric-space join.

Texts that are no near copies of each other are all at distance about 1, so pivots drawn from the documents tell
nothing apart and their windows would copy each document to every region. The pivots here are virtual: the shingle
space is cut into g sub-universes, and each content that a document has in one of them is a pivot, whose Voronoi
region holds the documents at projected distance 0 from it.

* Home and windows. Within 15 % of distance two sets differ in at most k = 15 % of their union, so they differ in
  at most k of the g sub-universes. A document is replicated to its k + 1 fullest regions (k by its own size, in one
  global order): two documents within the threshold then share a region. g depends on a band of sizes; a
  document so near the next band that a partner may be there is replicated to that one as well.
* Recursion. A region that holds several classes of documents and more than LIMIT of them is joined
  recursively: with one more region per document, partners share two, so the region is cut by each second one.
  Partners surely share as many regions of a band as it has sub-universes beyond k; a region is cut only while that
  is more than the regions it was cut by, and where the parts cost less than the whole: many parts that hold nearly all of it would
  compare the same pairs again and again. What is not cut, or still is too large after DEEPEST cuts, is joined in blocks.
* Components first. Each class is compared with the centre that it shares most regions with, the links are
  joined into components, and only regions of several components are looked at further, one of those
  that hold the same classes. There each class is compared with its nearest one of another component, and the components
  that then still share a region pair by pair. So a family of near copies costs as much as its size.
* Triangle inequality. A set's sketch has four to eight bits a shingle, each the parity of the shingles that fall on it:
  the distance to the empty set in each of many parts, modulo 2. Two sets differ in as many shingles at least as
  their sketches in bits, so pairs beyond the threshold go without a look at the sets.
Every link is decided on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, bounded_filter, components, filter_size, keep_likely, maybe
from .words import lean, mix, shingles, slices

WIDTH, PERCENT = 4, 85
LIMIT, DEEPEST, BLOCK = 1024, 2, 512
#: The bits of a region's key that hold how many regions of its band partners surely share, up to DEEPEST + 1.
ROOM = 3
#: Bits of the largest sketch; larger sets have one as large, whose bound is weaker.
SKETCH = 1 << 17
#: Bytes of texts whose sets and regions a task makes at once: the arrays on the way are some dozens of times as large.
TEXTS = 1 << 20
#: Bytes of sketches that one step of a task compares.
STEP = 1 << 25
#: Regions are gathered in so many passes, by their keys, and at most as many check pairs: only one pass's rows or sets are shuffled and on disk.
PASSES = 6
#: Pairs that one pass checks, where PASSES allows.
CHECKED = 20_000
#: Centres with more partners than this are dealt to several tasks.
FAN = 256


class Plan:
    """Sizes, bands and sub-universes for a threshold in percent. Sets of up to `alone` shingles link with equal ones only."""

    def __init__(self, percent: int = PERCENT, ratio: float = 1.5, slack: float = 1.2):
        self.percent, self.ratio, self.slack = percent, max(ratio, 100 / percent), slack

    def errors(self, n):
        """The most shingles in which a set of n and another within the threshold can differ."""
        return (100 - self.percent) * (100 * n // self.percent) // 100

    def bands(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least size of each band up to size `most`, its number of sub-universes, and in how many of them partners surely agree."""
        low = [1]
        while low[-1] <= 2 * most:
            low.append(max(low[-1] + 1, int(np.ceil(low[-1] * self.ratio))))
        low = np.array(low)
        k = self.errors(low[1:] - 1)
        g = np.maximum(k + 1, np.ceil(k * self.slack).astype(np.int64) + 1)
        return low[:-1], g, g - k


def _region_keys(sets: list[np.ndarray], plan: Plan) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each set its regions' keys: those of the windows, and DEEPEST more per band for the recursion."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    empty = np.zeros(0, np.int64)
    k = plan.errors(sizes)
    who = np.flatnonzero(k > 0)
    if not len(who):
        return [(empty, empty)] * len(sets)
    low, cuts, agreed = plan.bands(int(sizes.max()))
    band = np.searchsorted(low, sizes[who], "right") - 1
    up = 100 * sizes[who] >= plan.percent * low[band + 1]  # a partner may be in the next band
    doc, band = np.concatenate([who, who[up]]), np.concatenate([band, band[up] + 1])
    order = np.argsort(doc, kind="stable")
    doc, band = doc[order], band[order]
    g = cuts[band]
    base = np.concatenate([[0], np.cumsum(g)])
    flat = np.concatenate([sets[d] for d in doc])
    row = np.repeat(np.arange(len(doc)), sizes[doc])
    slot = base[row] + ((flat >> np.uint64(17)) % g[row].astype(np.uint64)).astype(np.int64)
    m = mix(flat + np.uint64(0x51ED270B))
    full = np.bincount(slot, minlength=base[-1])
    part = lambda x: np.bincount(slot, weights=x.astype(np.float64), minlength=base[-1]).astype(np.uint64)  # noqa: E731  exact: sums stay under 2**53
    total = part(m & np.uint64(0xFFFFFFFF)) + (part(m >> np.uint64(32)) << np.uint64(32))
    owner = np.repeat(np.arange(len(doc)), g)
    place = np.arange(base[-1]) - base[owner]
    key = mix(mix(total + full.astype(np.uint64)) ^ mix((band[owner].astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64))).view(np.int64)
    key = (key & np.int64(~ROOM)) | np.minimum(agreed[band], DEEPEST + 1)[owner]
    best = np.lexsort((place, -full, owner))
    rank = np.arange(base[-1]) - base[owner]  # lexsort keeps each owner's run in place
    want = k[doc][owner]
    key = key[best]
    near, more = rank <= want, (rank > want) & (rank <= want + DEEPEST)
    out: list[tuple[np.ndarray, np.ndarray]] = [(empty, empty)] * len(sets)
    edges = np.searchsorted(doc, np.arange(len(sets) + 1))
    for d in who.tolist():
        a, b = base[edges[d]], base[edges[d + 1]]
        out[d] = (key[a:b][near[a:b]], key[a:b][more[a:b]])
    return out


def _sketch(s: np.ndarray) -> bytes:
    """The parity of the shingles that fall on each bit; bits are a power of two, 64 at least."""
    bits = min(max(64, 4 << (len(s) - 1).bit_length()), SKETCH) if len(s) else 64
    odd = np.bincount(((s >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, the larger ones folded to the size of the least."""
    size = min(map(len, sketches))
    out = np.empty((len(sketches), size), dtype=np.uint8)
    for i, raw in enumerate(sketches):
        row = np.frombuffer(raw, dtype=np.uint8)
        while len(row) > size:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out[i] = row
    return out.view(np.uint64)


def _marks(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the whole set."""
    if not len(s):
        return 0, 0
    return int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))


def _signatures(width: int, plan: Plan):
    schema = pa.schema([("_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("near", pa.list_(pa.int64())), ("more", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for at, count in slices(batch.column(1), TEXTS):
                part = batch.slice(at, count)
                sets = shingles(part.column(1), width)
                keys, marks = _region_keys(sets, plan), [_marks(s) for s in sets]
                listed = lambda j: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x[j]) for x in keys])]).astype(np.int32), np.concatenate([x[j] for x in keys]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), listed(0), listed(1)], schema=schema
                )

    return run, "_id long, n long, h1 long, h2 long, near array<long>, more array<long>"


def _sets(width: int):
    schema = pa.schema([("_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("body", pa.binary()), ("sketch", pa.binary())])

    def run(batches):
        for batch in batches:
            for at, count in slices(batch.column(1), TEXTS):
                part = batch.slice(at, count)
                sets = shingles(part.column(1), width)
                marks = [_marks(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([m[0] for m in marks], pa.int64()),
                        pa.array([m[1] for m in marks], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                        pa.array([_sketch(s) for s in sets], pa.binary()),
                    ],
                    schema=schema,
                )

    return run, "_id long, h1 long, h2 long, n long, body binary, sketch binary"


def _linked(percent: int):
    """Streams rows (a, salt, role, b, body), a centre's own set first: which of its partners are within the threshold."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        centre, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, role, b, body = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
            out_a, out_b = [], []
            for i in range(len(a)):
                s = np.frombuffer(body[i].as_buffer(), dtype=np.uint64)
                if role[i] == 0:
                    centre, own = a[i], s.copy()
                    continue
                if centre != a[i] or not len(s) or not len(own):
                    continue
                small, large = (s, own) if len(s) < len(own) else (own, s)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int(np.count_nonzero(large[at] == small))
                if 100 * both >= percent * (len(s) + len(own) - both):
                    out_a.append(a[i])
                    out_b.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], schema=schema)

    return run, "a long, b long"


def _crossing(plan: Plan, nearest: bool):
    """Streams rows (key, x, y, side, cid, label, n, sketch) sorted by key, x, y: the pairs of different labels that no bound excludes; only each row's nearest if asked so."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    spread = 100 - plan.percent

    def pairs(rows):
        side, cid, label, n = (np.array(x, dtype=np.int64) for x in rows[:4])
        sketch = _folded(rows[4])
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        other, alike = sketch[right], not side.any()
        step = max(1, STEP // max(8 * other.size, 1))
        for at in range(0, len(left), step):
            i = left[at : at + step]
            gap = np.bitwise_count(sketch[i][:, None, :] ^ other[None, :, :]).sum(axis=2, dtype=np.int64)
            both = n[i][:, None] + n[right][None, :]
            # |x - y| <= spread % of the union, and the union is (sum + difference) / 2
            ok = (label[i][:, None] != label[right][None, :]) & (200 * gap <= spread * (both + gap)) & (100 * np.minimum(n[i][:, None], n[right][None, :]) >= plan.percent * np.maximum(n[i][:, None], n[right][None, :]))
            if nearest:
                p = np.flatnonzero(ok.any(axis=1))
                q = np.where(ok[p], gap[p], np.iinfo(np.int64).max).argmin(axis=1) if len(p) else p
            else:
                # A block against itself has each pair twice, two blocks have it once.
                ok &= (cid[i][:, None] < cid[right][None, :]) if alike else (cid[i][:, None] != cid[right][None, :])
                p, q = np.nonzero(ok)
            if len(p):
                yield np.minimum(cid[i][p], cid[right][q]), np.maximum(cid[i][p], cid[right][q])

    def run(batches):
        now, rows, ready = None, [[] for _ in range(5)], []

        def made():
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in ready])) for i in (0, 1)], schema=schema)
            ready.clear()
            return batch

        def closed(rows):
            for found in pairs(rows) if len(rows[0]) > 1 else ():
                ready.append(found)
                if len(found[0]) > 100_000 or len(ready) > 500:
                    yield made()

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(8)]
            for key, x, y, *rest in zip(*cols, strict=True):
                if (key, x, y) != now:
                    yield from closed(rows)
                    now, rows = (key, x, y), [[] for _ in range(5)]
                for to, v in zip(rows, rest, strict=True):
                    to.append(v)
        yield from closed(rows)
        if ready:
            yield made()

    return run, "a long, b long"


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, limit: int = LIMIT, deepest: int = DEEPEST, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (the least id reachable by links, its own included).

    Words are runs of bytes other than space and 9 to 13, A-Z lower-cased; a set holds the distinct runs of `width` words,
    of a shorter text all its words as one. Two rows link when 100 * intersection >= percent * union. A null or wordless text
    has an empty set and links with nothing. Repeated ids are rows of their own; a null id never names a component while
    another is there. Ties can't occur: the least id decides. Texts of any length are taken whole. Other columns are left out,
    whatever their names. An empty table gives an empty one.
    """
    spark, plan = docs.sparkSession, Plan(percent)
    stage = Stage(spark, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    run, schema = _signatures(width, plan)
    sig = stage.write(rows.mapInArrow(lean(run), schema).withColumn("_row", F.monotonically_increasing_id()), "signatures")
    # Equal sets are one class, which goes by the number of its first row; what follows sees those rows only.
    classes = stage.write(sig.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("_row").alias("cid"), F.min("_id").alias("rep"), F.count("*").alias("copies")), "classes")
    ids = stage.write(sig.drop("near", "more"), "ids")
    firsts = _firsts(stage, sig.where("n > 0"), classes)
    region = Window.partitionBy("key")
    spread = firsts.select(F.col("_row").alias("cid"), F.explode("near").alias("key"))
    parts = [spread.where(F.pmod(F.shiftright("key", 8), F.lit(PASSES)) == i) for i in range(PASSES)]
    gathered = [x.withColumn("centre", F.min("cid").over(region)).withColumn("_last", F.max("cid").over(region)).withColumn("m", F.count("*").over(region)).where("centre <> _last").drop("_last") for x in parts]
    shared = stage.write_parts(gathered, "shared")
    every = _crowded(stage, sig, shared, limit)
    stage.drop(sig)
    sets = _bodies(stage, rows, classes, shared, width)

    # First round: the centre that a class shares most regions with.
    often = shared.where("cid <> centre").repartition("cid").groupBy("cid", "centre").agg(F.count("*").alias("times"))
    pairs = often.groupBy("cid").agg(F.max_by("centre", F.struct("times", -F.col("centre"))).alias("a")).select("a", F.col("cid").alias("b"))
    links = stage.write(_check(stage, pairs, sets, percent), "links")
    labels = stage.write(components(links, stage), "labels")
    mixed = _mixed(stage, shared.select("key", "cid"), labels)
    # Second round: the nearest class of another component; third round: all that are left.
    refuted = None
    for nearest in (True, False):
        pairs = stage.write(_pairs(stage, mixed, every, sets, plan, limit, deepest, block, nearest), "pairs")
        if refuted is not None:
            pairs = stage.write(pairs.join(refuted, ["a", "b"], "left_anti"), "pairs")
        more = stage.write(_check(stage, pairs, sets, percent), "links")
        links, refuted = links.union(more), pairs
        if nearest:
            labels = stage.write(components(links, stage), "labels")
            mixed = _mixed(stage, mixed.select("key", "cid"), labels)
    for done in (shared, every, sets, mixed):
        stage.drop(done)
    roots = stage.write(components(links, stage).withColumnRenamed("node", "cid"), "roots")
    named = classes.select("cid", "h1", "h2", "n", "rep").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = stage.write(named.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    named = stage.write(named.join(least, "root").select("h1", "h2", "n", "component_id"), "named")
    full = ids.where("n > 0").select("_id", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left")
    out = full.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return out.union(ids.where("n = 0").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("_id").alias("component_id")))


def _firsts(stage, sig, classes):
    """The rows of sig that stand for a class. Only rows of classes that may have copies are shuffled."""
    copied = classes.where("copies > 1").select("h1")
    size = filter_size(copied.count())
    marked = maybe(sig, F.col("h1"), stage.write(bounded_filter(copied, "h1", size), "bits"), size)
    doubt = marked.where("_maybe").join(classes.select("cid"), F.col("_row") == F.col("cid"), "left_semi")
    return marked.where("not _maybe").select("_row", "near").union(doubt.select("_row", "near"))


def _crowded(stage, sig, shared, limit):
    """All regions (cid, all) of the classes in a region of more than `limit`, of a few others too: only such are cut. sig isn't shuffled."""
    crowd = stage.write(shared.where(f"m > {limit}").select("cid").distinct(), "crowd")
    size = filter_size(crowd.count())
    bits = stage.write(bounded_filter(crowd, "cid", size), "bits")
    return stage.write(keep_likely(sig.select(F.col("_row").alias("cid"), F.concat("near", "more").alias("all")), F.col("cid"), bits, size), "every")


def _bodies(stage, rows, classes, shared, width):
    """Sets and sketches of all classes that share a region: (cid, n, body, sketch)."""
    active = shared.select("cid").distinct()
    wanted = stage.write(classes.select("cid", "rep", "h1", "h2", "n").join(active, "cid", "left_semi"), "wanted")
    size = filter_size(wanted.count())
    bits = stage.write(bounded_filter(wanted, "rep", size), "bits")
    run, schema = _sets(width)
    # Of a class's copies the one whose id names it; where that id repeats, any of them, for the join's own keys.
    made = keep_likely(rows, F.col("_id"), bits, size).mapInArrow(lean(run), schema)
    # Spelled so that it is no key of the join: by the same keys as the rows are told apart they are shuffled once.
    made = made.join(wanted, ["h1", "h2", "n"]).where("coalesce(_id = rep, _id is null and rep is null)").dropDuplicates(["h1", "h2", "n"])
    return stage.write(made.select("cid", "n", "body", "sketch"), "sets")


def _check(stage, pairs, sets, percent):
    """The pairs (a, b) that are links. In passes by their centres; only the sets that a pass needs are shuffled."""
    pairs = stage.write(pairs, "pairs")
    count = min(PASSES, pairs.count() // CHECKED + 1)
    found = [_part(stage, pairs.where(F.pmod(F.xxhash64("a", F.lit(1)), F.lit(count)) == i), sets, percent) for i in range(count)]
    return stage.write_parts(found, "links") if count > 1 else found[0]


def _part(stage, pairs, sets, percent):
    """The links among pairs. Each centre's set is read once for up to FAN partners."""
    fans = stage.write(pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fan")), "fans")
    named = stage.write(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "named")
    size = filter_size(named.count())
    bodies = keep_likely(sets.select("cid", "body"), F.col("cid"), stage.write(bounded_filter(named, "cid", size), "bits"), size)
    partners = pairs.join(fans, "a").select("a", F.pmod(F.xxhash64("b"), F.col("fan")).cast("int").alias("salt"), "b")
    partners = partners.join(bodies.withColumnRenamed("cid", "b"), "b").select("a", "salt", F.lit(1).alias("role"), "b", "body")
    centres = fans.join(bodies.withColumnRenamed("cid", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("b"), "body")
    run, schema = _linked(percent)
    return partners.union(centres).repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(lean(run), schema)


def _several(rows):
    """Regions (key, m) of rows (key, cid, label) that hold several labels: of those with the same classes one, which can be cut furthest."""
    held = rows.groupBy("key").agg(F.min("label").alias("u"), F.max("label").alias("v"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("cid")).alias("f"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("g"))
    return held.where("u <> v").groupBy("m", "f", "g").agg(F.max_by("key", F.struct(F.col("key").bitwiseAND(F.lit(ROOM)), "key")).alias("key")).select("key", "m")


def _mixed(stage, regions, labels):
    """Rows (key, cid, label, m) of the regions that hold more than one label."""
    rows = stage.write(regions.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", F.coalesce("root", "cid").alias("label")), "labelled")
    several = stage.write(_several(rows), "several")
    return stage.write(rows.join(several, "key").select("key", "cid", "label", "m"), "mixed")


def _worth(stage, large, every, block):
    """The large regions (key, cheaper) that are cut, since their parts together cost less than their blocks do; a row that is moved counts like the `block` comparisons it serves."""
    parts = large.join(every, "cid").select("key", "m", "path", "label", F.explode("all").alias("next")).where("not array_contains(path, next)")
    parts = parts.groupBy("key", "m", "next").agg(F.min("label").alias("u"), F.max("label").alias("v"), F.count("*").alias("n")).where("u <> v")
    cost = parts.groupBy("key").agg(F.first("m").alias("m"), F.sum(F.col("n") * (F.col("n") + block)).alias("cost"))
    return stage.write(cost.where(F.col("cost") < F.col("m") * (F.col("m") + block * F.ceil(F.col("m") / block))).select("key", F.lit(True).alias("cheaper")), "worth")


def _pairs(stage, mixed, every, sets, plan, limit, deepest, block, nearest):
    """Pairs of different labels in mixed regions that no bound excludes; large regions are cut by further pivots first."""
    done, mixed = [], mixed.withColumn("path", F.array("key"))
    for level in range(deepest + 1):
        done.append(mixed.where(f"m <= {limit}").select("key", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), "cid", "label"))
        large = mixed.where(f"m > {limit}")
        if large.isEmpty():
            break
        # Partners in a region share another one only if its band, or that of a region it was cut by, has room for it.
        room = F.array_max(F.transform("path", lambda r: r.bitwiseAND(F.lit(ROOM))))
        large = large.join(_worth(stage, large.where(room > level + 1), every, block), "key", "left") if level < deepest else large.withColumn("cheaper", F.lit(False))
        large = large.withColumn("cheaper", F.coalesce("cheaper", F.lit(False)))
        count = F.ceil(F.col("m") / block).cast("int")
        own = F.pmod(F.xxhash64("cid"), count).cast("int")
        dealt = large.where("not cheaper").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
        done.append(dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"), "cid", "label"))
        if level == deepest:
            break
        cut = large.where("cheaper").join(every, "cid").select("path", "cid", "label", F.explode("all").alias("next")).where("not array_contains(path, next)")
        cut = cut.select(F.array_sort(F.array_append("path", F.col("next"))).alias("path"), "cid", "label").withColumn("key", F.xxhash64("path")).distinct()
        cut = stage.write(cut, "cut")
        several = stage.write(_several(cut), "several")
        mixed = stage.write(cut.join(several, "key"), "mixed")
    rows = done[0]
    for more in done[1:]:
        rows = rows.union(more)
    rows = rows.join(sets.select("cid", "n", "sketch"), "cid").select("key", "x", "y", "side", "cid", "label", "n", "sketch")
    run, schema = _crossing(plan, nearest)
    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(lean(run), schema).distinct()
