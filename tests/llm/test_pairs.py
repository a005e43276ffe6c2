"""Duplicates of lines and documents against brute force, with copies, empty rows and repeated ids."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, exactdedup, jaccard, linededup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def corpus(seed, n=160):
    """Texts with families of near copies at all distances, exact copies, a common passage and odd rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    bases = [[word() for _ in range(r.choice([1, 3, 4, 6, 9, 12, 30, 60, 120, 300]))] for _ in range(12)]
    passage = [word() for _ in range(25)]
    out = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            at = r.randrange(len(w))
            if r.random() < 0.5:
                w[at] = word()
            elif len(w) > 1:
                w.pop(at)
        if r.random() < 0.3:
            w = w + passage
        t = " ".join(w) if r.random() < 0.8 else "\n".join(w).upper()
        out.append((i, t))
    return [*out, (n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "É É É É É"), (n + 4, "é é é é é"), (n + 5, out[3][1]), (n + 6, "long " * 30_000)]


def shingles(text, width=4):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def plain_classes(docs, width=4, percent=85):
    sets, s = {i: shingles(t, width) for i, t in docs}, Sets()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                s.join(a, b)
    return {i: (len(sets[i]), s.find(i)) for i in sets}


@pytest.mark.parametrize("seed,limits", [(1, {}), (2, {"limit": 4, "block": 3}), (3, {"limit": 3, "deepest": 0, "block": 2})])
def test_components_of_jaccard_links(spark, seed, limits):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, cid long, key string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(df, **limits).collect()}
    assert got == plain_classes(docs)


@pytest.mark.parametrize("cheaper", [True, False])
def test_regions_cut_or_in_blocks(spark, monkeypatch, cheaper):
    """The result is the same whether large regions are all cut or all joined in blocks."""
    monkeypatch.setattr(jaccard, "_worth", lambda stage, large, every, block: large.select("key").distinct().withColumn("cheaper", F.lit(cheaper)))
    docs = corpus(2)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(df, limit=3, block=2).collect()}
    assert got == plain_classes(docs)


def test_partners_share_a_region():
    """The promise that the whole join rests on, for sets at the very edge of the threshold."""
    import numpy as np

    r, plan = random.Random(5), jaccard.Plan()
    for _ in range(300):
        n = r.randint(6, 400)
        x = {r.getrandbits(64) for _ in range(n)}
        y, k = set(x), plan.errors(n)
        for _ in range(r.randint(0, k)):
            if r.random() < 0.5 and y & x:
                y.discard(r.choice(sorted(y)))
            else:
                y.add(r.getrandbits(64))
        if not y or x == y or 100 * len(x & y) < 85 * len(x | y):
            continue
        (a, more_a), (b, more_b) = jaccard._region_keys([np.array(sorted(s), np.uint64) for s in (x, y)], plan)
        assert set(a) & set(b)
        assert len((set(a) | set(more_a)) & (set(b) | set(more_b))) >= 2


def test_stars_of_short_texts(spark):
    """Variants link with their base only, and share so few regions with it that a large region can't be cut for long."""
    r = random.Random(13)
    docs = []
    for n in (9, 10, 11, 12, 13, 24):
        base = [f"w{r.getrandbits(40)}" for _ in range(n)]
        docs += [" ".join(base)] + [" ".join([*base, f"v{r.getrandbits(40)}"]) for _ in range(60)]
    r.shuffle(docs)
    docs = list(enumerate(docs))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string"), limit=4, deepest=2, block=16).collect()}
    assert got == plain_classes(docs)


def test_sketches_bound_the_difference():
    import numpy as np

    r, gaps = random.Random(17), []
    for n in (1, 5, 40, 400, 3000, 60_000):
        x = {r.getrandbits(64) for _ in range(n)}
        y = set(list(x)[: n * 8 // 10]) | {r.getrandbits(64) for _ in range(n // 10 + 1)}
        a, b = jaccard._folded([jaccard._sketch(np.array(sorted(s), np.uint64)) for s in (x, y)])
        gaps.append((int(np.bitwise_count(a ^ b).sum()), len(x ^ y)))
    assert all(gap <= d for gap, d in gaps) and all(gap >= 0.8 * d for gap, d in gaps[:4])


def test_families_just_below_the_threshold_give_few_pairs(spark):
    """Texts of one base that all lie at 78 to 83 % of each other: no links, and no list of all pairs either."""
    import glob
    import os

    import pyarrow.parquet as pq

    r = random.Random(31)
    word = lambda: f"w{r.getrandbits(30)}"
    base, docs = [word() for _ in range(404)], []
    for i in range(120):
        w = list(base)
        for at in r.sample(range(0, 400, 4), 11):
            w[at] = word()
        docs.append((i, " ".join(w)))
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in plain_classes(docs).items()}
    root = "/" + common.shared_dir(spark).removeprefix("file:").lstrip("/")
    folder = max(glob.glob(f"{root}/tidemark-jaccard-*"), key=os.path.getmtime)
    pairs = sum(pq.read_metadata(f).num_rows for f in glob.glob(f"{folder}/*-pairs/*.parquet"))
    assert pairs < 5 * len(docs)


def test_regions_are_gathered_in_passes(spark):
    """No one table holds most of the regions, each region is whole in one, and what is left is that of one pass."""
    import glob
    import os

    import pyarrow.parquet as pq

    docs = corpus(4)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept, common.Stage.drop = common.Stage.drop, lambda self, df: None
    try:
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_classes(df).collect()}
    finally:
        common.Stage.drop = kept
    assert got == plain_classes(docs)
    root = "/" + common.shared_dir(spark).removeprefix("file:").lstrip("/")
    folder = max(glob.glob(f"{root}/tidemark-jaccard-*"), key=os.path.getmtime)
    keys = [{k for f in glob.glob(f"{d}/*.parquet") for k in pq.read_table(f, columns=["key"])["key"].to_pylist()} for d in glob.glob(f"{folder}/*-shared")]
    assert len(keys) == jaccard.PASSES and all(keys)
    assert sum(map(len, keys)) == len(set().union(*keys)) and max(map(len, keys)) < 0.5 * sum(map(len, keys))


def test_no_more_on_disk_than_a_step_needs(spark, monkeypatch):
    """Regions' keys are gone before the sets are made, sets are shuffled once to be told apart, and pairs are checked in passes that share no centre."""
    import os

    import pyarrow.parquet as pq

    docs, kept, there, plans, links = corpus(6), common.Stage.write, [], [], []

    def write(self, df, name="t"):
        if name == "sets":
            there.extend(p.split("-", 1)[1] for p in os.listdir(self.root.removeprefix("file:")))
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = kept(self, df, name)
        if name == "fans":
            links.append(set(pq.read_table(out._staged_path.removeprefix("file:"))["a"].to_pylist()))
        return out

    monkeypatch.setattr(common.Stage, "write", write)
    monkeypatch.setattr(jaccard, "CHECKED", 20)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == plain_classes(docs)
    assert "wanted" in there and "signatures" not in there
    assert plans[0].count("Exchange hashpartitioning") == 2
    assert links[0] and links[1] and not links[0] & links[1]


def test_written_tables_go_to_workers_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield batch.from_pydict({"rows": [batch.num_rows]})

    before = spark.conf.get(common._BATCH)
    got = common.Stage(spark, "batches").write(spark.range(0, 9000, 1, 2).mapInArrow(sizes, "rows long")).collect()
    assert sum(x.rows for x in got) == 9000 and max(x.rows for x in got) <= common.ROWS
    assert spark.conf.get(common._BATCH) == before


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = jaccard.jaccard_classes(spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "z"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or -1) for r in got) == [(False, 4, 1, 4), (False, 4, 2, 4), (True, 0, 0, -1), (True, 0, 2, 4)]


def test_exact_copies(spark):
    docs = [*corpus(7), (3, "again"), (3, "again"), (None, "AGAIN"), (None, None)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, kept int")
    carry = {"text_sha256": F.sha2(exactdedup.normalised(F.col("text")), 256)}
    got = exactdedup.exact_dedup(df, carry=carry, prefix=5).collect()
    groups = {}
    for i, t in docs:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(-1 if i is None else i, -1 if keep is None else keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted(want)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)
    assert exactdedup.exact_dedup(df.limit(0)).collect() == []


def test_lines(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    bases = [" ".join(word() for _ in range(r.choice([1, 4, 12, 30]))) for _ in range(25)]

    def line():
        t = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2])):
            t[r.randrange(len(t))] = "q"
        return r.choice(["", " "]) + "".join(t)

    docs = [(i, "\n".join(line() for _ in range(r.randint(0, 6)))) for i in range(60)] + [(90, None), (91, "\n \n"), (92, "a\nA\nb")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, line_no string")
    got = {(x.doc_id, x.line_no): x for x in linededup.line_classes(df).collect()}
    lines = [((i, k), x.strip(" ").lower()) for i, t in docs for k, x in enumerate((t or "").split("\n")) if x.strip(" ")]
    grams = lambda t: {t.encode()[i : i + 8] for i in range(max(1, len(t.encode()) - 7))}
    s = Sets()
    for n, (a, x) in enumerate(lines):
        for b, y in lines[:n]:
            g, h = grams(x), grams(y)
            if 100 * len(g & h) >= 80 * len(g | h):
                s.join(a, b)
    want = {a: s.find(a) for a, _ in lines}
    assert got.keys() == want.keys()
    # Never a wrong link, and nearly all right ones.
    assert all((x.keep_id, x.keep_line) >= want[a] and want[(x.keep_id, x.keep_line)] == want[a] for a, x in got.items())
    assert sum((x.keep_id, x.keep_line) == want[a] for a, x in got.items()) >= 0.97 * len(want)
    assert all(x.kept == ((x.keep_id, x.keep_line) == a) for a, x in got.items())
    assert linededup.line_classes(df.limit(0)).collect() == []
    out = {x.doc_id: x.text for x in linededup.dedup_lines(df).collect()}
    assert out[92].split("\n")[0] in ("a", "b") and "A" not in out[92]


@pytest.mark.parametrize("native", [True, False])
def test_components(spark, native):
    r = random.Random(4)
    edges = [(r.randrange(90), r.randrange(90)) for _ in range(60)] + [(300 + i, 301 + i) for i in range(30)] + [(500, 500 + i) for i in range(1, 40)]
    s = Sets()
    for a, b in edges:
        s.join(a, b)
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "a long, b long")
    got = {x.node: x.root for x in common.components(df, common.Stage(spark, "test"), native).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: s.find(x) for x in linked}


def test_filter_loses_nothing(spark):
    ids = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    every = spark.range(5000).withColumnRenamed("id", "k")
    kept = {x.k for x in common.keep_likely(every, F.col("k"), common.bounded_filter(ids, "k")).collect()}
    assert set(range(0, 5000, 7)) <= kept and len(kept) < 800
    assert common.bounded_filter(ids, "k").count() <= 256


def test_lines_of_many_families_in_a_bucket(spark):
    """Lines that open alike share their buckets; the near ones among them are found whichever line is a bucket's centre."""
    r = random.Random(3)
    some = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    opening = some(60)
    lines = [t + end for t in [opening + some(20) for _ in range(40)] for end in ("1", "2")]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {x.doc_id: x.keep_id for x in linededup.line_classes(df, rows=1, bands=3).collect()}
    assert got == {i: i // 2 * 2 for i in range(len(lines))}


def test_lines_with_few_blanks(spark):
    """Lines that differ near their only word start, in scripts without blanks as in addresses."""
    r = random.Random(11)
    some = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    han = lambda n: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(n))
    lines = []
    for _ in range(10):
        url, text, name = some(80), han(80), some(90)
        lines += [f"https://{url}", f"http://{url}", f"{han(1)}{text}", f"{han(1)}{text}", f"x{name}", f"y{name}"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {x.doc_id: x.keep_id for x in linededup.line_classes(df).collect()}
    assert got == {i: i // 2 * 2 for i in range(len(lines))}


def test_parity_bounds_the_difference(spark):
    r = random.Random(6)
    sets = [(i, [r.getrandbits(63) - (1 << 62) for _ in range(r.randint(1, 300))]) for i in range(30)]
    sets += [(100 + i, s[: len(s) * 9 // 10 + 1]) for i, s in sets]
    df = spark.createDataFrame(sets, "cid long, s array<bigint>").select("cid", linededup.parities(F.col("s")).alias("p"))
    words = {x.cid: [v & (2**64 - 1) for v in x.p] for x in df.collect()}
    for a, x in sets:
        for b, y in sets:
            assert sum((u ^ v).bit_count() for u, v in zip(words[a], words[b], strict=True)) <= len(set(x) ^ set(y))


def test_sketches_of_lines_are_their_parities(spark):
    r = random.Random(8)
    lines = [(i, "".join(r.choice("abcdé ") for _ in range(r.choice([1, 7, 8, 40, 600])))) for i in range(40)]
    texts = spark.createDataFrame(lines, "cid long, _line string")
    got = {x.cid: (x.n, x.p) for x in linededup._sketches(texts).collect()}
    sets = texts.select("cid", linededup.shingle_set(F.col("_line")).alias("s")).select("cid", F.size("s").alias("n"), linededup.parities(F.col("s")).alias("p"))
    assert got == {x.cid: (x.n, x.p) for x in sets.collect()}


def test_long_lines_just_below_the_threshold_give_few_pairs(spark):
    """Lines of one base at 50 to 75 % of each other share buckets, but their pairs go without a look at the texts."""
    import glob
    import os

    import pyarrow.parquet as pq

    r = random.Random(37)
    some = lambda n: [r.choice("abcdefghijklmnop") for _ in range(n)]
    base, lines = some(900), []
    for _ in range(100):
        t = list(base)
        for at in r.sample(range(0, 900, 10), 14):
            t[at] = "q"
        lines.append("".join(t))
    lines += [lines[0] + "x", lines[1] + "y"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {x.doc_id: x.keep_id for x in linededup.line_classes(df).collect()}
    assert got == {i: i - 100 if i >= 100 else i for i in range(len(lines))}
    root = "/" + common.shared_dir(spark).removeprefix("file:").lstrip("/")
    folder = max(glob.glob(f"{root}/tidemark-lines-*"), key=os.path.getmtime)
    last = max(glob.glob(f"{folder}/*-pairs"))
    assert sum(pq.read_metadata(f).num_rows for f in glob.glob(f"{last}/*.parquet")) < 5 * len(lines)


def test_bands_are_the_least_distinct_hashes_of_their_ranges(spark):
    """Against a plain version: short lines, repeated shingles, ranges that lack hashes; as the method of the step is compiled, it must be small."""
    r = random.Random(31)
    texts = ["a", "ab cd", "x" * 500, "=-" * 200, "the end " * 40, "é" * 9] + ["".join(r.choice("abcdé ") for _ in range(r.choice([9, 20, 40, 90, 400, 3000]))) for _ in range(150)]
    texts += [t[:60] * 8 for t in texts[-40:]]
    df = spark.createDataFrame(list(enumerate(texts)), "_row long, _line string")
    whole = df.select("_row", F.sort_array(F.array_distinct(F.expr("transform(sequence(1, greatest(octet_length(_line) - 7, 1)), i -> hash(substring(cast(_line as binary), i, 8)))"))).alias("x"))
    want = []
    for i, x in ((v._row, v.x) for v in whole.collect()):
        for b in range(10):
            at = sum(h < (1 << 32) * b // 10 - (1 << 31) for h in x)
            want.append((i, b, (x[at:] + x[:3])[:3]))
    want = spark.createDataFrame(want, "_row long, b int, x array<int>").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("b", F.xxhash64("b", "x").alias("h")))).alias("s")).select("_row", "s.h")
    got = {v._row: v.buckets for v in linededup.banded(df).collect()}
    assert got == {v._row: v.h for v in want.collect()}


def test_steps_of_lines_leave_large_methods_to_small_ones(spark, monkeypatch):
    """The JVM compiles no method of over 8,000 bytes; the operator's tables are written with Spark's limit at that, and it is put back."""
    key, seen, write = "spark.sql.codegen.hugeMethodLimit", [], linededup.Stage.write
    before = spark.conf.get(key)
    real = type(spark.range(1).write).parquet

    def parquet(self, *args, **kwargs):
        seen.append(spark.conf.get(key))
        return real(self, *args, **kwargs)

    monkeypatch.setattr(type(spark.range(1).write), "parquet", parquet)
    linededup.line_classes(spark.createDataFrame([(1, "a line\na line")], "doc_id long, text string")).collect()
    assert seen and set(seen) == {"8000"} and spark.conf.get(key) == before


def test_only_texts_of_open_pairs_are_shuffled(spark):
    """Texts of lines that no open pair names aren't asked for."""
    import glob

    import pyarrow.parquet as pq

    stage = common.Stage(spark, "lines")
    texts = spark.createDataFrame([(1, "one line that is here"), (2, "one line that is here!"), (3, "quite another line than those")], "cid long, _line string")
    sketches = linededup._sketches(texts)
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert [tuple(x) for x in linededup._check(stage, pairs, texts, sketches, 80).collect()] == [(1, 2)]
    folder = stage.root.removeprefix("file:")
    assert sum(pq.read_metadata(f).num_rows for f in glob.glob(f"{folder}/*-open/*.parquet")) == 1
