import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.functions import project, text
from tidemark.operators import graph, mining, search, temporal, usage
from tidemark.operators import relational as rel


def one(df):
    return df.first()[0]


def tokens(**n):
    return {c: F.lit(n.get(c, 0)) for c in (*usage.CLASSES, "write_flat")}



def cost(spark, rates, above=None, threshold=0, **n):
    r = dict(zip(usage.CLASSES, [F.lit(x / 1e6) for x in rates], strict=True))
    a = {k: F.lit(v) for k, v in (above or {}).items()}
    return one(spark.range(1).select(usage.price(tokens(**n), r, a, F.lit(threshold))))


def test_price_by_tier(spark):
    assert cost(spark, (3, 15, 0.3, 3.75, 0), input=8660, write_5m=478062, cache_read=5920470, output=220) == pytest.approx(3.5982, abs=1e-4)
    assert cost(spark, (5, 25, 0.5, 6.25, 10), input=894, write_1h=372322, cache_read=8377691, output=259) == pytest.approx(7.9230, abs=1e-3)
    # A write without a split costs what the shorter tier costs.
    assert cost(spark, (5, 25, 0.5, 6.25, 10), write_flat=372322) == cost(spark, (5, 25, 0.5, 6.25, 10), write_5m=372322)


def test_price_of_long_context(spark):
    low = cost(spark, (3, 15, 0, 0, 0), {"input": 6e-6}, 200_000, input=1000, cache_read=100_000)
    high = cost(spark, (3, 15, 0, 0, 0), {"input": 6e-6}, 200_000, input=1000, cache_read=300_000)
    assert (low, high) == (pytest.approx(0.003), pytest.approx(0.006))


def test_budget(spark):
    days = spark.createDataFrame([(f"2024-01-{d:02d}", 10.0) for d in range(1, 21)], "day string, cost double").withColumn("day", F.to_date("day"))
    b = usage.budget(days, "day", "cost", "2024-01-20 00:00:00", 250.0).first()
    assert (b.spent, round(b.per_day, 4), b.severity) == (200.0, round(80 / 7, 4), "warn")
    assert b.cap_met == "2024-01-24"


def test_bm25_as_a_loop_gives_it(spark):
    r = random.Random(5)
    docs = [(i, " ".join(r.choice("alpha beta gamma delta".split()) for _ in range(r.randint(0, 12)))) for i in range(60)]
    got = {x.id: x.score for x in search.search(spark.createDataFrame(docs, "id long, body string"), "id", "alpha delta", "body").collect()}
    split = [(i, b.split()) for i, b in docs]
    mean = sum(len(w) for _, w in split) / len(split)
    for i, w in split:
        want = 0.0
        for t in ("alpha", "delta"):
            n = sum(t in v for _, v in split)
            idf = math.log((len(split) - n + 0.5) / (n + 0.5))
            f = Counter(w)[t]
            want += (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) if f else 0
        assert got.get(i, 0.0) == pytest.approx(want, rel=1e-9, abs=1e-15)


def test_search_without_documents(spark):
    assert search.search(spark.createDataFrame([], "id long, body string"), "id", "a b", "body").collect() == []
    assert search.search(spark.createDataFrame([(1, None), (2, "")], "id long, body string"), "id", "...", "body").collect() == []


@pytest.mark.parametrize(
    "query,docs",
    [("alpha AND beta", [1]), ("alpha NOT beta", [2]), ('"beta gamma"', [1]), ("bet*", [1, 3]), ("NEAR(alpha gamma, 1)", [1]), ("(alpha OR delta) AND beta", [1, 3]), ("don't", []), ("fix or revert", []), ("foo-bar C++ a.b", [])],
)
def test_query_language(spark, query, docs):
    rows = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha x y z gamma"), (3, "Beta delta")], "id long, body string")
    node = search.parse_query(query)
    found = [r.id for r in rows.where(search.holds(node, text.words(F.col("body")))).orderBy("id").collect()] if node else []
    assert found == docs


def test_relax():
    assert search.relax("alpha beta") == "alpha OR beta"
    assert search.relax("one") == "one"
    assert search.relax('say "a b"') == 'say "a b"'
    assert search.relax("fix or revert") == "fix OR or OR revert"


def test_fusion_goes_by_rank_when_evidence_is_thin(spark):
    hits = spark.createDataFrame([("m", i, float(100 - i)) for i in range(5)] + [("s", i, float(10 - i)) for i in range(2)], "corpus string, id long, magnitude double")
    bounds = [float(i) for i in range(101)]
    thin = spark.createDataFrame([("m", bounds, 400), ("s", bounds, 10)], "corpus string, boundaries array<double>, sample long")
    got = [(r.corpus, r.id) for r in search.fuse(hits, thin, 4, ["m", "s"]).collect()]
    assert got == [("m", 0), ("s", 0), ("m", 1), ("s", 1)]
    rich = spark.createDataFrame([("m", bounds, 400), ("s", bounds, 400)], "corpus string, boundaries array<double>, sample long")
    rows = search.fuse(hits, rich, 7, ["m", "s"]).collect()
    assert [(r.corpus, r.id) for r in rows][:2] == [("m", 0), ("m", 1)]
    assert all(0.05 <= r.score <= 1 for r in rows)


def test_spans_of_a_long_gap(spark):
    roles = ["user", "assistant"] * 5
    rows = [(1, i + 1, roles[i], "now do the other thing" if i == 4 else "text", f"2024-01-01 0{0 if i < 4 else 2}:{i:02d}:00") for i in range(10)]
    df = spark.createDataFrame(rows, "s long, n long, role string, text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    scored = temporal.boundary_scores(df, "s", "n", "role", "text", "ts")
    scores = {r.n: r.score for r in scored.collect()}
    assert scores[4] == 1.0 and max(v for k, v in scores.items() if k not in (4, 10)) <= 0.45 and scores[10] is None
    for threshold in (0.6, 0.85):
        got = [(r.span_from, r.span_to, r.sealed) for r in temporal.spans(scored, "s", "n", threshold).orderBy("span_from").collect()]
        assert got == [(1, 4, True), (5, 10, False)]


def test_spans_as_a_loop_gives_them(spark):
    r = random.Random(2)
    rows, want = [], []
    for s in range(60):
        n = r.randint(1, 9)
        cuts = [r.random() < 0.4 for _ in range(n - 1)]
        rows += [(s, i, (1.0 if cuts[i] else 0.0) if i < n - 1 else None) for i in range(n)]
        runs, start = [], 0
        for c in [i for i, x in enumerate(cuts) if x]:
            if c - start + 1 >= 2:
                runs.append([start, c])
            start = c + 1
        if n - start >= 2:
            runs.append([start, n - 1])
        elif start < n and runs:
            runs[-1][1] = n - 1
        elif start < n:
            runs.append([start, n - 1])
        want += [(s, a, b, n - 1 - b >= 3) for a, b in runs]
    got = temporal.spans(spark.createDataFrame(rows, "s long, n long, score double"), "s", "n", 0.5)
    assert sorted((x.s, x.span_from, x.span_to, x.sealed) for x in got.collect()) == sorted(want)


def test_blocks_as_a_loop_gives_them(spark):
    r = random.Random(3)
    t, rows = 0, []
    for i in range(300):
        t += r.choice([60, 3600, 7000, 17999, 18000, 18001, 40000])
        rows.append((1, i, 1_700_000_000 + t))
    df = spark.createDataFrame(rows, "k long, i long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {x.i: x.b for x in temporal.blocks(df, "ts", ["k"]).select("i", F.unix_seconds("block_start").alias("b")).collect()}
    start = before = None
    for _, i, s in rows:
        if start is None or s - start > 18000 or s - before > 18000:
            start = s - s % 3600
        before = s
        assert got[i] == start


def test_active_seconds(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 600), (1, 2, 1200), (1, 3, 9000)], "k long, i long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert temporal.active_seconds(df, "k", "ts", "i").first().active_seconds == 1200


def test_pk_of_itself_is_none(spark):
    df = spark.createDataFrame([(1, i, int(i in (3, 7)), int(i in (3, 7)), int(i == 5)) for i in range(10)], "k long, i long, gold int, same int, other int")
    assert temporal.segmentation_errors(df, "k", "i", "gold", "same", 2).first()[1:3] == (0.0, 0.0)
    assert temporal.segmentation_errors(df, "k", "i", "gold", "other", 2).first().pk > 0


def test_components_as_union_find_gives_them(spark):
    r = random.Random(4)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in linked}


def test_chain_and_cycle(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (8, 9), (9, 8)], "n long, p long")
    got = {(x.head, x.position, x.node) for x in graph.chains(edges, "n", "p").where("head < 5").collect()}
    assert got == {(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 4)}
    assert {x.node for x in graph.roots(edges, "n", "p").collect()} == {2, 3, 4, 8, 9}  # it ends, cycle or not


def test_similar_pairs_are_exact(spark):
    r = random.Random(6)
    docs = [(i, " ".join(r.choice("red blue green black white brown".split()) for _ in range(4))) for i in range(40)]
    v = mining.tfidf(mining.term_counts(spark.createDataFrame(docs, "id long, t string"), "id", "t"), 40)
    by = {}
    for x in v.collect():
        by.setdefault(x.id, {})[x.term] = x.w
    want = {(a, b) for a in by for b in by if a < b and sum(w * by[b].get(t, 0) for t, w in by[a].items()) >= 0.7}
    assert {(x.a, x.b) for x in mining.similar_pairs(v, 0.7).collect()} == want


def test_decisions(spark):
    long = "I'll rewrite the reader so that it takes whole files at once."
    rows = [(1, 0, "assistant", long), (1, 1, "user", "Tool loaded."), (1, 2, "user", "Sounds good!"), (1, 3, "assistant", "I'll do it"), (1, 4, "user", "yes"), (2, 0, "assistant", long), (2, 1, "user", "no, wait")]
    got = temporal.decisions(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(x.conv_id, x.proposal_at, x.confirmed_at) for x in got] == [(1, 0, 2)]


def test_projections(spark):
    branches = {"fix/a": "bugfix", "HEAD": "", "": "", "main": "development", "my-feature": "feature", "xyz": "branch-work", "ci/x": "ci"}
    df = spark.createDataFrame(list(branches.items()), "b string, want string")
    assert df.where(project.work_type(F.col("b")) != F.col("want")).count() == 0
    paths = spark.createDataFrame([("/home/a/work/github.com/org/repo/sub", "org/repo"), ("C:\\work\\github.com\\o\\r", "o/r"), ("/tmp", "")], "p string, want string")
    assert [x[0] for x in paths.select(project.repo_of(F.col("p"))).collect()] == ["org/repo", "o/r", ""]
    remotes = spark.createDataFrame([("git@host.com:org/repo.git",), ("https://host.com/org/repo",)], "u string")
    assert {x[0] for x in remotes.select(project.remote_repo(F.col("u"))).collect()} == {"org/repo"}


def test_cursor_states(spark):
    files = spark.createDataFrame([(1, 5, 1), (2, 9, 1), (3, 3, 1), (4, 5, 2), (5, 5, 1)], "k long, size long, mtime long")
    cursors = spark.createDataFrame([(2, 5, 9, 1), (3, 5, 5, 1), (4, 5, 5, 1), (5, 5, 5, 1), (6, 5, 5, 1)], "k long, read_to long, seen_size long, seen_mtime long")
    got = {x.k: x.state for x in rel.cursor_state(files, cursors, "k").collect()}
    assert got == {1: "new", 2: "append_behind", 3: "truncated", 4: "rewritten", 5: "converged", 6: "deleted"}
