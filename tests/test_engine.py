import json

import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine, ReadOnly, nested
from tidemark.operators import spans
from tidemark.sinks import export


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("t") / "proj"
    folder.mkdir()
    long = "I'll rewrite the reader so that it takes whole files at once."
    for s in ("aaaaaa1", "bbbbbb2"):
        rows = [("user", "please mend the slow reader"), ("assistant", long), ("user", "sounds good"), ("assistant", "the reader is done")]
        lines = [{"type": r, "uuid": f"{s}{i}", "cwd": f"/x/{s}", "timestamp": f"2024-01-01T00:0{i}:00Z", "requestId": "q", "message": {"role": r, "id": f"m{s}{i // 2}", "model": "m", "content": t, "usage": {"output_tokens": 10 + i}}} for i, (r, t) in enumerate(rows)]
        (folder / f"{s}.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    return Engine.from_transcripts(spark, str(folder))


def test_verbs(engine):
    assert [r.session_id for r in engine.search("slow reader", limit=2).collect()] == ["aaaaaa1", "bbbbbb2"]
    assert {r.session_id for r in engine.search("reader", repo="bbb").collect()} == {"bbbbbb2"}
    assert engine.search("mend", limit=1, context=1).count() == 2
    assert engine.read_session("aaaaaa").count() == 4 and engine.read_session("zzz").count() == 0
    assert engine.decisions().count() == 2
    assert engine.active_hours().first().active_seconds == 180
    assert {(r.calls, r.output_tokens) for r in engine.usage().collect()} == {(4, 48)}
    assert engine.stats().first().sessions == 2


def test_queries_only(engine):
    assert engine.query("SELECT role, count(*) AS n FROM messages GROUP BY role ORDER BY role").collect()[0].n == 4
    for sql in ("DROP TABLE x", "CREATE TABLE t AS SELECT 1", "INSERT INTO t SELECT 1", "SET a = b"):
        with pytest.raises(ReadOnly):
            engine.query(sql)
    assert engine.query("SELECT explode(sequence(1, 500)) AS i").count() == 100


def test_templates_bind_values(engine):
    engine.define("by_role", "SELECT count(*) AS n FROM messages WHERE role = {{role}}")
    assert engine.evaluate("by_role", role="user").first().n == 4
    assert engine.evaluate("by_role", role="x' OR '1'='1").first().n == 0
    with pytest.raises(ValueError):
        engine.evaluate("by_role")


def test_nested_rows(engine):
    got = engine.query("FROM sessions s SELECT { id: s.session_id, texts: SELECT { role: m.role } FROM messages m WHERE m.session_id = s.session_id, one: SELECT { r: m.role } FROM messages m WHERE m.session_id = s.session_id LIMIT 1 } ORDER BY s.session_id")
    first = json.loads(got.first().json)
    assert first["id"] == "aaaaaa1" and len(first["texts"]) == 4 and set(first["one"]) == {"r"}
    assert nested("SELECT 1 AS a") == "SELECT 1 AS a"


def test_spans(spark):
    s = spark.createDataFrame([("a", 5, 1, "x"), ("a", 3, 8, "y"), ("a", 7, 7, "z"), ("a", 9, 99, "w")], "k string, lo long, hi long, label string")
    w = spark.createDataFrame([("a", 1, 20)], "k string, first long, last long")
    assert sorted((r.lo, r.hi, r.label) for r in spans.trimmed(s, w, "k").collect()) == [(1, 5, "x"), (6, 8, "y"), (9, 20, "w")]
    fine = spark.createDataFrame([("a", 2, 3), ("a", 8, 30)], "k string, lo long, hi long")
    coarse = spark.createDataFrame([("a", 1, 10)], "k string, lo long, hi long")
    assert {(r.lo, r.parent_lo) for r in spans.enclosing(fine, coarse, "k").collect()} == {(2, 1), (8, None)}
    t = spark.createDataFrame([("1", "achieved"), ("2", "active"), ("3", "active"), ("4", "active")], "id string, status string")
    needs = spark.createDataFrame([("2", "1"), ("3", "2")], "id string, need string")
    assert {r.id for r in spans.frontier(t, needs).collect()} == {"2", "4"}
    waits = spark.createDataFrame([(0,), (1,), (3,), (30,)], "n int").select(spans.retry_after(F.col("n"), 60))
    assert [r[0] for r in waits.collect()] == [0, 60, 240, 21600]


def test_notes_keep_what_people_wrote(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A title", "body"), (2, "B", None)], "id long, title string, body string")
    new = rows.select(export.note_path("doc", F.col("title"), F.col("id")).alias("path"), export.note({"id": F.col("id")}, F.col("title"), F.col("body")).alias("content"))
    first = {r.path: r.content for r in new.collect()}
    path = next(p for p in first if "a-title" in p)
    old = spark.createDataFrame([(path, "---\nid: 0\n---\nold\n" + export.FENCE + "\nmine\n")], "path string, content string")
    got = {r.path: r.content for r in export.merged(new, old).collect()}
    assert got[path].endswith(export.FENCE + "\nmine\n") and "old" not in got[path] and len(got) == 2
    assert export.merged(new, new).count() == 0
    assert export.snapshot(spark, {"t": rows}, str(tmp_path), "2024-01-01") == {"t": 2} and export.expired(["b", "a", "c"], 2) == ["a"]


def test_batches_merge(spark):
    seen = spark.createDataFrame([("s", "1")], "s string, u string")
    batch = spark.createDataFrame([("s", "1"), ("s", "2"), ("s", "2"), ("s", None), ("s", None)], "s string, u string")
    assert export.new_entries(seen, batch, ["s", "u"]).count() == 3
    rows = spark.createDataFrame([("s", 1, "a", "t1", 0), ("s", 2, "", "t2", 1), ("s", 3, "c", "", 0)], "s string, o int, cwd string, topic string, own int")
    assert tuple(export.merge_meta(rows, "s", "o", ["cwd"], ["topic"], ["own"]).first()) == ("s", "c", "t1", 1)
