import json

from pyspark.sql import functions as F

from tidemark.sources import markdown, transcripts


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def test_transcript_entries_and_blocks(spark, tmp_path):
    usage = {"input_tokens": 5, "output_tokens": 7, "cache_creation": {"ephemeral_5m_input_tokens": 11}}
    write(
        tmp_path / "proj" / "s1.jsonl",
        [
            {"type": "user", "uuid": "a", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "please mend the reader"}},
            {"type": "assistant", "uuid": "b", "timestamp": "2024-01-01T00:01:00Z", "message": {"role": "assistant", "model": "m", "usage": usage, "content": [{"type": "text", "text": "Done"}, {"type": "tool_use", "name": "Bash", "id": "t1", "input": {"cmd": "ls"}}, {"type": "odd"}]}},
            {"type": "assistant", "uuid": "b", "message": {"role": "assistant", "content": "again"}},
            "not json",
            {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}]}},
            {"type": "file-history-snapshot", "messageId": "m1", "snapshot": {"trackedFileBackups": {"a.py": {"backupTime": "now"}}}},
        ],
    )
    rows = transcripts.entries(transcripts.read_lines(spark, str(tmp_path / "proj")))
    got = rows.orderBy("line").collect()
    assert [(r.uuid, r.type) for r in got] == [("a", "user"), ("b", "assistant"), (None, "user"), ("m1", "file-history-snapshot")]
    assert (got[1].input_tokens, got[1].write_5m_tokens, got[1].session_id, got[1].project) == (5, 11, "s1", "proj")
    blocks = transcripts.blocks(rows).orderBy("line", "block").collect()
    assert [(b.content_type, b.text) for b in blocks] == [("text", "please mend the reader"), ("text", "Done"), ("tool_use", 'Bash {"cmd":"ls"}'), ("tool_result", "x\ny")]
    assert blocks[2].tool_command == "ls"
    assert transcripts.snapshot_files(rows).collect()[0][2:] == ("a.py", "now")
    s = transcripts.sessions(transcripts.blocks(rows)).first()
    assert (s.topic, s.total_msgs, s.session_type) == ("please mend the reader", 4, "interactive")


def test_other_transcript_formats(spark, tmp_path):
    write(
        tmp_path / "p" / "c.jsonl",
        [
            {"timestamp": "2024-01-01T00:00:00Z", "type": "turn_context", "payload": {"model": "m1"}},
            {"timestamp": "2024-01-01T00:00:01Z", "type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "hello"}]}},
            {"timestamp": "2024-01-01T00:00:02Z", "type": "response_item", "payload": {"type": "function_call_output", "call_id": "k", "output": "res"}},
        ],
    )
    got = transcripts.envelope_entries(transcripts.read_lines(spark, str(tmp_path / "p"))).orderBy("line").collect()
    assert [(r.type, r.text, r.model) for r in got][1:] == [("assistant", "hello", "m1"), ("user", "res", "m1")]
    write(tmp_path / "g" / "updates.jsonl", [{"timestamp": 1704067200, "method": "u", "params": {"sessionId": "z", "update": {"sessionUpdate": "agent_message_chunk", "content": {"text": "hi"}}}}, {"params": {"update": {"sessionUpdate": "plan"}}}])
    got = transcripts.update_entries(transcripts.read_lines(spark, str(tmp_path / "g"))).collect()
    assert [(r.session_id, r.type, r.text, str(r.ts)) for r in got] == [("z", "assistant", "hi", "2024-01-01 00:00:00")]


def test_markdown(spark):
    docs = spark.createDataFrame([("a.md", "# Log\n\n## 2024-01-02 — /audit v1.2.0\nAll good.\n\n## 2024-02-03 — /scan\nMore\n")], "path string, content string")
    got = markdown.audit_entries(docs).orderBy("section_no").collect()
    assert [(r.date, r.skill, r.version, r.body) for r in got] == [("2024-01-02", "audit", "v1.2.0", "All good."), ("2024-02-03", "scan", "", "More")]
    t = spark.createDataFrame([("t", "### 🎯T1.2 Faster reads\n- **Status**: active\n- **Weight**: 2.5\n\nMake it fast.\n")], "path string, content string")
    r = markdown.targets(t).first()
    assert (r.target_id, r.name, r.status, r.weight, r.description) == ("T1.2", "Faster reads", "active", 2.5, "Make it fast.")
    m = spark.createDataFrame([("---\nname: x\ndescription: \"a b\"\n---\nbody\n",), ("no front",)], "content string")
    assert [tuple(r) for r in m.select(*markdown.frontmatter(F.col("content"), "name", "description")).collect()] == [("x", "a b", "body\n"), ("", "", "no front")]


def test_todos(spark):
    docs = spark.createDataFrame([("p", "# Home\n- [ ] call #tag [[note|alias]] 📅 2026-01-31 ⏫ 🔁 every week\n\t- [x] sub\n- no task\n")], "path string, content string")
    a, b = markdown.todos(docs).orderBy("line_no").collect()
    assert (a.section, a.status, str(a.due), a.priority, a.tags, a.links, a.recurrence, a.text) == ("Home", "todo", "2026-01-31", "high", ["tag"], ["note"], "every week", "call alias")
    assert (b.status, b.indent) == ("done", 4)


def test_paths(spark):
    df = spark.createDataFrame([("src/a.py",), ("build/x.o",), ("docs/build/y",), ("build/keep.txt",)], "p string")
    got = {r.p: r.i for r in df.select("p", markdown.ignored(F.col("p"), ["# c", "build/", "!build/keep.txt"]).alias("i")).collect()}
    assert got == {"src/a.py": False, "build/x.o": True, "docs/build/y": True, "build/keep.txt": False}
    one = spark.createDataFrame([("h\x00A\x00a@b\x002024\x00sub\x00body\x1e\nh2\x00B\x00b@b\x002025\x00s2\x00\x1e",)], "t string")
    assert [r.hash for r in one.select(markdown.commits(F.col("t")).alias("c")).first().c] == ["h", "h2"]


def test_feeds(spark, tmp_path):
    from tidemark.sources import feeds

    (tmp_path / "pricing-2024-01-02.json").write_text(json.dumps({"m": {"input_cost_per_token": "3e-6", "output_cost_per_token": 1.5e-5}, "empty": {"mode": "chat"}}))
    (tmp_path / "other.json").write_text("{}")
    got = feeds.rate_cards(spark, str(tmp_path)).collect()
    assert [(str(r.day), r.model, r.input, r.output) for r in got] == [("2024-01-02", "m", 3e-6, 1.5e-5)]
    lines = lambda *rows: spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    items = feeds.repository_items(lines({"repo": "r", "number": 1, "state": "OPEN", "headRefName": "b", "updatedAt": "2024-01-01T00:00:00Z", "title": "a"}, {"repo": "r", "number": 1, "state": "CLOSED", "headRefName": "b", "mergedAt": "x", "updatedAt": "2024-01-02T00:00:00Z", "title": "b"}, {"repo": "r", "number": 2, "state": "OPEN", "labels": [{"name": "bug"}]}))
    assert {(r.kind, r.number, r.state, r.title) for r in items.collect()} == {("pr", 1, "merged", "b"), ("issue", 2, "open", None)}
    runs = feeds.ci_runs(lines({"databaseId": 5, "conclusion": "failure", "log": "\n".join(map(str, range(80)))}, {"databaseId": 6, "conclusion": "success", "log": "x"}), lines=2).orderBy("run_id").collect()
    assert [(r.run_id, r.log_tail) for r in runs] == [(5, "78\n79"), (6, None)]
    costs = feeds.settled_costs(lines({"date": "2024-01-01", "amount": "2.5", "fetched_at": "1"}, {"date": "2024-01-01", "amount": 3, "fetched_at": "2"})).collect()
    assert [(str(r.day), r.cost) for r in costs] == [("2024-01-01", 3.0)]
    ps = spark.createDataFrame([("PID CPU RSS CMD\n 12 0.5 2048 agent --resume abc\n13 1 1 sh",)], "t string").select(F.explode(feeds.processes(F.col("t"))).alias("p")).select("p.*")
    assert [(r.session_id, r.pid) for r in feeds.live_sessions(ps, spark.createDataFrame([("abc",), ("x",)], "session_id string")).collect()] == [("abc", 12)]
