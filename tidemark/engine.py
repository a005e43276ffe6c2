"""The engine's verbs over a set of tables: search, sessions, reading, usage, and read-only SQL with bound templates and nested rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import capped, glob_pattern
from .operators import relational as rel
from .operators import search as search_ops
from .operators import spans, temporal, usage
from .sources import transcripts

CAP = 100


class ReadOnly(ValueError):
    """Raised for statements that aren't queries."""


def nested(sql: str) -> str:
    """SELECT { name: expression, other: SELECT { ... } FROM ... } FROM ... as SQL that gives one JSON column.

    A nested query becomes an array, with LIMIT 1 at its end a single object; its array's order is not stated unless it says so.
    """
    def close(text: str, at: int) -> int:
        depth, quote = 0, ""
        for i in range(at, len(text)):
            c = text[i]
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"`":
                quote = c
            elif c in "{([":
                depth += 1
            elif c in "})]":
                depth -= 1
                if not depth:
                    return i
        raise ValueError("a brace is never closed")

    def parts(body: str) -> list[str]:
        out, depth, quote, start = [], 0, "", 0
        for i, c in enumerate(body):
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"`":
                quote = c
            elif c in "{([":
                depth += 1
            elif c in "})]":
                depth -= 1
            elif c == "," and not depth:
                out.append(body[start:i])
                start = i + 1
        return [p.strip() for p in [*out, body[start:]] if p.strip()]

    def struct(body: str) -> str:
        fields = []
        for p in parts(body):
            name, _, value = p.partition(":")
            if not value:
                name = value = p
            name, value = name.strip().strip("`\"'"), value.strip()
            if re.match(r"(?is)(SELECT|FROM)\b", value):
                value = f"({rows(value, True)})"
            fields.append(f"'{name.rpartition('.')[2]}', {value}")
        return f"named_struct({', '.join(fields)})"

    def rows(query: str, inner: bool) -> str:
        m = re.search(r"(?is)\bSELECT\s*\{", query)
        if not m:
            return query
        end = close(query, m.end() - 1)
        made, before, after = struct(query[m.end() : end]), query[: m.start()].strip(), query[end + 1 :].strip()
        tail = f"{before} {after}".strip()
        if not inner:
            return f"SELECT to_json({made}) AS json {tail}"
        single = re.search(r"(?is)\s+LIMIT\s+1\s*$", tail)
        tail = tail[: single.start()] if single else tail
        return f"SELECT {'first' if single else 'collect_list'}({made}) {tail}"

    return rows(sql.strip().rstrip(";"), False)


class Engine:
    """messages: session_id, id, role, text and ts; sessions: session_id, repo, last_msg, substantive; others as their verbs say."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables, self.templates = spark, tables, {}

    @classmethod
    def from_transcripts(cls, spark: SparkSession, path: str) -> Engine:
        rows = transcripts.entries(transcripts.read_lines(spark, path))
        blocks = transcripts.blocks(rows)
        messages = blocks.where("text is not null").select("session_id", (F.col("line") * 1000 + F.col("block")).cast("long").alias("id"), F.col("type").alias("role"), "text", "ts", "content_type", "tool_name")
        meta = rows.groupBy("session_id").agg(F.max("cwd").alias("repo"))
        sessions = transcripts.sessions(blocks).join(meta, "session_id", "left").withColumnRenamed("substantive_msgs", "substantive")
        return cls(spark, {"entries": rows, "messages": messages, "sessions": sessions})

    def search(self, query: str, limit: int = 20, repo: str = "", context: int = 0) -> DataFrame:
        """The best messages, filtered before they are ranked, with `context` messages beside each."""
        rows = self.tables["messages"]
        if repo:
            rows = rows.join(self.tables["sessions"].where(F.col("repo").ilike(glob_pattern(repo))), "session_id", "left_semi")
        keyed = rows.withColumn("_key", F.concat_ws("\0", "session_id", F.col("id").cast("string")))
        top = search_ops.search(keyed, "_key", query, "text").orderBy(F.desc("score"), "id").limit(limit)
        hits = keyed.join(F.broadcast(top.select(F.col("id").alias("_key"), "score")), "_key").select("session_id", "id", "role", capped(F.col("text"), 500).alias("text"), "score")
        if not context:
            return hits.orderBy(F.desc("score"), "session_id", "id")
        from pyspark.sql import Window

        placed = self.tables["messages"].withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("id")))
        at = placed.join(F.broadcast(hits.select("session_id", "id")), ["session_id", "id"], "left_semi").select("session_id", "place")
        return rel.around(at, placed.select("session_id", "place", "id", "role", "text"), "session_id", "place", context)

    def sessions(self, repo: str = "", limit: int = 20) -> DataFrame:
        s = self.tables["sessions"]
        return (s.where(F.col("repo").ilike(glob_pattern(repo))) if repo else s).orderBy(F.desc("last_msg"), "session_id").limit(limit)

    def read_session(self, ref: str = "", offset: int = 0, limit: int = 50) -> DataFrame:
        one = spans.find_session(self.tables["sessions"], ref).select("session_id")
        return self.tables["messages"].join(F.broadcast(one), "session_id", "left_semi").orderBy("session_id", "id").offset(offset).limit(limit)

    def stats(self) -> DataFrame:
        return self.tables["sessions"].groupBy("session_type").agg(F.count("*").alias("sessions"), F.sum("total_msgs").alias("total"), F.sum("substantive").alias("substantive"))

    def active_hours(self) -> DataFrame:
        return temporal.active_seconds(self.tables["messages"].where("ts is not null"), "session_id", "ts", "id").withColumn("hours", F.col("active_seconds") / 3600)

    def decisions(self) -> DataFrame:
        return temporal.decisions(self.tables["messages"].where("content_type = 'text'"), "session_id", "id")

    def usage(self) -> DataFrame:
        """Calls by day and model. Records without a message id are told apart as not keyed."""
        rows = self.tables["entries"].where("type = 'assistant'").withColumn("call", F.coalesce("message_id", F.concat(F.lit("row:"), "session_id", F.lit(":"), F.col("line").cast("string")))).withColumn("keyed", F.col("message_id").isNotNull())
        calls = usage.billable(rows.withColumn("req", F.coalesce("request_id", F.lit(""))), ["call", "req"], ["input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens"], ["model", "ts", "keyed"], ["ts", "session_id", "line"])
        return calls.groupBy(F.to_date("ts").alias("day"), "model", "keyed").agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")])

    def query(self, sql: str, args: dict | None = None) -> DataFrame:
        """At most 100 rows of a query, nested or plain, over the tables. Statements that would change something are refused."""
        sql = nested(sql)
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        kinds = [plan.getClass().getName()] + [n.getClass().getName() for n in _nodes(plan)]
        if any(re.search(r"Command|CreateTable|InsertInto|Merge|Delete|Update|Drop|SetCatalog|AddJar|Alter", k) for k in kinds):
            raise ReadOnly(sql)
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(sql, args=args or {}).limit(CAP)

    def define(self, name: str, sql: str) -> None:
        """Stores a query with {{parameters}}."""
        self.templates[name] = sql

    def evaluate(self, name: str, **args) -> DataFrame:
        """A stored query with its parameters bound as values."""
        sql = self.templates[name]
        wanted = set(re.findall(r"\{\{\s*(\w+)\s*\}\}", sql))
        if wanted != set(args):
            raise ValueError(f"{name} takes {sorted(wanted)}")
        return self.query(re.sub(r"\{\{\s*(\w+)\s*\}\}", r":\1", sql), args)


def _nodes(plan) -> list:
    out, todo = [], [plan]
    while todo:
        children = todo.pop().children()
        for i in range(children.size()):
            out.append(children.apply(i))
            todo.append(out[-1])
    return out
