"""Feeds from outside, read from files that something else fetched: rate cards, pull requests and issues, CI runs, settled costs, process lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a rate by their names in a rate file. Numbers may be quoted.
RATES = {
    "input": "input_cost_per_token", "output": "output_cost_per_token", "cache_read": "cache_read_input_token_cost", "write_5m": "cache_creation_input_token_cost", "write_1h": "cache_creation_input_token_cost_above_1hr",
    "input_above": "input_cost_per_token_above_200k_tokens", "output_above": "output_cost_per_token_above_200k_tokens", "cache_read_above": "cache_read_input_token_cost_above_200k_tokens",
}


def rate_cards(spark: SparkSession, path: str) -> DataFrame:
    """Rows (day, model, rates) of dated files pricing-YYYY-MM-DD.json, each an object of models. Entries without any price are left out."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})\.json$", 1).try_cast("date").alias("day"), F.from_json("value", "map<string,string>").alias("m"))
    rows = files.where("day is not null").select("day", F.explode("m").alias("model", "r"))
    rates = [F.get_json_object("r", f"$.{p}").try_cast("double").alias(n) for n, p in RATES.items()]
    return rows.select("day", "model", *rates).where("coalesce(input, 0) > 0 or coalesce(output, 0) > 0 or coalesce(cache_read, 0) > 0 or coalesce(write_5m, 0) > 0")


def settled_costs(rows: DataFrame, raw: str = "value") -> DataFrame:
    """Rows (day, cost) of daily reports; a day that is reported again takes the later report's cost."""
    parsed = rows.select(F.get_json_object(raw, "$.date").try_cast("date").alias("day"), F.get_json_object(raw, "$.amount").try_cast("double").alias("cost"), F.get_json_object(raw, "$.fetched_at").alias("at"))
    return parsed.where("day is not null and cost is not null").groupBy("day").agg(F.max_by("cost", F.struct("at", "cost")).alias("cost"))


def repository_items(rows: DataFrame, raw: str = "value") -> DataFrame:
    """Pull requests and issues in one table, the latest state of each; only a pull request can be merged."""
    get = lambda p: F.get_json_object(raw, p)
    merged = get("$.mergedAt")
    kind = F.when(get("$.headRefName").isNotNull() | merged.isNotNull(), "pr").otherwise("issue")
    state = F.when(merged.isNotNull(), "merged").otherwise(F.lower(get("$.state")))
    labels = F.transform(F.from_json(get("$.labels"), "array<struct<name:string>>"), lambda x: x["name"])
    items = rows.select(get("$.repo").alias("repo"), kind.alias("kind"), get("$.number").try_cast("long").alias("number"), get("$.title").alias("title"), get("$.author.login").alias("author"), state.alias("state"), F.coalesce(labels, F.array().cast("array<string>")).alias("labels"), F.try_to_timestamp(get("$.updatedAt")).alias("updated_at"), get("$.body").alias("body"))
    rest = [c for c in items.columns if c not in ("repo", "kind", "number")]
    return items.where("number is not null").groupBy("repo", "kind", "number").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "state", "title")).alias("i")).select("repo", "kind", "number", "i.*")


def ci_runs(rows: DataFrame, raw: str = "value", lines: int = 50) -> DataFrame:
    """CI runs; of failed ones the last lines of their log."""
    get = lambda p: F.get_json_object(raw, p)
    log = F.split(get("$.log"), "\n")
    tail = F.array_join(F.slice(log, F.greatest(-F.size(log), F.lit(-lines)), lines), "\n")
    return rows.select(get("$.databaseId").try_cast("long").alias("run_id"), get("$.workflowName").alias("workflow"), get("$.headBranch").alias("branch"), get("$.conclusion").alias("conclusion"), F.try_to_timestamp(get("$.createdAt")).alias("created_at"), F.when(get("$.conclusion") == "failure", tail).alias("log_tail")).where("run_id is not null")


def processes(text: Column) -> Column:
    """Lines 'pid cpu rss command' of a process list as structs; other lines are left out."""
    pattern = r"^\s*(\d+)\s+([\d.]+)\s+(\d+)\s+(.*)$"
    part = lambda x, i: F.regexp_extract(x, pattern, i)
    return F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern)), lambda x: F.struct(part(x, 1).cast("long").alias("pid"), part(x, 2).cast("double").alias("cpu"), part(x, 3).cast("long").alias("rss"), part(x, 4).alias("command")))


def live_sessions(listed: DataFrame, sessions: DataFrame, command: str = "command") -> DataFrame:
    """Processes whose command names a session, with the session. A host's list is small."""
    found = listed.withColumn("session_id", F.regexp_extract(command, r"--(?:resume|session)[= ](\S+)", 1)).where("session_id <> ''")
    return sessions.join(F.broadcast(found), "session_id")  # a host's processes
