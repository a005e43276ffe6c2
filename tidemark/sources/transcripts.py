"""Transcripts of three agents, as JSON lines: entries and content blocks in one shape.

Lines that aren't JSON are left out, unknown fields are ignored, unknown blocks dropped; nothing fails a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of an entry by JSON path. A list gives alternatives, the first that is there counts.
ENTRY_PATHS = {
    "uuid": ["$.uuid", "$.messageId"], "type": "$.type", "timestamp": "$.timestamp", "cwd": "$.cwd", "git_branch": "$.gitBranch", "parent_uuid": "$.parentUuid", "request_id": "$.requestId",
    "model": "$.message.model", "stop_reason": "$.message.stop_reason", "message_id": "$.message.id", "role": "$.message.role", "agent_id": "$.agentId", "version": "$.version", "slug": "$.slug",
    "data_type": "$.data.type", "data_command": "$.data.command", "data_hook_event": "$.data.hookEvent", "top_tool_use_id": "$.toolUseID", "parent_tool_use_id": "$.parentToolUseID", "subtype": "$.subtype",
    "attribution_skill": "$.attributionSkill", "attribution_agent": "$.attributionAgent", "spawner_uuid": "$.sourceToolAssistantUUID", "spawned_agent": "$.toolUseResult.agentId",
}
ENTRY_NUMBERS = {
    "input_tokens": "$.message.usage.input_tokens", "output_tokens": "$.message.usage.output_tokens", "cache_read_tokens": "$.message.usage.cache_read_input_tokens", "cache_creation_tokens": "$.message.usage.cache_creation_input_tokens",
    "write_5m_tokens": "$.message.usage.cache_creation.ephemeral_5m_input_tokens", "write_1h_tokens": "$.message.usage.cache_creation.ephemeral_1h_input_tokens",
}
#: Columns of a tool's input by JSON path.
TOOL_PATHS = {
    "tool_file_path": ["$.file_path", "$.target_file", "$.path", "$.filePath"], "tool_command": ["$.command", "$.cmd", "$.shell_command"], "tool_pattern": "$.pattern", "tool_description": "$.description", "tool_skill": "$.skill",
    "tool_old_string": "$.old_string", "tool_new_string": "$.new_string", "tool_content": "$.content", "tool_query": "$.query", "tool_url": "$.url", "tool_prompt": "$.prompt", "tool_subject": "$.subject", "tool_status": "$.status",
    "tool_name_param": "$.name", "tool_task_id": ["$.task_id", "$.taskId"],
}


def json_paths(raw: Column, paths: dict) -> list[Column]:
    made = []
    for name, path in paths.items():
        found = [F.get_json_object(raw, p) for p in ([path] if isinstance(path, str) else path)]
        made.append((F.coalesce(*found) if len(found) > 1 else found[0]).alias(name))
    return made


def timestamp(text: Column) -> Column:
    """A time in RFC 3339, with a blank for the T, or as epoch seconds or milliseconds."""
    number = text.try_cast("double")
    epoch = F.timestamp_micros(F.when(number > 1e11, number * 1000).otherwise(number * 1_000_000).cast("bigint"))
    return F.coalesce(F.when(number.isNotNull(), epoch), F.try_to_timestamp(text))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, session_id, project, line, raw): one per line, numbered within its file."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path")).withColumn("_at", F.monotonically_increasing_id())
    name = F.element_at(F.split("file", "/"), -1)
    return lines.select(
        "file",
        F.regexp_replace(name, r"\.jsonl$", "").alias("session_id"),
        F.element_at(F.split("file", "/"), -2).alias("project"),
        F.row_number().over(Window.partitionBy("file").orderBy("_at")).alias("line"),
        F.col("value").alias("raw"),
    )


def entries(lines: DataFrame) -> DataFrame:
    """Lines as entries with typed columns, repeated (session_id, uuid) once; entries without a uuid all stay."""
    good = lines.where(F.try_parse_json("raw").isNotNull() & F.col("raw").startswith("{"))
    rows = good.select("*", *json_paths(F.col("raw"), ENTRY_PATHS), *[c.try_cast("bigint").alias(n) for n, c in zip(ENTRY_NUMBERS, json_paths(F.col("raw"), ENTRY_NUMBERS), strict=True)], (F.get_json_object("raw", "$.isSidechain") == "true").alias("is_sidechain"))
    rows = rows.withColumn("ts", timestamp(F.col("timestamp")))
    own = Window.partitionBy("session_id", F.coalesce("uuid", F.concat(F.lit("line "), F.col("file"), F.lit(" "), F.col("line").cast("string")))).orderBy("file", "line")
    return rows.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


_BLOCK = "array<struct<type:string,text:string,thinking:string,name:string,id:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"


def blocks(rows: DataFrame) -> DataFrame:
    """Content blocks of user and assistant entries: content is a string, or an array of text, thinking, tool_use and tool_result blocks."""
    content = F.get_json_object("raw", "$.message.content")
    listed = F.from_json(content, _BLOCK)
    plain = F.array(F.struct(*[(F.lit("text") if c == "type" else content if c == "text" else F.lit(None)).cast("boolean" if c == "is_error" else "string").alias(c) for c in ("type", "text", "thinking", "name", "id", "input", "tool_use_id", "content", "is_error")]))
    every = F.when(content.startswith("["), listed).otherwise(plain)
    out = rows.where(F.col("type").isin("user", "assistant") & content.isNotNull()).select("session_id", "file", "line", "uuid", "type", "ts", F.posexplode(every).alias("block", "b"))
    result = F.coalesce(F.array_join(F.transform(F.filter(F.from_json("b.content", "array<struct<type:string,text:string>>"), lambda x: x["type"] == "text"), lambda x: x["text"]), "\n"), F.col("b.content"))
    text = F.when(F.col("b.type") == "text", F.col("b.text")).when(F.col("b.type") == "thinking", F.col("b.thinking")).when(F.col("b.type") == "tool_use", F.concat_ws(" ", "b.name", "b.input")).when(F.col("b.type") == "tool_result", result)
    out = out.where(F.col("b.type").isin("text", "thinking", "tool_use", "tool_result"))
    return out.select("session_id", "file", "line", "uuid", "type", "ts", "block", F.col("b.type").alias("content_type"), text.alias("text"), F.col("b.name").alias("tool_name"), F.coalesce("b.tool_use_id", "b.id").alias("tool_use_id"), F.col("b.input").alias("tool_input"), F.coalesce("b.is_error", F.lit(False)).alias("is_error"), *json_paths(F.col("b.input"), TOOL_PATHS))


def envelope_entries(lines: DataFrame) -> DataFrame:
    """The second format, {timestamp, type, payload}: messages, calls and outputs, each with the model last announced before it."""
    raw = F.col("raw")
    get = lambda p: F.get_json_object(raw, p)
    rows = lines.where(F.try_parse_json("raw").isNotNull()).select("*", get("$.type").alias("kind"), get("$.payload.type").alias("payload_type"), timestamp(get("$.timestamp")).alias("ts"), get("$.payload.role").alias("role"), get("$.payload.model").alias("_model"))
    order = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("model", F.last("_model", ignorenulls=True).over(order))
    body = F.coalesce(F.array_join(F.transform(F.from_json(get("$.payload.content"), "array<struct<type:string,text:string>>"), lambda x: x["text"]), "\n"), get("$.payload.output"), get("$.payload.arguments"), get("$.payload.summary"))
    type_ = F.when(F.col("payload_type").endswith("_output"), "user").when(F.col("payload_type").isin("function_call", "reasoning") | (F.col("role") == "assistant"), "assistant").when(F.col("payload_type") == "message", "user")
    usage = {f"{n}_tokens": get(f"$.payload.info.last_token_usage.{p}").try_cast("bigint") for n, p in (("input", "input_tokens"), ("output", "output_tokens"), ("cache_read", "cached_input_tokens"))}
    return rows.select("session_id", "project", "file", "line", "kind", "payload_type", "ts", "role", "model", type_.alias("type"), body.alias("text"), get("$.payload.call_id").alias("call_id"), F.concat(F.lit("line-"), F.col("session_id"), F.lit("-"), F.col("line").cast("string")).alias("uuid"), *[c.alias(n) for n, c in usage.items()])


#: Kinds of updates of the third format that become entries.
UPDATE_TYPES = {"user_message_chunk": "user", "agent_message_chunk": "assistant", "agent_thought_chunk": "assistant", "tool_call": "assistant", "tool_call_update": "user"}


def update_entries(lines: DataFrame) -> DataFrame:
    """The third format, {timestamp, method, params: {sessionId, update}}; a tool's result is its content blocks, else its content, else its raw output."""
    get = lambda p: F.get_json_object("raw", p)
    kind = get("$.params.update.sessionUpdate")
    type_ = None
    for name, to in UPDATE_TYPES.items():
        type_ = F.when(kind == name, to) if type_ is None else type_.when(kind == name, to)
    listed = F.array_join(F.transform(F.from_json(get("$.params.update.content"), "array<struct<content:struct<text:string>>>"), lambda x: x["content"]["text"]), "\n")
    text = F.coalesce(F.nullif(listed, F.lit("")), get("$.params.update.content.text"), get("$.params.update.rawOutput"))
    rows = lines.where(F.try_parse_json("raw").isNotNull()).select("file", "line", F.coalesce(get("$.params.sessionId"), F.col("session_id")).alias("session_id"), timestamp(get("$.timestamp")).alias("ts"), kind.alias("kind"), type_.alias("type"), text.alias("text"), get("$.params.update.toolCallId").alias("call_id"))
    return rows.where("type is not null")


def images(block_rows: DataFrame, raw_content: str = "raw") -> DataFrame:
    """Inline base64 images of entries, once per SHA-256 with their occurrences."""
    listed = F.from_json(F.get_json_object(raw_content, "$.message.content"), "array<struct<type:string,source:struct<type:string,media_type:string,data:string>>>")
    found = block_rows.select("session_id", "line", F.explode(listed).alias("b")).where("b.type = 'image' and b.source.type = 'base64'").withColumn("bytes", F.unbase64("b.source.data")).withColumn("sha256", F.sha2("bytes", 256))
    return found.groupBy("sha256").agg(F.first("bytes").alias("bytes"), F.first("b.source.media_type").alias("media_type"), F.sort_array(F.collect_set(F.struct("session_id", "line"))).alias("occurrences"))


def snapshot_files(rows: DataFrame) -> DataFrame:
    """Files that a snapshot entry tracks, with their backup time."""
    tracked = F.from_json(F.get_json_object("raw", "$.snapshot.trackedFileBackups"), "map<string,struct<backupTime:string>>")
    return rows.select("session_id", "uuid", F.explode(tracked).alias("file_path", "_b")).select("session_id", "uuid", "file_path", F.col("_b.backupTime").alias("backup_time"))


def sessions(block_rows: DataFrame) -> DataFrame:
    """One row per session: counts, first and last time, and the first user text that may serve as its topic."""
    from ..functions.project import is_boilerplate, is_noise, session_type

    text, noise = F.col("text"), is_noise(F.coalesce("text", F.lit("")))
    substantive = F.col("type").isin("user", "assistant") & (F.col("content_type") == "text") & ~noise
    topic = (F.col("type") == "user") & substantive & (F.length(text) >= 10) & ~is_boilerplate(text)
    return block_rows.groupBy("session_id").agg(
        F.count("*").alias("total_msgs"), F.count_if(substantive).alias("substantive_msgs"), F.min("ts").alias("first_msg"), F.max("ts").alias("last_msg"),
        F.substring(F.min_by(F.when(topic, text), F.when(topic, F.struct("line", "block"))), 1, 200).alias("topic"),
        session_type(F.element_at(F.split(F.min("file"), "/"), -2)).alias("session_type"),
    )
