"""Markdown documents: frontmatter, audit logs, targets, todo lists, plans, taxonomies, and pages' titles and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, content), a file each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def frontmatter(text: Column, *names: str) -> list[Column]:
    """Fields of a --- block at the top, then the body after it."""
    head = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    fields = [F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{n}:\s*(.*)$", 1), "^[\"']|[\"']$", "")).alias(n) for n in names]
    return [*fields, F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "").alias("body")]


def sections(docs: DataFrame, text: str, mark: str = "## ") -> DataFrame:
    """Rows of docs' columns, section_no, heading and section body: the text cut before each line that begins with mark."""
    parts = F.filter(F.split(text, rf"(?m)^(?={mark})"), lambda p: p.startswith(mark))
    return docs.select("*", F.posexplode(parts).alias("section_no", "_s")).select(*docs.columns, "section_no", F.trim(F.regexp_extract("_s", rf"^{mark}(.*)", 1)).alias("heading"), F.regexp_replace("_s", r"^.*\s*|\s+$", "").alias("section"))


def audit_entries(docs: DataFrame, text: str = "content") -> DataFrame:
    """Entries of an audit log: date, skill after a dash and slash, version."""
    rows = sections(docs, text)
    return rows.select(*docs.columns, "section_no", F.regexp_extract("heading", r"^(\S+)", 1).alias("date"), F.regexp_extract("heading", r"—\s*/?([\w-]+)", 1).alias("skill"), F.regexp_extract("heading", r"\b(v[0-9]+(?:\.[0-9]+)*)", 1).alias("version"), F.col("section").alias("body"))


def targets(docs: DataFrame, text: str = "content") -> DataFrame:
    """Targets: id, name, status, weight and the first paragraph of each block with a target heading."""
    rows = sections(docs, text, "### ").where(F.col("heading").startswith("🎯"))
    return rows.select(
        *docs.columns,
        F.regexp_extract("heading", r"(T[0-9]+(?:\.[0-9]+)*)", 1).alias("target_id"),
        F.trim(F.regexp_extract("heading", r"T[0-9]+(?:\.[0-9]+)*\s+(.*)$", 1)).alias("name"),
        F.trim(F.regexp_extract("section", r"(?m)^- \*\*Status\*\*:\s*(.*)$", 1)).alias("status"),
        F.regexp_extract("section", r"(?m)^- \*\*Weight\*\*:\s*([0-9.]+)", 1).try_cast("double").alias("weight"),
        F.regexp_extract("section", r"(?m)^([^\s\-#*].*)$", 1).alias("description"),
    )


#: Marks of dates, priorities and recurrence in a task's line.
TASK_DATES = {"due": "📅", "scheduled": "⏳", "start": "🛫", "done": "✅", "cancelled": "❌", "created": "➕"}
TASK_PRIORITIES = {"🔺": "highest", "⏫": "high", "🔼": "medium", "🔽": "low", "⏬": "lowest"}
TASK_STATES = {" ": "todo", "x": "done", "X": "done", "-": "cancelled", "/": "in_progress"}


def todos(docs: DataFrame, text: str = "content") -> DataFrame:
    """Checkbox tasks with the heading above them, depth (a tab is four blanks), dates, priority, recurrence, tags, links and the text without marks."""
    lines = docs.select(*[c for c in docs.columns if c != text], F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))
    keys = [c for c in docs.columns if c != text]
    heading = F.when(F.col("line").rlike(r"^#{1,6}\s"), F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")))
    upto = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    task = r"^(\s*)[-*+] \[([ xX/\-])\] (.*)$"
    rows = lines.withColumn("section", F.last(heading, ignorenulls=True).over(upto)).where(F.col("line").rlike(task))
    body = F.regexp_extract("line", task, 3)
    state = F.regexp_extract("line", task, 2)
    status, priority = F.lit(None).cast("string"), F.lit("none")
    for mark, name in TASK_STATES.items():
        status = F.when(state == mark, name).otherwise(status)
    for mark, name in reversed(TASK_PRIORITIES.items()):
        priority = F.when(body.contains(mark), name).otherwise(priority)
    dates = [F.regexp_extract(body, rf"{mark}\s*([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})", 1).try_cast("date").alias(name) for name, mark in TASK_DATES.items()]
    marks = "|".join([*[rf"{m}\s*[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}" for m in TASK_DATES.values()], *TASK_PRIORITIES, r"🔁[^📅⏳🛫✅❌➕#\[]*", r"#[\w/-]+"])
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, marks, ""), r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"), r"\s+", " ")
    return rows.select(
        *keys, "line_no", "section", (F.length(F.replace(F.regexp_extract("line", task, 1), F.lit("\t"), F.lit("    ")))).alias("indent"), status.alias("status"), priority.alias("priority"), *dates,
        F.trim(F.regexp_extract(body, r"🔁\s*([^📅⏳🛫✅❌➕#\[]*)", 1)).alias("recurrence"),
        F.regexp_extract_all(body, F.lit(r"#([\w/-]+)"), F.lit(1)).alias("tags"),
        F.transform(F.regexp_extract_all(body, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), lambda x: F.substring_index(x, "|", 1)).alias("links"),
        F.trim(clean).alias("text"),
    )


def stems(docs: DataFrame, path: str = "path") -> DataFrame:
    """docs, of equal stems in a directory the best kind: md before txt before pdf."""
    kind = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    rank = F.when(kind == "md", 0).when(kind == "txt", 1).when(kind == "pdf", 2).otherwise(3)
    stem = F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")
    best = Window.partitionBy(stem).orderBy(rank, path)
    return docs.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def changed(docs: DataFrame, known: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """docs whose content hash isn't the known one of their path."""
    hashed = docs.withColumn("content_hash", F.sha2(content, 256))
    return hashed.join(known.select(path, "content_hash"), [path, "content_hash"], "left_anti")


def taxonomy(path: Column) -> Column:
    """The directories below the last docs/ of a path."""
    return F.regexp_extract(path, r"^(?:.*/)?docs/((?:[^/]+/)*)[^/]*$", 1)


def title(text: Column) -> Column:
    """The first line that isn't blank, without heading marks."""
    return F.trim(F.regexp_replace(F.regexp_extract(text, r"(?m)^\s*(\S.*)$", 1), r"^#+\s*", ""))


def human_part(text: Column, fence: str) -> Column:
    """What stands below the last line that is the fence, or all of it."""
    return F.regexp_replace(text, rf"(?s)\A.*(?:\A|\n)[ \t]*{fence}[ \t]*(?:\n|\Z)", "")


def commits(text: Column) -> Column:
    """Records of a git log: fields between NULs, records between record separators."""
    fields = lambda r: F.split(F.regexp_replace(r, r"^\s+", ""), "\x00")
    return F.transform(F.filter(F.split(text, "\x1e"), lambda r: F.trim(r) != ""), lambda r: F.struct(*[F.get(fields(r), i).alias(n) for i, n in enumerate(("hash", "author", "email", "date", "subject", "body"))]))


def ignore_pattern(glob: str) -> str:
    """A line of an ignore file as a regular expression for paths."""
    out, i = "", 0
    body = glob.strip("/")
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i:]:
            end = body.index("]", i)
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + ("\\" + body[i] if body[i] in ".^$+{}()|\\" else body[i]), i + 1
    return ("^" if "/" in body else "(?:^|/)") + out + "(?:/.*)?$"


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether an ignore file's last matching line excludes a path; a line with ! brings it back."""
    out = F.lit(False)
    for line in lines:
        line = line.strip()
        if line and not line.startswith("#"):
            out = F.when(path.rlike(ignore_pattern(line.lstrip("!"))), F.lit(not line.startswith("!"))).otherwise(out)
    return out
