"""Derivative WARC records: for each response a metadata record and a plain-text conversion record that refer to it.

All of it is column expressions: no Python on the way, no shuffle, one response read once. parse() and serialise()
read and write the record format itself.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Elements that end a line of text, and references that the conversion decodes, in this order.
BREAKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def record_id(*parts: Column) -> Column:
    """A stable urn:uuid from a hash of the parts."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of fetched pages: id_col, record_id, target_uri, date, http_headers, payload, payload_digest. Null urls and pages are empty."""
    payload, url = F.coalesce(F.col(html_col), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF))
    return pages.select(
        F.col(id_col),
        record_id(F.lit("response"), F.col(id_col), url).alias("record_id"),
        url.alias("target_uri"),
        F.lit(DATE).alias("date"),
        headers.alias("http_headers"),
        payload.alias("payload"),
        digest(payload).alias("payload_digest"),
    )


def plain_text(html: Column) -> Column:
    """Markup taken out: no comments, scripts or styles, a line for each block, blanks collapsed, the common references decoded."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")
    t = F.regexp_replace(t, r"[ \t\r\n\f]+", " ")
    t = F.regexp_replace(t, rf"(?i)</?(?:{BREAKS})(?:[ /][^>]*)?>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for name, char in REFERENCES:
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(t, r" *\n[ \n]*", "\n")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")


def derive(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Two rows per response: its metadata and its conversion record.

    Columns: id_col, record_type, record_id, refers_to (the response's id), concurrent_to (the other derivative's id),
    target_uri, date, content_type, source_headers and source_digest (the response's own, unchanged), block, block_digest, n_bytes.
    Empty payloads give an empty conversion. Repeated responses give repeated derivatives, as ids follow from content.
    Other columns are left out. An empty table gives an empty one.
    """
    null = lambda c: F.coalesce(F.col(c), F.lit(""))
    headers, payload = null("http_headers"), null("payload")
    rows = records.select(
        F.col(id_col), null("record_id").alias("refers_to"), null("target_uri").alias("target_uri"), null("date").alias("date"), headers.alias("source_headers"), null("payload_digest").alias("source_digest"), payload.alias("_payload")
    )
    meta_id, text_id = record_id(F.lit("metadata"), F.col("refers_to")), record_id(F.lit("conversion"), F.col("refers_to"))
    title = F.regexp_replace(F.regexp_extract("_payload", r"(?is)<title[^>]*>(.*?)</title", 1), r"[ \t\r\n\f]+", " ")
    status, mime = F.regexp_extract("source_headers", r"^HTTP/[0-9.]+ ([0-9]{3})", 1), F.regexp_extract("source_headers", r"(?i)\r\nContent-Type: ([^\r\n]*)", 1)
    links = F.regexp_count("_payload", F.lit(r"(?i)<a\s[^>]*href")).cast("string")
    fields = [("http-status", status), ("content-type", mime), ("title", title), ("links", links), ("source-digest", F.col("source_digest"))]
    metadata = F.concat(*[x for name, value in fields for x in (F.lit(f"{name}: "), value, F.lit(CRLF))])
    of = lambda kind, own, other, mime, block: F.struct(F.lit(kind).alias("record_type"), own.alias("record_id"), other.alias("concurrent_to"), F.lit(mime).alias("content_type"), block.alias("block"))
    both = F.array(of("metadata", meta_id, text_id, "application/warc-fields", metadata), of("conversion", text_id, meta_id, "text/plain; charset=utf-8", plain_text(F.col("_payload"))))
    made = rows.withColumn("_r", F.explode(both))
    block = F.col("_r.block")
    return made.select(
        id_col, "_r.record_type", "_r.record_id", "refers_to", "_r.concurrent_to", "target_uri", "date", "_r.content_type", "source_headers", "source_digest", block.alias("block"), digest(block).alias("block_digest"), F.octet_length(block).cast("long").alias("n_bytes")
    )


def serialise(derived: DataFrame) -> DataFrame:
    """derived with a binary column `record`: the record as it stands in a WARC file."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    angle = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", angle("record_id")), line("WARC-Refers-To", angle("refers_to")), line("WARC-Concurrent-To", angle("concurrent_to")),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("date")), line("WARC-Block-Digest", F.col("block_digest")), line("WARC-Source-Digest", F.col("source_digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("n_bytes").cast("string")), F.lit(CRLF),
    )
    return derived.withColumn("record", F.encode(F.concat(head, F.col("block"), F.lit(CRLF * 2)), "UTF-8"))


def split_records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The records (headers by lower-case name, block) of a WARC file's bytes; what is left after a broken record is dropped."""
    import gzip

    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    out, at = [], 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            break
        lines = data[at:end].decode("utf-8", "replace").split(CRLF)[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers.get("content-length", "0") or 0)
        out.append((headers, data[end + 4 : end + 4 + size]))
        at = end + 4 + size
    return out


def parse(files: DataFrame, content_col: str = "content") -> DataFrame:
    """Response records of WARC files read by Spark's binaryFile source, as derive() takes them, with the record id as page_id."""
    schema = "page_id string, record_id string, target_uri string, date string, http_headers string, payload string, payload_digest string"

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                for headers, block in split_records(data or b""):
                    if headers.get("warc-type") == "response":
                        head, _, body = block.partition(b"\r\n\r\n")
                        own = headers.get("warc-record-id", "").strip("<>")
                        rows.append((own, own, headers.get("warc-target-uri", ""), headers.get("warc-date", ""), head.decode("utf-8", "replace") + CRLF, body.decode("utf-8", "replace"), headers.get("warc-payload-digest", "")))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(7)], names=[x.split()[0] for x in schema.split(", ")])

    return files.select(content_col).mapInArrow(run, schema)
