"""Derived WARC records: linked metadata and plain-text conversions of responses.

Records are rows: record_id, record_type, target_uri, date, content_type, refers_to, payload_digest,
headers (an array of name and value, as names may repeat), block. The writer and reader turn them into
WARC/1.1 files and back.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shelfspark.llm.core import narrow

VERSION = "WARC/1.1"
#: Capture time of rows that carry none.
EPOCH = "1970-01-01T00:00:00Z"
COLUMNS = ("record_id", "record_type", "target_uri", "date", "content_type", "refers_to", "payload_digest", "headers", "block")


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def uuid_of(*parts: Column) -> Column:
    """A record id from its content, so that a repeated task writes the same one."""
    h = F.sha2(F.concat_ws("\u001f", *parts), 256)
    cut = [F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


@F.pandas_udf(StringType())
def _decoded(texts: pd.Series) -> pd.Series:
    return texts.map(entities.unescape, na_action="ignore")


def plain_text(html: Column) -> Column:
    """Text of a page: no comments, scripts, styles or tags, block ends as line ends, entities decoded, white space folded."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?is)<(script|style|noscript)[^a-z][^>]*>.*?</(script|style|noscript)>|(?is)<(script|style|noscript)>.*?</(script|style|noscript)>", " ")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/title)[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    t = F.replace(_decoded(t), F.lit("\u00a0"), F.lit(" "))  # all names and numbers of HTML5, in one pass
    t = F.regexp_replace(t, "[ \\t\\r\\f\\x0B]+", " ")
    t = F.regexp_replace(t, " ?\\n[ \\n]*", "\n")
    return F.regexp_replace(t, "^[ \\n]+|[ \\n]+$", "")


def headers_of(*pairs: tuple[str, Column]) -> Column:
    return F.array(*(F.struct(F.lit(name).alias("name"), value.cast("string").alias("value")) for name, value in pairs))


def responses(pages: DataFrame, date: str = EPOCH) -> DataFrame:
    """Response records of (page_id, url, html). Null: empty; a null id or repeated rows give a record each.

    A column `date` is the time of capture, where it has one; `date` stands for it elsewhere. The page's id
    and row keep a record apart from those of other pages with the same content; equal rows have equal ids.
    """
    dated = "date" in pages.columns
    own = narrow(pages, "page_id", "url", "html", *(["date"] if dated else [])).select(
        F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"),
        (F.coalesce(F.col("date").cast("string"), F.lit(date)) if dated else F.lit(date)).alias("date"),
    )
    mime, size = F.lit("text/html; charset=utf-8"), F.octet_length("html").cast("string")
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: "), mime, F.lit("\r\nContent-Length: "), size, F.lit("\r\n\r\n"), F.col("html"))
    return own.select(
        "page_id",
        uuid_of(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("url"), digest(F.col("html"))).alias("record_id"),
        F.lit("response").alias("record_type"), F.col("url").alias("target_uri"), "date",
        F.lit("application/http; msgtype=response").alias("content_type"), F.lit(None).cast("string").alias("refers_to"), digest(F.col("html")).alias("payload_digest"),
        headers_of(("Content-Type", mime), ("Content-Length", size)).alias("headers"),
        block.alias("block"),
    )


def derive(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response; both refer to it and name its URI and date.

    The metadata block gives the source's headers in their order, repeated ones too, its payload digest,
    length and title; the conversion block is the page's text. Block digests are of the new blocks. Other
    record types give nothing. Further columns of the input stay, whatever their names.
    """
    at = {c: records.columns.index(c) for c in COLUMNS}
    extra = [(i, c) for i, c in enumerate(records.columns) if i not in at.values()]
    own = records.toDF(*(f"_{i}" for i in range(len(records.columns))))
    own = own.select(*(f"_{i}" for i, _ in extra), F.struct(*(F.col(f"_{i}").alias(c) for c, i in at.items())).alias("_src")).where("_src.record_type = 'response'")
    payload = F.when(F.instr("_src.block", "\r\n\r\n") > 0, F.expr("substring(_src.block, instr(_src.block, '\\r\\n\\r\\n') + 4)")).otherwise(F.lit(""))
    # title and text are decoded in one pass, with a character between them that no title holds
    title = F.replace(F.regexp_extract("_payload", r"(?is)<title[^>]*>([^<]*)", 1), F.lit("\x1f"), F.lit(" "))
    both = plain_text(F.concat(title, F.lit("\x1f"), F.col("_payload")))
    made = own.withColumn("_payload", payload).withColumn("_both", both).withColumns({
        "_title": F.trim(F.replace(F.substring_index("_both", "\x1f", 1), F.lit("\n"), F.lit(" "))),
        "_text": F.regexp_replace(F.expr("substring(_both, instr(_both, '\x1f') + 1)"), r"^[ \n]+", ""),
    })
    lines = F.transform("_src.headers", lambda e: F.concat(F.lit("source-header: "), one_line(e["name"]), F.lit(": "), one_line(F.coalesce(e["value"], F.lit(""))), F.lit("\r\n")))
    info = F.concat(
        F.coalesce(F.concat_ws("", lines), F.lit("")), F.lit("source-payload-digest: "), F.coalesce("_src.payload_digest", F.lit("")), F.lit("\r\nsource-length: "), F.octet_length("_payload").cast("string"),
        F.lit("\r\ntitle: "), F.col("_title"), F.lit("\r\ntext-length: "), F.length("_text").cast("string"), F.lit("\r\n"),
    )
    record = lambda kind, mime, block: F.struct(uuid_of(F.lit(kind), F.col("_src.record_id")).alias("record_id"), F.lit(kind).alias("record_type"), F.lit(mime).alias("content_type"), block.alias("block"))
    both = F.explode(F.array(record("metadata", "application/warc-fields", info), record("conversion", "text/plain; charset=utf-8", F.col("_text")))).alias("_new")
    # of the source only what the new records name goes with them, not its block
    out = made.select(*(f"_{i}" for i, _ in extra), *(F.col(f"_src.{c}").alias(f"_src_{c}") for c in ("record_id", "target_uri", "date", "payload_digest")), both)
    headers = headers_of(("WARC-Refers-To-Target-URI", F.col("_src_target_uri")), ("WARC-Refers-To-Date", F.col("_src_date")), ("WARC-Source-Payload-Digest", F.coalesce("_src_payload_digest", F.lit(""))))
    return out.select(
        *(F.col(f"_{i}").alias(c) for i, c in extra), F.col("_new.record_id").alias("record_id"), F.col("_new.record_type").alias("record_type"), F.col("_src_target_uri").alias("target_uri"), F.col("_src_date").alias("date"),
        F.col("_new.content_type").alias("content_type"), F.col("_src_record_id").alias("refers_to"), digest(F.col("_new.block")).alias("payload_digest"), headers.alias("headers"), F.col("_new.block").alias("block"),
    )


def one_line(c: Column) -> Column:
    """A header's name or value may hold no line ends or other control characters: they are written by their numbers."""
    hard = F.regexp_extract_all(c, F.lit("([\\x00-\\x08\\x0A-\\x1F\\x7F])"), F.lit(1))
    coded = F.aggregate(F.array_distinct(hard), c, lambda done, x: F.replace(done, x, F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(x)), 2, "0"))))
    return F.when(F.rlike(c, F.lit("[\\x00-\\x08\\x0A-\\x1F\\x7F]")), coded).otherwise(c)


def serialize(records: DataFrame) -> DataFrame:
    """One string a record: the WARC header, an empty line and the block. Ends of records are the writer's."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), one_line(value), F.lit("\r\n"))).otherwise(F.lit(""))
    named = F.transform(F.when(F.col("record_type") != "response", F.col("headers")), lambda e: F.concat(one_line(e["name"]), F.lit(": "), one_line(F.coalesce(e["value"], F.lit(""))), F.lit("\r\n")))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To", F.col("refers_to")), line("WARC-Payload-Digest", F.col("payload_digest")), line("WARC-Block-Digest", digest(F.col("block"))), F.coalesce(F.concat_ws("", named), F.lit("")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"),
    )
    return records.select(F.concat(head, F.col("block")).alias("value"))


def write(records: DataFrame, path: str, mode: str = "errorifexists", records_a_file: int = 20_000) -> None:
    """WARC files of at most `records_a_file` records, by Spark's text sink: a task that is repeated leaves no half file."""
    serialize(records).write.mode(mode).option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_a_file).text(path)


#: Header fields that have columns of their own; `read` gives the others as `headers`.
FIELDS = {
    "WARC-Record-ID": "record_id", "WARC-Type": "record_type", "WARC-Target-URI": "target_uri", "WARC-Date": "date", "Content-Type": "content_type",
    "WARC-Refers-To": "refers_to", "WARC-Payload-Digest": "payload_digest", "WARC-Block-Digest": "block_digest",
}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    head = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)
    names = [*FIELDS.values(), "headers", "block"]
    types = [pa.string()] * len(FIELDS) + [pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.string()]
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            at, rows = 0, []
            while m := head.match(raw, at):
                pairs = [x.decode("utf-8", "replace").partition(":")[::2] for x in m[1].split(b"\r\n")]
                pairs = [(k.strip(), v.strip()) for k, v in pairs]
                h = dict(reversed(pairs))  # of a repeated field the first
                end = m.end() + int(h.get("Content-Length", 0))
                more = [{"name": k, "value": v} for k, v in pairs if k not in FIELDS and k != "Content-Length"]
                rows.append((*(h.get(k) for k in FIELDS), more, raw[m.end() : end].decode("utf-8", "replace")))
                at = end + 4
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of uncompressed WARC files, by their lengths; a file is read by one task, so `write` bounds its records."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,warc}").load(path).select("content")
    return raw.mapInArrow(_parse, ", ".join(f"{c} string" for c in FIELDS.values()) + ", headers array<struct<name:string,value:string>>, block string")
