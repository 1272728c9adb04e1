"""WARC archives: segmented, chunk-framed records written and read by Spark.

Writing: every page becomes an HTTP response whose body is framed in chunks
(``Transfer-Encoding: chunked``). Chunk ends fall inside every ``WARC/1.1`` of a
body, with or without its line end, so no block holds it and neither a chunk's
nor a record's CRLF completes the version line; a url that ends with it has its
last byte percent-encoded. So ``WARC/1.1`` CRLF only ever starts a record and
Spark's text reader splits archives at it. A record's id names its page and a
digest of url and body. A block over ``segment`` bytes is cut into a
first record (WARC-Segment-Number 1) and continuation records that name their
origin; the last has WARC-Segment-Total-Length. A page whose body equals that
of a page with a smaller id becomes a ``revisit`` that names it.

Reading: records are split and checked against Content-Length; continuation
records are grouped by origin id, ordered by segment number, joined, and the
total length is verified; the chunk framing is decoded. Whole records take no
part in the grouping. A record that fails a check fails the job with its id.

Only Spark's own text reader and writer touch the files. Spark expressions do
all work but the chunk framing, which runs over Arrow batches.

Defined cases: a null page is an empty body; bodies under ``least`` bytes are
all responses; rows that are equal in page_id, url and body share the record id
and stay as many, others of one page_id (or of none) are records of their own;
rows without a page_id are never revisits; a null url is written as empty; other
columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1\r\n"
CHUNK = 4096
SEGMENT = 16384
ROWS_A_FILE = 20000
EPOCH = "2024-01-01T00:00:00Z"


def _frame(batches):
    """Body bytes to chunk framing; a chunk ends inside each ``WARC/1.1``."""
    mark = re.compile(re.escape(VERSION.strip().encode()))
    for batch in batches:
        out = []
        for body in batch.column(1).to_pylist():
            ends = {m.start() + 2 for m in mark.finditer(body)} | {*range(CHUNK, len(body), CHUNK), len(body)} - {0}
            parts, at = [], 0
            for end in sorted(ends):
                parts += [b"%x\r\n" % (end - at), body[at:end], b"\r\n"]
                at = end
            out.append(b"".join([*parts, b"0\r\n\r\n"]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["h", "block"])


def _unframe(batches):
    """Chunk framing back to body bytes; null where the framing is broken."""
    for batch in batches:
        out = []
        for block in batch.column(1).to_pylist():
            if block is None:
                out.append(None)
                continue
            parts, at = [], 0
            while True:
                line = block.find(b"\r\n", at)
                size = block[at:line].split(b";")[0].strip()
                if line < 0 or not re.fullmatch(rb"[0-9A-Fa-f]+", size):
                    parts = None
                    break
                n, at = int(size, 16), line + 2
                if not n:
                    break
                if block[at + n:at + n + 2] != b"\r\n":
                    parts = None
                    break
                parts.append(block[at:at + n])
                at += n + 2
            out.append(None if parts is None else b"".join(parts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["h", "body"])


def record_id(page: Column, url: Column, digest: Column, *more: Column) -> Column:
    row = F.substring(F.sha2(F.concat(digest, F.lit(" "), url).cast("binary"), 256), 1, 32)
    after = [x for c in more for x in (F.lit(":"), c.cast("string"))]
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), row, *after, F.lit(">"))


def _page(record: Column) -> Column:
    """A record id of ``record_id`` without the row's digest; others as they are."""
    return F.regexp_replace(record, "^(<urn:page:.*):[0-9a-f]{32}>$", "$1>")


def _header(*lines) -> Column:
    return F.concat(F.lit(VERSION), *[F.concat(F.lit(k + ": "), v, F.lit("\r\n")) for k, v in lines], F.lit("\r\n"))


def plan_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, body, digest and, for revisits, the response's page_id and url."""
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"),
                        F.coalesce("html", F.lit("")).cast("binary").alias("body"))
    base = base.withColumn("digest", F.sha2("body", 256))
    first = (base.filter(F.octet_length("body") >= least).groupBy("digest").agg(
        F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"),
        F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    return base.join(first, "digest", "left").withColumn(
        "refers_to", F.when(F.col("first.page_id") != F.col("page_id"), F.col("first"))).drop("first")


def write_archive(pages: DataFrame, path: str, segment: int = SEGMENT, rows_a_file: int = ROWS_A_FILE) -> None:
    """Write ``pages`` as gzipped WARC files under ``path``."""
    planned = plan_records(pages)
    kept = planned.columns
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                          "Transfer-Encoding: chunked\r\n\r\n")).cast("binary")
    responses = planned.filter("refers_to is null").select(
        F.struct(*[c for c in kept if c != "body"]).alias("h"), "body")
    schema = responses.schema["h"].dataType.simpleString()
    framed = responses.mapInArrow(_frame, f"h {schema}, block binary").select("h.*", F.concat(head, "block").alias("block"))
    total = F.octet_length("block")
    count = F.greatest(F.lit(1), F.ceil(total / F.lit(segment))).cast("int")
    # the parts are cut inside the row, from a block that is read once: an exploded row carries its own part, not the block
    parts = F.expr("transform(array(block), b -> transform(sequence(1, count), no -> "
                   f"struct(no, substring(b, (no - 1) * {segment} + 1, {segment}) AS part)))[0]")
    cut = framed.withColumn("total", total).withColumn("count", count).withColumn("cut", F.explode(parts)).select(
        *[c for c in kept if c != "body"], "total", "count", "cut.no", "cut.part")
    row = F.col("page_id"), F.col("url"), F.col("digest")
    rid = record_id(*row)
    uri = F.regexp_replace(F.regexp_replace("url", r"[\x00-\x20]", "%20"), r"WARC/1\.1\z", "WARC/1.%31")
    common = [("WARC-Date", F.lit(EPOCH)), ("WARC-Target-URI", uri)]
    size = ("Content-Length", F.octet_length("part").cast("string"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest"))
    whole = _header(("WARC-Type", F.lit("response")), ("WARC-Record-ID", rid), *common, digest,
                    ("Content-Type", F.lit("application/http; msgtype=response")), size)
    opening = _header(("WARC-Type", F.lit("response")), ("WARC-Record-ID", rid), *common, digest,
                      ("WARC-Segment-Number", F.lit("1")),
                      ("Content-Type", F.lit("application/http; msgtype=response")), size)
    more = [("WARC-Type", F.lit("continuation")),
            ("WARC-Record-ID", record_id(*row, F.col("no"))),
            *common, ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", F.col("no").cast("string"))]
    last = _header(*more, ("WARC-Segment-Total-Length", F.col("total").cast("string")), size)
    header = F.when(F.col("count") == 1, whole).when(F.col("no") == 1, opening).when(
        F.col("no") == F.col("count"), last).otherwise(_header(*more, size))
    revisit = planned.filter("refers_to is not null").select(_header(
        ("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", rid), *common, digest,
        ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", record_id(F.col("refers_to.page_id"), F.col("refers_to.url"), F.col("digest"))), ("Content-Length", F.lit("0"))).cast("binary").alias("r"))
    records = cut.select(F.concat(header.cast("binary"), "part").alias("r")).unionByName(revisit)
    # the text writer's line end is the last byte of the CRLF CRLF that ends a record
    records.select(F.concat("r", F.lit("\r\n\r").cast("binary")).cast("string").alias("value")).write.option(
        "lineSep", "\n").option("maxRecordsPerFile", rows_a_file).option("compression", "gzip").text(path)


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1), F.lit(""))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record as written: type, ids, segment fields, block."""
    raw = spark.read.option("lineSep", VERSION).text(path).filter(F.octet_length("value") > 0)
    cut = raw.select(F.col("value").cast("binary").alias("bytes"), F.substring_index("value", "\r\n\r\n", 1).alias("head"))
    cut = cut.withColumn("at", F.octet_length("head") + 1)
    rows = cut.select(
        _field("WARC-Type").alias("type"), _field("WARC-Record-ID").alias("id"), _field("WARC-Target-URI").alias("uri"),
        _field("WARC-Payload-Digest").alias("digest"), _field("WARC-Refers-To").alias("refers_to"),
        _field("WARC-Segment-Origin-ID").alias("origin"), _field("WARC-Segment-Number").cast("int").alias("no"),
        _field("WARC-Segment-Total-Length").cast("long").alias("total"), _field("Content-Length").cast("long").alias("length"),
        F.expr("substring(bytes, at + 4)").alias("rest"))
    right = (F.octet_length("rest") == F.col("length") + 4) & (
        F.expr("substring(rest, cast(length as int) + 1, 4)") == F.lit("\r\n\r\n").cast("binary"))
    block = F.when(right, F.expr("substring(rest, 1, cast(length as int))")).otherwise(
        F.raise_error(F.concat(F.lit("record length does not match its header: "), F.coalesce("id", F.lit("?")))))
    return rows.withColumn("block", block).drop("rest")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, uri, digest, refers_to, body): whole records, bodies decoded;
    id and refers_to name the pages; a revisit's body is null."""
    records = read_records(spark, path)
    fields = ["id", "type", "uri", "digest", "refers_to"]
    whole = records.filter("no is null").select(*fields, "block")
    parts = records.filter("no is not null").select(
        F.coalesce("origin", "id").alias("whole_id"), "no", "total", "block", F.struct(*fields).alias("h"))
    joined = parts.groupBy("whole_id").agg(
        F.count_if(F.col("no") == 1).alias("copies"),
        F.array_sort(F.collect_set(F.struct("no", "block"))).alias("p"), F.max("total").alias("total"),
        F.max(F.when(F.col("no") == 1, F.col("h"))).alias("h"))
    # joined once; a cast between bytes and text changes no byte
    block = F.array_join(F.transform("p", lambda x: x["block"].cast("string")), "").cast("binary")
    joined = joined.withColumn("block", block)
    right = (F.octet_length("block") == F.col("total")) & F.col("h").isNotNull() & (
        F.element_at("p", -1)["no"] == F.size("p"))
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("copies").cast("int")))))
    joined = joined.select("h.*", F.when(right, F.col("block")).otherwise(F.raise_error(F.concat(
        F.lit("segments do not add up to the total length: "), F.coalesce("whole_id", F.lit("?"))))).alias("block"))
    every = whole.unionByName(joined)
    head = F.substring_index(F.col("block").cast("string"), "\r\n\r\n", 1)
    every = every.withColumn("at", F.octet_length(head) + 1).withColumn(
        "chunked", head.rlike(r"(?i)\ntransfer-encoding:[ \t]*chunked")).withColumn(
        "body", F.when(F.col("type") == "response", F.expr("substring(block, at + 4)")))
    framed = every.filter("chunked").select(F.struct(*fields).alias("h"), "body")
    schema = framed.schema["h"].dataType.simpleString()
    decoded = framed.mapInArrow(_unframe, f"h {schema}, body binary").select("h.*", "body")
    decoded = decoded.withColumn("body", F.coalesce("body", F.raise_error(F.concat(
        F.lit("broken chunk framing: "), F.col("id"))).cast("binary")))
    return decoded.unionByName(every.filter("not chunked").select(*fields, "body")).withColumns(
        {c: _page(F.col(c)) for c in ("id", "refers_to")})
