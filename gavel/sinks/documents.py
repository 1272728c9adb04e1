"""One JSON document (SNK-5, SNK-8: array, mapping, or lines) written by many tasks.

A document is one file, but its members are cut into blocks of a few megabytes
by range-sorted tasks. The running sums of the block lengths give every block its exact
place, so a second pass writes all blocks into one file in parallel, each at
its own offset. The write is a Python data source with a two-phase commit: tasks
fill ``<path>.<attempt>`` and report their bytes, the commit checks that the
reports add up, closes the brackets and renames the file; a failed job removes it. A
repeated task writes the same bytes to the same place.

The file lies on a file system that driver and executors share and that can be
written at an offset (a mounted folder, not an object store).

Defined cases: an empty table gives ``[]``, ``{}`` or, as lines, one line end;
null fields are written as null; text beyond ASCII is escaped; rows that tie in
the order are sorted by their text; of equal keys of a mapping the last row
counts and stands at the first one's place.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from gavel.session import written

BLOCK = 4 << 20
SOURCE = "gavel_document"


def _frame(layout: str, indent: int | None) -> tuple[str, str, str]:
    """Opening, separator and closing of a layout, as the json module writes them."""
    if layout == "lines":
        return "", "\n", "\n"
    opening, closing = ("[", "]") if layout == "array" else ("{", "}")
    return (opening, ", ", closing) if indent is None else (opening + "\n", ",\n", "\n" + closing)


@dataclass
class Placed(WriterCommitMessage):
    length: int


class DocumentWriter(DataSourceArrowWriter):
    """Rows (at, bytes) into one file."""

    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.attempt = f"{self.path}.{options['attempt']}"
        self.size = int(options["size"])
        self.opening, self.closing = options["opening"].encode(), options["closing"].encode()

    def write(self, iterator):
        length = 0
        os.makedirs(os.path.dirname(self.attempt) or ".", exist_ok=True)
        fd = os.open(self.attempt, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            for batch in iterator:
                for at, data in zip(batch.column("at").to_pylist(), batch.column("bytes")):
                    view = memoryview(data.as_buffer())
                    done = 0
                    while done < len(view):
                        done += os.pwrite(fd, view[done:], at + done)
                    length += done
            os.fsync(fd)
        finally:
            os.close(fd)
        return Placed(length)

    def commit(self, messages):
        placed = sum(m.length for m in messages if m is not None)
        if placed != self.size:
            raise RuntimeError(f"{self.path}: {placed} bytes of {self.size} were written")
        os.makedirs(os.path.dirname(self.attempt) or ".", exist_ok=True)
        fd = os.open(self.attempt, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            os.pwrite(fd, self.opening, 0)
            os.pwrite(fd, self.closing, len(self.opening) + self.size)
            os.ftruncate(fd, len(self.opening) + self.size + len(self.closing))
            os.fsync(fd)
        finally:
            os.close(fd)
        os.replace(self.attempt, self.path)

    def abort(self, messages):
        if os.path.exists(self.attempt):
            os.remove(self.attempt)


class DocumentSource(DataSource):
    @classmethod
    def name(cls):
        return SOURCE

    def writer(self, schema, overwrite):
        return DocumentWriter(dict(self.options))


def _blocks(rows: DataFrame, layout: str, indent: int | None, key: str | None, block: int) -> DataFrame:
    """(chunk, no, bytes): members of each partition, every one after a separator."""
    opening, separator, closing = _frame(layout, indent)

    def packed(batches):
        chunk, no, held, size = None, 0, [], 0

        def emit():
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([no], pa.int32()),
                                               pa.array(["".join(held).encode()], pa.large_binary())], names=["chunk", "no", "bytes"])

        for batch in batches:
            for row in batch.to_pylist():
                chunk, record = row["chunk"], row["record"]
                if layout == "lines":
                    text = json.dumps(record, default=str)
                else:
                    one = [record] if key is None else {str(row["key"]): record}
                    text = json.dumps(one, indent=indent, default=str)[len(opening):-len(closing)]
                held.append(separator + text)
                size += len(text)
                if size >= block:
                    yield emit()
                    no, held, size = no + 1, [], 0
        if held:
            yield emit()

    return rows.mapInArrow(packed, "chunk int, no int, bytes binary")


def write_document(df: DataFrame, path: str, order: list[str], layout: str = "array", key: str | None = None,
                   indent: int | None = None, block: int = BLOCK) -> None:
    """``df`` as one JSON file at ``path``: an ``array`` of its rows, a ``mapping``
    of ``key`` to the row, or ``lines``. Rows stand in the given order; order
    columns that start with ``_`` are not written."""
    fields = [c for c in df.columns if not (c in order and c.startswith("_"))]
    record = F.struct(*[F.col(c) for c in fields])
    rows = df.select(F.struct(*[F.col(c) for c in order]).alias("place"), record.alias("record"),
                     (F.col(key).cast("string") if key else F.lit("")).alias("key"))
    if layout == "mapping":
        rows = rows.groupBy("key").agg(F.max_by("record", F.struct("place", F.to_json("record"))).alias("record"),
                                       F.min("place").alias("place"))
    tie = F.xxhash64(F.to_json("record"))
    rows = rows.repartitionByRange("place", tie).sortWithinPartitions("place", F.to_json("record"))
    blocks = written(_blocks(rows.select(F.spark_partition_id().alias("chunk"), "key", "record"), layout, indent,
                             key if layout == "mapping" else None, block), "document-blocks")
    sizes = blocks.select("chunk", "no", F.octet_length("bytes").cast("long").alias("n"))
    chunks = sizes.groupBy("chunk").agg(F.sum("n").alias("n"))  # a row a partition
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("chunk").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("chunk", "no", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("start")).join(chunks, "chunk")
    opening, separator, closing = _frame(layout, indent)
    total = sizes.agg(F.sum("n").alias("n")).first()["n"]
    if total is None and layout != "lines":  # as the json module writes nothing at all
        opening, closing = opening.strip(), closing.strip()
    skip = len(separator)  # the first member has no separator
    start = F.col("base") + F.col("start")
    placed = blocks.join(starts, ["chunk", "no"]).select(
        F.when(start == 0, F.lit(len(opening))).otherwise(start + (len(opening) - skip)).cast("long").alias("at"),
        F.when(start == 0, F.expr(f"substring(bytes, {skip + 1})")).otherwise(F.col("bytes")).alias("bytes"))
    df.sparkSession.dataSource.register(DocumentSource)
    (placed.write.format(SOURCE).mode("append").option("path", path).option("attempt", uuid.uuid4().hex)
     .option("size", (total or skip) - skip).option("opening", opening).option("closing", closing).save())


def write_selection(best: DataFrame, directory: str) -> None:
    """SNK-5: ``preds.json`` (array of id and patch) and ``selection_report.jsonl``
    (all fields) by instance id, both off one computed frame."""
    once = written(best, "selection")
    write_document(once.select("instance_id", F.coalesce("patch", F.lit("")).alias("model_patch")),
                   f"{directory}/preds.json", ["instance_id"], indent=2)
    write_document(once, f"{directory}/selection_report.jsonl", ["instance_id"], "lines")
