"""BPE encoding and decoding through a table of distinct words.

For tokenizer files whose pre-tokenizer never joins text across ASCII white
space and whose decoder joins token strings with a space (``decoder`` null).

* ``_split`` cuts texts at ASCII white space in blocks of a bounded number of
  words and numbers a block's distinct words by first appearance. A block gives
  its documents as packed word numbers, and its distinct words packed by word
  hash.
* The packed words are shuffled by word hash, so equal words of all blocks
  meet in one task, which encodes each distinct word once.
* The ids return to the blocks and are joined to the documents' positions by
  word number; token strings come from the id-to-piece table, whose size is
  that of the tokenizer's vocabulary.

Texts are never shuffled, nor a row per word. Blocks are numbered by input
partition, and the input is read twice; it must give the same partitions both
times (a written table does). Each block carries a checksum of its words, and
the job fails if the two readings differ.

Defined cases: null or empty text has no ids and decodes to the empty string;
repeated rows and ids are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import text_buffers
from gavel.llm.packing import tokenizer_json

BLOCK_WORDS = 2_000_000
PARTS_A_BLOCK = 16  # at least: packets of a block's distinct words


def _split(docs: DataFrame, parts: int, words: bool) -> DataFrame:
    """Per document (block, doc_id, codes, no, check) or, with ``words``, per
    block and word hash (block, part, codes, words, check); check is the
    checksum of the block's texts so far."""

    def close(block, known, check):
        names = list(known)
        at = np.fromiter((zlib.crc32(w) % parts for w in names), np.int64, len(names))
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(parts + 1))
        rows = [[], [], [], [], []]
        for p in range(parts):
            codes = order[ends[p]:ends[p + 1]]
            if len(codes):
                for column, x in zip(rows, (block, p, zlib.compress(np.diff(codes, prepend=0).astype("<u4").tobytes(), 1),
                                            zlib.compress(b" ".join([names[c] for c in codes]), 1), check)):
                    column.append(x)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary()),
             pa.array(rows[3], pa.binary()), pa.array(rows[4], pa.int64())], names=["block", "part", "codes", "words", "check"])

    def run(batches):
        seq, known, total, block, check, no = 0, defaultdict(), 0, 0, 0, 0
        known.default_factory = known.__len__
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            data = data.tobytes()
            rows = [[], [], [], []]
            for i in range(batch.num_rows):
                if total >= BLOCK_WORDS:
                    if words:
                        yield close(block, known, check)
                    seq, total, known, check, no = seq + 1, 0, defaultdict(), 0, 0
                    known.default_factory = known.__len__
                block = (batch.column(2)[i].as_py() << 24) + seq
                found = data[offsets[i]:offsets[i + 1]]
                check, found, no = zlib.crc32(found, check), found.split(), no + 1
                codes = list(map(known.__getitem__, found))
                total += len(codes)
                if not words:
                    codes = np.array(codes, np.uint32)
                    planes = np.concatenate([(codes & 0xFFFF).astype("<u2").view(np.uint8), (codes >> 16).astype("<u2").view(np.uint8)])
                    for column, x in zip(rows, (block, zlib.compress(planes.tobytes(), 1), no, check)):
                        column.append(x)
            if not words and batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.int64()), batch.column(0), pa.array(rows[1], pa.binary()),
                     pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64())],
                    names=["block", "doc_id", "codes", "no", "check"])
        if words and known:
            yield close(block, known, check)

    schema = "block long, part int, codes binary, words binary, check long" if words else (
        "block long, doc_id long, codes binary, no long, check long")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                       F.spark_partition_id().cast("long").alias("at")).mapInArrow(run, schema)


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row: ids as little-endian 32-bit words,
    as the tokenizer encodes the text without special tokens, and what it
    decodes them to."""
    spark = docs.sparkSession
    text = tokenizer_json(tokenizer)
    if json.loads(text)["decoder"] is not None:
        raise ValueError("the tokenizer file has a decoder of its own; pieces are not joined by a space")
    source = spark.sparkContext.broadcast(text)
    parts = max(PARTS_A_BLOCK, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def encode(batches):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model = Tokenizer.from_str(source.value)
        known: dict[bytes, bytes] = {}  # the distinct words of this task's share
        for batch in batches:
            out = []
            for packet in batch.column(2):
                found = zlib.decompress(packet.as_py()).split(b" ")
                new = list(dict.fromkeys(w for w in found if w not in known))
                for w, e in zip(new, model.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)):
                    known[w] = array("I", e.ids).tobytes()
                ids = [known[w] for w in found]
                sizes = np.fromiter((len(x) // 4 for x in ids), "<u4", len(ids))
                out.append(zlib.compress(sizes.tobytes() + b"".join(ids), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.binary())],
                                             names=["block", "codes", "check", "ids"])

    packets = _split(docs, parts, True).repartition(parts, "part").select("block", "codes", "words", "check")
    returned = packets.mapInArrow(encode, "block long, codes binary, check long, ids binary")
    pieces = spark.sparkContext.broadcast(_pieces(text))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        piece = pieces.value
        codes, ids, decoded = [], [], []
        for c, packet in zip(right.column("codes").to_pylist(), right.column("ids").to_pylist()):
            c = np.cumsum(np.frombuffer(zlib.decompress(c), "<u4").astype(np.int64))
            flat = np.frombuffer(zlib.decompress(packet), "<u4")
            ends = np.concatenate(([0], np.cumsum(flat[:len(c)].astype(np.int64)))) + len(c)
            raw, token = flat.tobytes(), [piece[i] for i in flat[len(c):].tolist()]
            codes.append(c)
            ids += [raw[4 * a:4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            decoded += [b"".join(token[a:b]) for a, b in zip((ends[:-1] - len(c)).tolist(), (ends[1:] - len(c)).tolist())]
        order = np.argsort(np.concatenate(codes)).tolist() if codes else []
        ids, decoded = [ids[i] for i in order], [decoded[i] for i in order]
        rows, texts = [], []
        read = left.column("check")[int(np.argmax(left.column("no").to_numpy()))].as_py() if left.num_rows else None
        if set(right.column("check").to_pylist()) - {read}:
            raise RuntimeError("the two readings of the input differ; write it to a table first")
        for packed in left.column("codes").to_pylist():
            planes = np.frombuffer(zlib.decompress(packed), "<u2").astype(np.int64)
            n = len(planes) // 2
            c = (planes[:n] | (planes[n:] << 16)).tolist()
            rows.append(b"".join([ids[i] for i in c]))
            texts.append(b"".join([decoded[i] for i in c])[:-1])
        return pa.table({"doc_id": left.column("doc_id"), "ids": pa.array(rows, pa.binary()),
                         "decoded": pa.array(texts, pa.binary()).cast(pa.string())})

    coded = _split(docs, parts, False)
    return coded.groupBy("block").cogroup(returned.groupBy("block")).applyInArrow(
        join, "doc_id long, ids binary, decoded string")


def _pieces(source: str) -> dict[int, bytes]:
    """The id-to-piece table; a piece ends with the separating space."""
    spec = json.loads(source)
    return ({i: f"{w} ".encode() for w, i in spec["model"]["vocab"].items()}
            | {t["id"]: f"{t['content']} ".encode() for t in spec.get("added_tokens", [])})
