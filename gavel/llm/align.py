"""Alignment of two tokenizers over the same texts.

Side A is a byte-level BPE file over space + text, side B a sentence-piece model
over the text (the model adds the space). Special-token strings inside texts are
plain text.

* One Arrow pass tokenizes both sides and lays the tokens of a batch out as byte
  ranges. ``pandas.merge_asof``, keyed by document, gives each token start the
  other side's covering token; the union of both directions are the overlaps
  (links), because an overlap begins at one of its two starts. Places where both
  sides end cut the tokens into groups.
* Corpus-wide counts: documents are gathered in blocks of about ``BLOCK`` links.
  A block lists its distinct id pairs once with their counts, and each of its
  documents keeps only positions in that list. The pass is written once; pair
  counts of all blocks are added by (a, b) with map-side combine, the highest of
  each B id is their maximum, and both return to the blocks by a join of the
  listed pairs. A pair is one row per block however often it occurs, so a
  frequent pair is no hot key, and no table is broadcast by this module.
* Blocks meet their documents again by block number, in one Arrow cogroup.

Memory: a batch of about ``CHUNK`` bytes of text and a block's links; a longer
document is a batch and a block of its own.

``alignments`` gives the real output, the groups of every document as nested id
lists. ``measured`` gives the counts and a digest of the same groups written as
``a1,a2|b1;a3|b2,b3``.

Defined cases: null and empty texts, and texts whose tokens do not give back
space + text byte by byte (the model normalises some characters), have no
tokens: zeros, no groups, an empty digest column; repeated rows and ids are
separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import materialize
from gavel.llm.packing import ByteBpe, tokenizer_json

CHUNK = 1 << 19
BLOCK = 2_000_000
SHIFT = 32  # pairs as a << SHIFT | b

GROUPS = "array<struct<a:array<int>,b:array<int>>>"
MEASURED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
PASS_SCHEMA = MEASURED + ", block long, places binary, a array<int>, b array<int>, n array<long>"


def _spans(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start of each piece, length of each piece)."""
    length = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(length) - length, length


def _gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pool's ranges one after the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(start - (ends - length), length) + np.arange(total)]


class Aligner:
    """Tokens, groups and links of batches of texts."""

    def __init__(self, source_a: str, model_b: bytes):
        import sentencepiece

        self.a = ByteBpe(source_a, plain=True)
        pieces = ByteBpe.pieces(json.loads(source_a))
        self.bytes_a = _spans([pieces.get(i, b"") for i in range(max(pieces) + 1)])
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        self.bytes_b = _spans([
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))])

    def tokens(self, texts: list[str | None]):
        """(docs, ids, starts, ends) of each side, over the texts that both give
        back; starts count bytes through the batch."""
        whole = [(" " + t).encode() if t else b"" for t in texts]
        size = np.fromiter(map(len, whole), np.int64, len(whole))
        data, base = np.frombuffer(b"".join(whole), np.uint8), np.cumsum(size) - size
        some = [i for i, t in enumerate(texts) if t]
        sides = []
        for lists, (pool, start, length) in (
                ([self.a.encode(" " + texts[i]) for i in some], self.bytes_a),
                (self.b.encode([texts[i] for i in some], num_threads=1) if some else [], self.bytes_b)):
            count = np.zeros(len(texts), np.int64)
            count[some] = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.fromiter((t for one in lists for t in one), np.int64, int(count.sum()))
            docs, n = np.repeat(np.arange(len(texts)), count), length[ids]
            written = np.bincount(docs, n, len(texts)).astype(np.int64)
            sides.append((docs, ids, n, written, _gather(pool, start[ids], n)))
        good = size > 0
        for docs, _, _, written, out in sides:
            good &= written == size
            same = _gather(out, (np.cumsum(written) - written)[good], size[good]) == _gather(data, base[good], size[good])
            differs = np.unique(np.repeat(np.flatnonzero(good), size[good])[~same])
            good[differs] = False
        out = []
        for docs, ids, n, *_ in sides:
            keep = good[docs]
            docs, ids, n = docs[keep], ids[keep], n[keep]
            before = np.cumsum(n) - n
            count = np.bincount(docs, minlength=len(texts))
            first = np.concatenate(([0], np.cumsum(count)))[:-1]
            local = before - np.repeat(before[first[count > 0]], count[count > 0]) if len(ids) else before
            out.append((docs, ids, base[docs] + local, base[docs] + local + n))
        return out

    def links(self, a, b) -> tuple[np.ndarray, np.ndarray]:
        """Rows of A and rows of B that overlap, in the order of the text."""
        frames = [pd.DataFrame({"doc": docs, "at": starts, "row": np.arange(len(ids))}) for docs, ids, starts, _ in (a, b)]
        covers = [pd.merge_asof(x, y.rename(columns={"row": "other"}).assign(start=y["at"]), on="at", by="doc")
                  for x, y in (frames, frames[::-1])]
        late = covers[1][covers[1]["start"] < covers[1]["at"]]  # equal starts are there already
        rows_a = np.concatenate((covers[0]["row"], late["other"])).astype(np.int64)
        rows_b = np.concatenate((covers[0]["other"], late["row"])).astype(np.int64)
        order = np.lexsort((rows_b, rows_a))
        return rows_a[order], rows_b[order]

    @staticmethod
    def groups(a, b) -> tuple[np.ndarray, np.ndarray]:
        """The group of each token, counted through the batch."""
        out = []
        for (_, _, _, ends), (_, _, _, others) in ((a, b), (b, a)):
            last = np.isin(ends, others, assume_unique=True)
            out.append(np.cumsum(last) - last)
        return out[0], out[1]

    _written = None

    def written(self, a, b, n_docs: int) -> list[bytes]:
        """Each document's groups as text."""
        if self._written is None:
            most = max(len(self.bytes_a[1]), len(self.bytes_b[1]))
            self._written = _spans([str(i).encode() + b"," for i in range(most)])
        pool, start, length = self._written
        ga, gb = self.groups(a, b)
        n = len(ga) + len(gb)
        ids, docs, mark = np.empty(n, np.int64), np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        at_a = np.arange(len(ga)) + np.searchsorted(gb, ga)  # all of B's earlier groups stand before
        at_b = np.arange(len(gb)) + np.searchsorted(ga, gb, side="right")
        for at, group, side, sign in ((at_a, ga, a, "|"), (at_b, gb, b, ";")):
            ids[at], docs[at] = side[1], side[0]
            if len(group):
                mark[at[np.append(group[1:] != group[:-1], True)]] = ord(sign)
        text, ends = _gather(pool, start[ids], length[ids]), np.cumsum(length[ids])
        text[ends - 1] = mark
        size = np.bincount(docs, length[ids], n_docs).astype(np.int64)
        stop = np.cumsum(size)
        data = text.tobytes()
        return [data[e - s:e - 1] if s else b"" for s, e in zip(size, stop)]


def _chunks(batches):
    """(doc_ids, texts) of about ``CHUNK`` bytes, one document at least."""
    for batch in batches:
        keys, texts, size, lo = batch.column(0), [], 0, 0
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py()
            texts.append(text)
            size += len(text or "")
            if size >= CHUNK or i + 1 == batch.num_rows:
                yield keys.slice(lo, i + 1 - lo), texts
                texts, size, lo = [], 0, i + 1


def _sides(docs: DataFrame, path_a: str, path_b: str):
    """The two columns that are read, and what makes an aligner in a task."""
    context = docs.sparkSession.sparkContext
    with open(path_b, "rb") as f:
        shipped = context.broadcast((tokenizer_json(path_a), f.read()))  # two vocabulary files
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), lambda: Aligner(*shipped.value)


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, groups): the smallest runs of A and B ids that cover the same bytes."""
    rows, make = _sides(docs, path_a, path_b)

    def run(batches):
        aligner = make()
        for keys, texts in _chunks(batches):
            a, b = aligner.tokens(texts)
            found = [[] if not w else [{"a": [int(i) for i in x.split(b",")], "b": [int(i) for i in y.split(b",")]}
                                       for x, y in (g.split(b"|") for g in w.split(b";"))]
                     for w in aligner.written(a, b, len(texts))]
            kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([keys, pa.array(found, kind)], names=["doc_id", "groups"])

    return rows.mapInArrow(run, f"doc_id long, groups {GROUPS}")


def _aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of documents (block, places) and of blocks (block, a, b, n)."""
    rows, make = _sides(docs, path_a, path_b)
    names = [c.split()[0] for c in PASS_SCHEMA.split(", ")]
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    types = [pa.int64()] * 5 + [pa.string(), pa.int64(), pa.binary(), ints, ints, longs]

    def emit(block, held):
        pairs = np.concatenate([p for _, p, _ in held])
        distinct, place, n = np.unique(pairs, return_inverse=True, return_counts=True)
        place, at = place.astype("<u4"), 0
        for facts, p, per_doc in held:
            places = []
            for k in per_doc:
                places.append(zlib.compress(place[at:at + k].tobytes(), 1))
                at += k
            count = len(per_doc)
            columns = [*facts, pa.array(np.full(count, block)), pa.array(places, pa.binary())] + [pa.nulls(count, t) for t in types[8:]]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        lists = [pa.array([x], t) for x, t in ((distinct >> SHIFT, ints), (distinct & ((1 << SHIFT) - 1), ints), (n, longs))]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in types[:6]] + [pa.array([block]), pa.nulls(1, pa.binary()), *lists],
                                         names=names)

    def run(batches):
        aligner, block, held, size = make(), TaskContext.get().partitionId() << 32, [], 0
        for keys, texts in _chunks(batches):
            a, b = aligner.tokens(texts)
            rows_a, rows_b = aligner.links(a, b)
            ga, _ = aligner.groups(a, b)
            n_docs = len(texts)
            count = lambda docs, k=n_docs: np.bincount(docs, minlength=k)
            first = np.append(True, ga[1:] != ga[:-1]) if len(ga) else np.zeros(0, bool)
            digests = [hashlib.sha256(w).hexdigest() if w else "" for w in aligner.written(a, b, n_docs)]
            per_doc = count(a[0][rows_a])
            facts = [keys, *(pa.array(c) for c in (count(a[0]), count(b[0]), count(a[0][first]), per_doc)), pa.array(digests)]
            held.append((facts, a[1][rows_a] << SHIFT | b[1][rows_b], per_doc))
            size += len(rows_a)
            if size >= BLOCK:
                yield from emit(block, held)
                block, held, size = block + 1, [], 0
        if held:
            yield from emit(block, held)

    return rows.mapInArrow(run, PASS_SCHEMA)


def _summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Documents of one block with the sums over their links."""
    at = pairs.column("i").to_numpy()
    total, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    total[at], best[at] = pairs.column("total").to_numpy(), pairs.column("best").to_numpy()
    places = [np.frombuffer(zlib.decompress(p.as_py()), "<u4") for p in docs.column("places")]
    return docs.drop_columns(["block", "places"]).append_column(
        "n_best", pa.array([int(best[p].sum()) for p in places], pa.int64())).append_column(
        "count_sum", pa.array([int(total[p].sum()) for p in places], pa.int64()))


def measured(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum)."""
    rows = materialize(_aligned(docs, path_a, path_b), "align-pass")
    documents = rows.filter("places is not null").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "places")
    listed = rows.filter("places is null").select("block", F.posexplode(F.arrays_zip("a", "b", "n")).alias("i", "p")).select(
        "block", "i", "p.*")
    totals = materialize(listed.groupBy("a", "b").agg(F.sum("n").alias("total")), "align-pairs")
    highest = totals.groupBy("b").agg(F.max("total").alias("most"))
    marked = totals.join(highest, "b").select("a", "b", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))
    found = listed.join(marked, ["a", "b"]).select(F.col("block").alias("owner"), "i", "total", "best")
    return documents.groupBy("block").cogroup(found.groupBy("owner")).applyInArrow(
        _summed, MEASURED + ", n_best long, count_sum long")
