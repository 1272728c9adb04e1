"""Exact top-k inner products by a bit-sliced index.

Vectors become integers, floor(scale * x). Rows are packed in blocks: for every
component the block holds one bitmap per bit of the component's coarse value
(integer >> DROP, made non-negative), and the integers themselves.

A query adds the slices with bitmap arithmetic: each set bit of a query
component adds that component's slices, shifted, to a bit-sliced sum
(carry-save over whole bitmaps), positive and negative components in two sums
whose difference is again bit-sliced. The top rows are then selected from the
most significant slice downward. The dropped bits bound the error of a coarse
sum from both sides, so rows whose upper bound reaches the k-th lower bound are
the boundary rows; their scores are computed exactly.

Every block of queries meets every block of rows through an equi-join on the
query block's number; a task holds one block of each. A pair of blocks gives k
rows a query, and ranks come from a window by query over those.

Defined cases: null vectors, vectors with null or non-finite components take no
part; vectors whose length differs from a query's are not its candidates; ties
go to the smaller id; repeated rows are separate candidates, a repeated query
id asks once; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.common import materialize

SCALE = 1024
ROWS_A_BLOCK = 16384
QUERIES_A_BLOCK = 256
DROP = 2  # low bits that the coarse slices leave out


def quantised(vectors: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): integer vectors of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    usable = F.col(vector).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(usable & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows packed in blocks of one vector length: (dims, ids, v) as bytes."""

    def packed(batches):
        held: dict[int, list] = {}

        def emit(dims):
            ids, v = (np.concatenate(x) for x in zip(*held.pop(dims)))
            kind = next(t for t in (np.int16, np.int32, np.int64)
                        if not v.size or np.iinfo(t).min <= v.min() and v.max() <= np.iinfo(t).max)
            for k in range(0, len(ids), size):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dims], pa.int32()), pa.array([np.dtype(kind).itemsize], pa.int32()),
                     pa.array([ids[k:k + size].tobytes()], pa.binary()),
                     pa.array([v[k:k + size].astype(kind).tobytes()], pa.binary())], names=["dims", "bytes", "ids", "v"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            flat, lengths = _matrix(batch.column(1))
            starts = np.cumsum(lengths) - lengths
            for dims in np.unique(lengths):
                at = np.flatnonzero(lengths == dims)
                v = flat[starts[at][:, None] + np.arange(dims)]
                held.setdefault(int(dims), []).append((ids[at], v))
                if sum(len(x[0]) for x in held[int(dims)]) >= size:
                    yield from emit(int(dims))
        for dims in list(held):
            yield from emit(dims)

    return rows.mapInArrow(packed, "dims int, bytes int, ids binary, v binary")


def _add(total: list, slices: list) -> None:
    """total += slices, both lists of bitmaps from the least significant."""
    carry = None
    for i, s in enumerate(slices):
        if i == len(total):
            total.append(np.zeros_like(s))
        t = total[i]
        half = t ^ s
        new = t & s
        if carry is not None:
            new |= half & carry
            half = half ^ carry
        total[i], carry = half, new
    i = len(slices)
    while carry is not None and carry.any():
        if i == len(total):
            total.append(carry)
            return
        total[i], carry = total[i] ^ carry, total[i] & carry
        i += 1


class BitSlicedBlock:
    """Coarse slices of one block of integer vectors, and the vectors."""

    def __init__(self, v: np.ndarray, drop: int = DROP):
        self.v, self.rows, self.drop = v, len(v), drop
        high = v >> drop
        self.low = int(high.min()) if high.size else 0
        high = high - self.low  # non-negative
        self.width = max(1, int(high.max()).bit_length()) if high.size else 1
        pad = -self.rows % 64
        high = np.pad(high, ((0, pad), (0, 0)))
        self.slices = [[np.packbits((high[:, d] >> b) & 1, bitorder="little").view(np.uint64) for b in range(self.width)]
                       for d in range(v.shape[1])]
        self.words = (self.rows + pad) // 64

    def _weighted(self, q: np.ndarray) -> list:
        total: list = [np.zeros(self.words, np.uint64)]
        # the bits of the query from high to low: double what is there, then add
        for bit in range(max(1, int(q.max(initial=0)).bit_length()) - 1, -1, -1):
            total.insert(0, np.zeros(self.words, np.uint64))
            for d in np.flatnonzero((q >> bit) & 1):
                _add(total, self.slices[d])
        return total

    def top(self, q: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
        """Indices of all rows that may be among the k best, ``own`` (a bitmap)
        left out."""
        plus, minus = self._weighted(np.maximum(q, 0)), self._weighted(np.maximum(-q, 0))
        ones = np.full(self.words, np.uint64(0xFFFFFFFFFFFFFFFF))
        zero = np.zeros(self.words, np.uint64)
        width = max(len(plus), len(minus)) + 1
        plus += [zero] * (width - len(plus))
        minus += [zero] * (width - len(minus))
        diff, carry = [], ones  # plus + not minus + 1
        for p, m in zip(plus, minus):
            n = ~m
            half = p ^ n
            diff.append(half ^ carry)
            carry = (p & n) | (half & carry)
        diff[-1] = ~diff[-1]  # the sign slice, so that larger is larger
        live = np.packbits(np.arange(self.words * 64) < self.rows, bitorder="little").view(np.uint64) & ~own
        # a coarse sum c has its exact score within [c + least, c + most] (times 2^drop)
        step = (1 << self.drop) - 1
        spread = step * int(np.abs(q).sum())
        slack = -(-spread >> self.drop)
        sure, tied, need = zero, live, k
        for s in reversed(diff):
            ahead = tied & s
            n = int(np.bitwise_count(ahead).sum())
            if n >= need:
                tied = ahead
            else:
                sure, need = sure | ahead, need - n
                tied = tied & ~s
        if need and not tied.any():
            chosen = live
        else:
            kth = self._value(diff, int(np.flatnonzero(tied)[0]), tied)
            chosen = self._at_least(diff, kth - slack, live)
        return np.flatnonzero(np.unpackbits(chosen.view(np.uint8), bitorder="little"))

    @staticmethod
    def _value(diff: list, word: int, rows: np.ndarray) -> int:
        bit = int(rows[word]) & -int(rows[word])
        return sum(1 << i for i, s in enumerate(diff) if int(s[word]) & bit)

    @staticmethod
    def _at_least(diff: list, bound: int, live: np.ndarray) -> np.ndarray:
        if bound <= 0:
            return live
        more, equal = np.zeros_like(live), live
        for i in range(len(diff) - 1, -1, -1):
            if bound >> i & 1:
                equal = equal & diff[i]
            else:
                more, equal = more | (equal & diff[i]), equal & ~diff[i]
        return more | equal


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, rows_a_block: int = ROWS_A_BLOCK,
          queries_a_block: int = QUERIES_A_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of ``rows`` (vec_id,
    v), its own id left out."""
    asked = materialize(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    n = asked.count()
    parts = max(1, math.ceil(n / queries_a_block))
    number = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    blocks = _blocks(rows.select("vec_id", "v"), rows_a_block).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = asked.withColumn("qb", number).groupBy("qb").agg(F.collect_list(F.struct("vec_id", "v")).alias("qs"))
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = blocks.join(asked, "qb").repartition(spread, "qb", F.xxhash64("ids")).select("dims", "bytes", "ids", "v", F.col("qs.vec_id").alias("qids"), F.col("qs.v").alias("qv"))

    def search(batches):
        last, index = None, None
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                v = np.frombuffer(row["v"], f"i{row['bytes']}").reshape(len(ids), row["dims"]).astype(np.int64)
                if row["v"] != last:
                    last, index = row["v"], BitSlicedBlock(v)
                out: list[list] = [[], [], []]
                for query, q in zip(row["qids"], row["qv"]):
                    if len(q) != row["dims"]:
                        continue
                    q = np.array(q, np.int64)
                    own = np.zeros(index.words * 64, bool)
                    own[np.flatnonzero(ids == query)] = True
                    at = index.top(q, k, np.packbits(own, bitorder="little").view(np.uint64))
                    score = v[at] @ q
                    best = np.lexsort((ids[at], -score))[:k]
                    out[0] += [query] * len(best)
                    out[1] += ids[at][best].tolist()
                    out[2] += score[best].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out],
                                                 names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
