"""Near-duplicate documents by b-bit MinHash.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a
document's set holds its distinct five-word shingles (64-bit hashes), one
shingle of all words when there are fewer, nothing when there are none.

* One Arrow pass makes each document's set size, 128-bit set digest and band
  keys (32 bands of four minima).
* Documents with equal sets collapse to their smallest id by a map-side
  combined minimum; everything later sees one row per distinct set.
* Bands give candidates; whoever shares a bucket gets a signature, the packed
  low four bits of 1024 minima. In a bucket each member meets only the bucket's
  centre (the member with the heaviest buckets), after the collision-corrected
  b-bit estimate, computed by xor, or and bit counts on the packed signatures.
* Estimated links are confirmed on the full sets (100 * both >= 75 * either).
* Members already in the centre's component need no further test. What is left
  after two such rounds, pairs of one bucket in different components, is
  estimated inside the bucket join, each pair in the first band that it shares,
  and confirmed in full, so stars lose no link that a band has found.

Defined cases: null or empty text has n_shingles 0 and is its own component;
repeated rows collapse like any equal sets; a row without id has the component
of a named row with an equal set, else none, and is kept only then; other input
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import link_buckets, materialize, mix64, row_chunks, shared_buckets, text_buffers

SHINGLE_WORDS = 5
BANDS, ROWS = 32, 4
MINIMA, LOW_BITS = 1024, 4  # of a signature
SIG_SCHEMA = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text in ``data[offsets]``."""
    rows, n = len(offsets) - 1, len(data)
    empty = np.zeros(0, np.uint64)
    if not n:
        return [empty] * rows
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([True], gap[:-1])) | edge[:n]
    after = np.concatenate((gap[1:], [True])) | edge[1:]
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    if not len(start):
        return [empty] * rows
    # a word's hash: polynomial over its bytes from prefix sums, made independent of its place
    base = np.uint64(0x9E3779B97F4A7C15 | 1)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    power = np.full(n, base, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    power = np.full(n, inverse, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    words = mix64((sums[end] - sums[start]) * power[start])
    first = np.searchsorted(start, offsets)
    mult = [np.uint64((0xA0761D6478BD642F * (2 * k + 3)) % (1 << 64) | 1) for k in range(width)]
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled += words[k:k + len(rolled)] * mult[k]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            out.append(np.unique(rolled[a:b - width + 1]))
        elif b > a:
            short = sum((words[a + k] * mult[k] for k in range(b - a)), np.uint64(b - a))
            out.append(mix64(np.array([short], np.uint64)))
        else:
            out.append(empty)
    return out


def _minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(a)), np.uint64)
    step = max(1, (1 << 18) // len(a))
    for i, s in enumerate(sets):
        if len(s):
            low = (s[:step, None] * a + b).min(axis=0)
            for k in range(step, len(s), step):
                np.minimum(low, (s[k:k + step, None] * a + b).min(axis=0), out=low)
            out[i] = low
    return out


def _family(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed).integers(0, 1 << 63, (2, n), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def _lists(m: np.ndarray, some: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(some * m.shape[1]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(m[some].reshape(-1)))


def band_keys(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set digest (d1, d2), band keys."""

    def sign(batches):
        np.seterr(over="ignore")
        a, b = _family(20240501, BANDS * ROWS)
        fold = np.random.default_rng(7).integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in row_chunks(offsets):
                part = offsets[lo:hi + 1]
                sets = shingle_hashes(data[part[0]:part[-1]], part - part[0])
                digest = np.zeros((2, hi - lo), np.uint64)
                for i, s in enumerate(sets):
                    digest[0, i], digest[1, i] = mix64(s).sum(), mix64(s ^ np.uint64(0x5DEECE66D)).sum()
                minima = _minima(sets, a, b).reshape(-1, BANDS, ROWS)
                keys = mix64((minima * fold).sum(axis=2) + np.arange(BANDS, dtype=np.uint64))
                sizes = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(digest[0].view(np.int64)),
                    pa.array(digest[1].view(np.int64)), _lists(keys.view(np.int64), sizes > 0)],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, SIG_SCHEMA)


def packed(minima: np.ndarray) -> np.ndarray:
    """The low bits of each row of minima, one plane a bit."""
    return np.concatenate([np.packbits(((minima >> np.uint64(j)) & np.uint64(1)).astype(np.uint8), axis=1)
                           for j in range(LOW_BITS)], axis=1).view(np.int64)


def signatures(texts: DataFrame) -> DataFrame:
    """doc_id and planes: the low bits of the minima, one packed plane a bit."""

    def sign(batches):
        np.seterr(over="ignore")
        a, b = _family(20240502, MINIMA)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in row_chunks(offsets):
                part = offsets[lo:hi + 1]
                minima = _minima(shingle_hashes(data[part[0]:part[-1]], part - part[0]), a, b)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _lists(packed(minima), np.ones(hi - lo, bool))],
                                                 names=["doc_id", "planes"])

    return texts.select("doc_id", "text").mapInArrow(sign, "doc_id long, planes array<long>")


def estimate(x: str, y: str) -> Column:
    """Similarity from two packed signatures: the share of equal low-bit
    groups, corrected for chance collisions (2^-b)."""
    words = MINIMA // 64
    differ = None
    for w in range(words):
        parts = [F.col(x)[j * words + w].bitwiseXOR(F.col(y)[j * words + w]) for j in range(LOW_BITS)]
        any_bit = parts[0]
        for p in parts[1:]:
            any_bit = any_bit.bitwiseOR(p)
        differ = F.bit_count(any_bit) if differ is None else differ + F.bit_count(any_bit)
    chance = 2.0 ** -LOW_BITS
    return ((F.lit(float(MINIMA)) - differ) / F.lit(float(MINIMA)) - F.lit(chance)) / F.lit(1 - chance)


def floor_estimate(threshold: float, deviations: float = 5.0) -> float:
    """An estimate that a pair at ``threshold`` stays above but for once in
    millions of pairs (normal bound of the b-bit estimator)."""
    chance = 2.0 ** -LOW_BITS
    p = chance + (1 - chance) * threshold
    return threshold - deviations * math.sqrt(p * (1 - p) / MINIMA) / (1 - chance)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar: 100 * both >= percent * either."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def check(batches):
        np.seterr(over="ignore")
        for batch in batches:
            da, oa = text_buffers(batch.column(2))
            db, ob = text_buffers(batch.column(3))
            ok = np.zeros(batch.num_rows, bool)
            for lo, hi in row_chunks(oa + ob):
                sa = shingle_hashes(da[oa[lo]:oa[hi]], oa[lo:hi + 1] - oa[lo])
                sb = shingle_hashes(db[ob[lo]:ob[hi]], ob[lo:hi + 1] - ob[lo])
                for i, (x, y) in enumerate(zip(sa, sb)):
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    ok[lo + i] = len(x) > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], names=["a", "b", "ok"])

    return (pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
            .mapInArrow(check, "a long, b long, ok boolean").filter("ok").select("a", "b"))


def near_duplicates(docs: DataFrame, percent: int = 75, star_rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    sig = materialize(band_keys(docs), "minhash-bands")
    classes = sig.filter("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    member = materialize(sig.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["d1", "d2", "n_shingles"], "left")
                         .select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "minhash-members")
    reps = (sig.filter("n_shingles > 0").join(member.filter("rep = doc_id").select("doc_id").distinct(), "doc_id")
            .dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), "bands"))
    rows = shared_buckets(reps, "minhash-buckets")
    texts = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
                        .join(rows.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").dropDuplicates(["doc_id"]),
                        "minhash-texts")
    members = materialize(signatures(texts).select(F.col("doc_id").alias("rep"), F.col("planes").alias("sig")).join(reps, "rep"),
                          "minhash-signatures")
    labels = link_buckets(rows, members, estimate, floor_estimate(percent / 100),
                          lambda pairs: confirm(pairs, texts, percent), star_rounds)
    out = member.join(labels, "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
