"""Document fingerprints by a randomised edit embedding.

All texts walk with one shared random table: at step j a walker stands on a
character, votes on bit j mod BITS with the sign that the table gives to (j,
character), and moves on by the coin that the table gives to the same pair. A
text of n characters thus becomes a string of about 2n symbols in which two
texts at small edit distance differ in few places (they fall back into step
after an insertion). The fingerprint holds the sign of each bit's votes, so its
Hamming distance estimates the share of differing places; bits that no step
reached (short texts) are masked.

Walks run over whole texts, many texts side by side. A text and its edited form
share the walk of their common beginning.

``fingerprint_edited`` needs every row's successor in id order: rows go to id
blocks between quantiles, the first row of a block also to the block before
(circularly), and each block is walked in order. ``near_copies`` groups
documents: bands of minima of their q-grams give buckets, packed minima filter
their pairs, and a bounded edit distance verifies them.

Defined cases: null text counts as empty, its fingerprint is all masked; equal
texts have equal fingerprints and likeness 1; a null id sorts first; equal ids
go by text; a single row is its own successor; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm import minhash
from gavel.llm.common import link_buckets, materialize, mix64, shared_buckets

BITS = 256
PERIOD = 4096  # rows of the shared random table
SEED = 31
PAD = 256  # the symbol after a text's end: no vote, no move
CHARS_A_BATCH = 6_000_000


def _table() -> np.ndarray:
    """Rows of 512 entries, by symbol: bit 0 the move, bit 1 the vote; 4 at the
    end symbol. BITS rows repeat at the end, so a block of steps never wraps."""
    table = np.zeros((PERIOD, 512), np.uint8)
    table[:, :256] = np.random.default_rng(SEED).integers(0, 4, (PERIOD, 256), dtype=np.uint8)
    table[:, PAD] = 4
    return np.concatenate([table, table[:BITS]]).reshape(-1)


def _walk(table: np.ndarray, symbols: np.ndarray, start: np.ndarray, end: np.ndarray, phase: np.ndarray):
    """Votes (walkers, BITS), count of votes, and steps of each walk from
    ``start`` to ``end``, beginning at step ``phase``."""
    votes, seen = np.zeros((len(start), BITS), np.int32), np.zeros((len(start), BITS), np.int32)
    steps = np.zeros(len(start), np.int64)
    sign = np.array([-1, -1, 1, 1, 0], np.int8)
    live, place, t = np.flatnonzero(start < end), start.astype(np.int64), 0
    while len(live):
        p, base = place[live], (((phase[live] + t) & (PERIOD - 1)) << 9)
        got = np.empty((BITS, len(live)), np.uint8)
        for i in range(BITS):
            at = symbols[p] + base
            row = np.take(table[i << 9:], at, out=got[i], mode="clip")
            p += row & 1
        place[live] = p
        voted = got < 4
        votes[live] += sign[got].T
        seen[live] += voted.T
        steps[live] += voted.sum(axis=0)
        live = live[p < end[live]]
        t += BITS
    shift = (phase % BITS).astype(np.int64)
    index = (np.arange(BITS)[None, :] - shift[:, None]) % BITS
    return np.take_along_axis(votes, index, 1), np.take_along_axis(seen, index, 1), steps


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One end symbol after each text; starts and ends."""
    length = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(length + 1) - 1
    code = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    symbols = ((code * np.uint32(2654435761)) >> np.uint32(24)).astype(np.int64)
    symbols[end] = PAD
    return symbols, end - length, end


def _signs(votes: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    tie = np.where(np.arange(BITS) * 7 % 13 % 2, 1, -1)
    return 2 * votes + tie > 0, seen > 0


def _hex(signs: np.ndarray, mask: np.ndarray) -> list[str]:
    a, b = np.packbits(signs & mask, axis=1), np.packbits(mask, axis=1)
    return [x.tobytes().hex() + ("" if m.all() else ":" + y.tobytes().hex()) for x, y, m in zip(a, b, mask)]


def _likeness(a, b) -> np.ndarray:
    (sa, ma), (sb, mb) = a, b
    either = ma | mb
    n = either.sum(axis=1)
    differ = (either & ((sa != sb) | (ma != mb))).sum(axis=1)
    return np.where(differ == 0, 1.0, np.maximum(0.0, np.cos(np.pi * differ / np.maximum(n, 1))))


def sketch(texts: list[str], tails: list[str | None]):
    """Signs and masks of ``texts`` and of each text with its last quarter
    replaced by the tail (None: not wanted, the same as the text)."""
    table = _table()
    cut = [len(t) - len(t) // 4 for t in texts]
    symbols, start, end = _symbols([x for t, c, e in zip(texts, cut, tails) for x in (t[:c], t[c:], e or "")])
    common = _walk(table, symbols, start[0::3], end[0::3], np.zeros(len(texts), np.int64))
    rest = _walk(table, symbols, np.concatenate([start[1::3], start[2::3]]), np.concatenate([end[1::3], end[2::3]]),
                 np.concatenate([common[2], common[2]]))
    n = len(texts)
    whole = _signs(common[0] + rest[0][:n], common[1] + rest[1][:n])
    other = _signs(common[0] + rest[0][n:], common[1] + rest[1][n:])
    return whole, other


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < CHARS_A_BATCH):
                    size += len(texts[hi])
                    hi += 1
                whole, _ = sketch(texts[lo:hi], [None] * (hi - lo))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array([len(t) for t in texts[lo:hi]], pa.int64()),
                    pa.array(_hex(*whole))], names=["doc_id", "n_chars", "fingerprint"])
                lo = hi

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_chars long, fingerprint string")


def _in_blocks(docs: DataFrame, parts: int) -> DataFrame:
    """Rows dealt to id blocks (block, ahead, doc_id, text), sorted; rows that
    are ``ahead`` are the next block's first, here only as successors."""
    low = -(1 << 63)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("k"))
    cuts = ids.approxQuantile("k", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = np.unique(np.array(cuts, np.float64)).astype(np.int64)

    def block_of(keys):
        return np.searchsorted(bounds, keys, side="right")

    def label(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            block = block_of(keys)
            for b in np.unique(block):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([keys[block == b].min()], pa.int64())],
                                                 names=["block", "least"])

    least = {r["block"]: r["least"] for r in ids.mapInArrow(label, "block long, least long").groupBy("block").agg(
        F.min("least").alias("least")).collect()}  # one row a block
    order = sorted(least)
    before = {least[b]: order[i - 1] for i, b in enumerate(order)}
    firsts = np.array(sorted(before), np.int64)
    target = np.array([before[k] for k in firsts.tolist()], np.int64)

    def deal(batches):
        for batch in batches:
            keys = batch.column(0).fill_null(low).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block_of(keys), pa.int64()), pa.array(np.zeros(len(keys), bool)), batch.column(0), batch.column(1)],
                names=["block", "ahead", "doc_id", "text"])
            at = np.flatnonzero(np.isin(keys, firsts))
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(target[np.searchsorted(firsts, keys[at])]), pa.array(np.ones(len(at), bool)),
                     batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))],
                    names=["block", "ahead", "doc_id", "text"])

    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        deal, "block long, ahead boolean, doc_id long, text string")
    return dealt.repartition(parts, "block").sortWithinPartitions("block", "ahead", "doc_id", "text")


def fingerprint_edited(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited form (its last quarter
    replaced from the successor's beginning), and their likeness."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def finish(rows):
        """rows: (block, ahead, id, text), each but the last followed by its successor."""
        texts = [r[3] for r in rows]
        want = [not r[1] and i + 1 < len(rows) and rows[i + 1][0] == r[0] for i, r in enumerate(rows)]
        tails = [texts[i + 1][:len(t) // 4] if w else None for i, (t, w) in enumerate(zip(texts, want))]
        whole, other = sketch(texts, tails)
        at = np.flatnonzero(want)
        if not len(at):
            return None
        pick = lambda x, i: (x[0][i], x[1][i])
        near = _likeness(pick(whole, at), pick(other, at)), _likeness(pick(whole, at), pick(whole, at + 1))
        edited = [hashlib.sha256((texts[i][:len(texts[i]) - len(texts[i]) // 4] + tails[i]).encode()).hexdigest() for i in at]
        same = np.array([texts[i][len(texts[i]) - len(texts[i]) // 4:] == tails[i] for i in at])
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][2] for i in at], pa.int64()), pa.array([len(texts[i]) for i in at], pa.int64()),
             pa.array(edited), pa.array(_hex(*pick(whole, at))), pa.array(_hex(*pick(other, at))),
             pa.array(np.where(same, 1.0, near[0])), pa.array(near[1])],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                if row[1] and held and held[-1][1] and held[-1][0] == row[0]:
                    continue  # more rows with the next block's first id
                text = row[3].as_py() or ""
                held.append((*row[:3], text))
                size += len(text)
                if size >= CHARS_A_BATCH:
                    done = finish(held)
                    if done is not None:
                        yield done
                    held, size = held[-1:], len(text)
        if held:
            done = finish(held)
            if done is not None:
                yield done

    return _in_blocks(docs, parts).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")


def _grams(text: str, q: int) -> np.ndarray:
    """Hashes of the q-grams of ``text`` with q - 1 end symbols on both sides,
    each with the number of its occurrence: a set that stands for the bag."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    code = np.concatenate([np.zeros(q - 1, np.uint64), code, np.zeros(q - 1, np.uint64)])
    rolled = np.zeros(len(code) - q + 1, np.uint64)
    for k in range(q):
        rolled = mix64(rolled + code[k:k + len(rolled)] * np.uint64(0x9E3779B97F4A7C15))
    rolled.sort()
    place = np.arange(len(rolled))
    fresh = np.concatenate([[True], rolled[1:] != rolled[:-1]])
    times = place - np.maximum.accumulate(np.where(fresh, place, 0))
    return mix64(rolled + times.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def gram_bound(share: float) -> tuple[int, float]:
    """(q, least similarity): an edit touches at most q of a text's q-grams, so
    texts of at most n characters within share * n edits have bags of q-grams
    with a Jaccard similarity of (1 - q * share) / (1 + q * share) or more."""
    q = max(1, min(8, int(0.4 / share + 1e-9)))
    return q, (1 - q * share) / (1 + q * share)


def band_count(similarity: float, rows: int, miss: float = 1e-4) -> int:
    """Bands of ``rows`` minima that miss a pair of this similarity with ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-similarity ** rows))


def _signed(texts: DataFrame, q: int, bands: int, rows: int) -> DataFrame:
    """(rep, bands, sig): band keys and packed minima of each text's bag."""

    def sign(batches):
        np.seterr(over="ignore")
        keyed, packed = minhash._family(SEED + 1, bands * rows), minhash._family(SEED + 2, minhash.MINIMA)
        fold = np.random.default_rng(SEED + 3).integers(0, 1 << 63, (bands, rows), dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                bags = [_grams(t.as_py(), q) for t in part.column(1)]
                low = minhash._minima(bags, *keyed).reshape(-1, bands, rows)
                keys = mix64((low * fold).sum(axis=2) + np.arange(bands, dtype=np.uint64)).view(np.int64)
                every = np.ones(part.num_rows, bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), minhash._lists(keys, every), minhash._lists(minhash.packed(minhash._minima(bags, *packed)), every)],
                    names=["rep", "bands", "sig"])

    return texts.select("doc_id", "text").mapInArrow(sign, "rep long, bands array<long>, sig array<long>")


def near_copies(docs: DataFrame, share: float = 0.1, rows: int = 4) -> DataFrame:
    """(doc_id, class_id): documents within an edit distance of ``share`` of
    the longer text are linked; class_id is the smallest id reachable.

    Equal texts collapse first. Every pair within the distance has bags of
    q-grams of a known least similarity (``gram_bound``); bands of ``rows``
    minima of the bags, as many as miss such a pair with 1e-4 (``band_count``),
    give the buckets, packed minima estimate their pairs, and an edit distance
    that stops at the bound verifies them. Fingerprints take no part: at a
    share of 0.1 their bits differ nearly as often as those of unrelated texts.
    Empty texts and null ids are linked with nothing but equal texts.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    first = texts.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("rep"))
    member = materialize(texts.select("doc_id", F.sha2("text", 256).alias("h")).join(first, "h").select("doc_id", "rep"),
                         "edit-members")
    rep_texts = materialize(texts.join(member.filter("doc_id = rep").select("doc_id").distinct(), "doc_id")
                            .filter("text <> ''").dropDuplicates(["doc_id"]), "edit-texts")
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    q, similarity = gram_bound(share)
    reps = materialize(_signed(rep_texts, q, band_count(similarity, rows), rows), "edit-minima")

    def verified(pairs: DataFrame) -> DataFrame:
        ta, tb = (rep_texts.select(F.col("doc_id").alias(c), F.col("text").alias("t" + c)) for c in "ab")
        size = F.greatest(F.char_length("ta"), F.char_length("tb"))
        both = pairs.join(ta, "a").join(tb, "b").withColumn("most", F.floor(size * share + 1e-9).cast("int"))
        # -1 stands for more than the bound
        return both.filter((F.abs(F.char_length("ta") - F.char_length("tb")) <= F.col("most"))
                           & (F.expr("levenshtein(ta, tb, most)") >= 0)).select("a", "b")

    labels = link_buckets(shared_buckets(reps, "edit-buckets"), reps, minhash.estimate,
                          minhash.floor_estimate(similarity), verified)
    return member.join(labels, "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("class_id"))
