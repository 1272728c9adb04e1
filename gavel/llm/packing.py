"""Best-two-fit packing of tokenized documents into fixed-length sequences.

* One Arrow pass tokenizes whole texts, cuts them and takes the checksums of the
  pieces; ids leave it only where they are asked for.
* Only documents longer than a sequence are cut; their first piece takes the
  remainder, the others are full.
* Lengths run from 1 to the capacity, so their histogram is bounded and the
  plan is made on it: a sequence is filled greedily with the longest pieces
  that fit, then its smallest piece gives way to the two unpacked pieces that
  fill the widened gap best. The filled pattern repeats while the histogram
  supports the same choices; at most capacity * (ln capacity + 2) patterns.
* Pieces get their rank within their length in parallel (salted cells and cell
  prefix sums), and the rank names sequence and offset through the patterns.

Defined cases: null or empty text is the lone end id; repeated rows pack as
separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.common import materialize

CAPACITY = 2048
END_ID = 0
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def tokenizer_json(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class ByteBpe:
    """Ids of whole texts by a byte-level BPE tokenizer file, as the tokenizers
    library gives them. Texts go through the same vocabulary as merge ranks;
    texts with special-token strings (unless these are ``plain`` text), rare
    white space or very long runs of white space through the library itself."""

    def __init__(self, source: str, plain: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_str(source)
        self.whole.encode_special_tokens = plain
        spec = json.loads(source)
        special = [] if plain else [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        # the rank encoder's pattern overflows its stack in long runs of white space
        odd = ["[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", r"[\t-\r ]{2000}", *special]
        self.odd = re.compile("|".join(odd))
        self.quick = self._ranked(spec)

    @staticmethod
    def pieces(spec: dict) -> dict[int, bytes]:
        """The bytes of each id, special tokens left out."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        return {i: bytes(back[c] for c in word) for word, i in spec["model"]["vocab"].items() if word not in special}

    @classmethod
    def _ranked(cls, spec: dict):
        """The vocabulary as merge ranks, if ids follow the merge order."""
        import tiktoken

        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        if (spec["normalizer"], pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) != (
                None, "ByteLevel", False, True) or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        ranks = {word: i for i, word in cls.pieces(spec).items()}
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        if self.quick is None or self.odd.search(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.quick(text)


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): ids as little-endian
    32-bit words; null if only their checksum is asked for.

    ``tokenizer`` is the path of a tokenizer file on the driver; its text
    travels to the tasks.
    """
    source = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))

    def cut(batches):
        encoder = ByteBpe(source.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            lo = 0
            while lo < batch.num_rows:
                size, hi, rows = 0, lo, []
                while hi < batch.num_rows and (size < 1 << 20 or hi == lo):
                    words = array("I", encoder.encode(texts[hi].as_py() or ""))
                    words.append(END_ID)
                    data, n = words.tobytes(), len(words)
                    size += len(data)
                    first = n if n <= capacity else (n % capacity or capacity)
                    bounds = [0, *range(first, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        part = data[4 * a:4 * b]
                        rows.append((hi, k, a, b - a, zlib.crc32(part), part if ids else None))
                    hi += 1
                at, piece, start, length, crc, part = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(part, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
                lo = hi

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECE_SCHEMA)


def plan_patterns(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, copies), ...]) of best-two-fit over a histogram;
    ``counts[n]`` pieces have length n, the last index is the capacity."""
    left = np.array(counts, np.int64)
    capacity = len(left) - 1
    index = np.arange(capacity + 1)
    patterns = []
    while left[1:].any():
        spare, used, peak, gap = left.copy(), {}, {}, capacity

        def take(length: int, copies: int) -> None:
            spare[length] -= copies
            used[length] = used.get(length, 0) + copies
            peak[length] = max(peak.get(length, 0), used[length])

        def fill(gap: int) -> int:
            below = np.maximum.accumulate(np.where(spare > 0, index, 0))
            fit = int(below[gap])
            while fit:
                copies = int(min(spare[fit], gap // fit))
                take(fit, copies)
                gap -= copies * fit
                fit = int(below[min(gap, fit - 1)])
            return gap

        gap = fill(gap)
        smallest = min(n for n, c in used.items() if c)
        wide = gap + smallest
        if gap and wide > 1:
            below = np.maximum.accumulate(np.where(spare > 0, index, 0))
            one = index[1:wide][spare[1:wide] > 0]
            two = below[np.minimum(one, wide - one)]
            lone = (two == one) & (spare[one] < 2)
            two = np.where(lone, below[np.minimum(one - 1, wide - one)], two)
            total = np.where(two > 0, one + two, 0)
            if len(total) and total.max() > smallest:
                k = int(total.argmax())
                spare[smallest] += 1
                used[smallest] -= 1
                take(int(one[k]), 1)
                take(int(two[k]), 1)
                gap = fill(wide - int(total[k]))
        used = {n: c for n, c in used.items() if c}
        repeats = min((int(left[n]) - peak[n]) // c + 1 for n, c in used.items())
        for n, c in used.items():
            left[n] -= repeats * c
        patterns.append((repeats, sorted(used.items(), reverse=True)))
    return patterns


def _lookup(counts: np.ndarray, patterns) -> dict[str, np.ndarray]:
    """Rank intervals: where the r-th piece of a length goes."""
    before = np.concatenate(([0], np.cumsum(counts)))[:-1]  # pieces of smaller length
    seen = np.zeros(len(counts), np.int64)
    rows, base = [], 0
    for repeats, items in patterns:
        offset = 0
        for length, copies in items:
            rows.append((before[length] + seen[length], base, copies, offset))
            seen[length] += repeats * copies
            offset += length * copies
        base += repeats
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"before": before, "first": table[:, 0], "base": table[:, 1], "copies": table[:, 2], "offset": table[:, 3]}


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """``pieces`` plus sequence_id and offset (columns of these names are replaced).

    ``pieces`` has a long column ``length`` between 1 and ``capacity``;
    ``order`` names columns that order its rows. The rows are written once with
    their salt, which comes from their place in the input, so equal rows spread
    too.
    """
    spark = pieces.sparkSession
    salts = salts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    cell = materialize(pieces.select(F.struct(*kept).alias("row"), F.col("length").alias("n"), salt.alias("salt")), "packing-pieces")
    cells = materialize(cell.groupBy("n", "salt").agg(F.count("*").alias("rows")), "packing-cells")
    counts = np.zeros(capacity + 1, np.int64)
    for r in cells.groupBy("n").agg(F.sum("rows").alias("rows")).collect():  # one row a length
        counts[r["n"]] = r["rows"]
    table = _lookup(counts, plan_patterns(counts))
    prefix = cells.select("n", "salt", (F.sum("rows").over(
        Window.partitionBy("n").orderBy("salt")) - F.col("rows")).alias("before"))
    ranked = cell.join(prefix, ["n", "salt"]).select("row", "n", (F.col("before") + F.row_number().over(
        Window.partitionBy("n", "salt").orderBy(*[f"row.{c}" for c in order])) - 1).alias("rank"))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            at = table["before"][length] + rank
            k = np.searchsorted(table["first"], at, side="right") - 1
            local = at - table["first"][k]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(table["base"][k] + local // table["copies"][k]),
                 pa.array(table["offset"][k] + local % table["copies"][k] * length)], names=["row", "sequence_id", "offset"])

    schema = cell.select("row").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema).select("row.*", "sequence_id", "offset")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): every packed sequence whole, at most a capacity of
    ids each. ``pieces`` has the ids, ``placed`` sequence_id and offset."""
    rows = pieces.select("doc_id", "piece", "ids").join(
        placed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    return rows.groupBy("sequence_id").agg(F.unhex(F.array_join(parts, "")).alias("ids"))
