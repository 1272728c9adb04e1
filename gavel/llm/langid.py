"""Language identification by hierarchical discrimination.

A document is first assigned to a language family, then one-versus-one linear
support vector machines separate the languages of that family.

Features are the square roots of the shares of hashed letter 1- to 3-grams of
the whole text (lower case; whatever is not a letter counts as one gap), so
every document has length one whatever its size. Training fits Spark ML's
LinearSVC, one for each pair of families and each pair of languages within a
family, on a bounded sample: about ``sample`` labelled documents a language,
drawn by hash. Prediction is one Arrow pass with the fitted weights.

Families are fixed values of common languages; a label that is not listed is a
family of its own. Only the text enters a prediction.

Defined cases: null text or text without a letter is ``und`` with score 0, and
so is everything if no labelled text has been learned; rows without a label or
letters are not learned from; repeated rows are separate documents; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import materialize, row_chunks, text_buffers

DIMS = 4096
SAMPLE = 400  # labelled documents a language, about
UNKNOWN = "und"
# Families of common languages.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}


def _letters() -> np.ndarray:
    """Lower case of each code point of the basic plane that is a letter, else 0."""
    table = np.zeros(1 << 16, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            table[i] = ord(c.lower()[0])
    return table


def features(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """A row of gram shares per text; all zero where a text has no letter."""
    rows = len(offsets) - 1
    out = np.zeros((rows, DIMS), np.float32)
    texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])]
    for i, text in enumerate(texts):
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        if not len(code):
            continue
        c = letters[np.minimum(code, 0xFFFF)]
        for k in np.flatnonzero(code > 0xFFFF):
            c[k] = code[k] if chr(code[k]).isalpha() else 0
        keep = c > 0
        if not keep.any():
            continue
        keep[1:] |= c[:-1] > 0  # one gap after each word
        c = np.concatenate((np.zeros(1, np.uint32), c[keep], np.zeros(1, np.uint32)))
        two = c[:-1] * np.uint32(0x9E3779B1) ^ c[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) ^ c[2:] * np.uint32(0x27D4EB2F)
        counts = np.zeros(DIMS, np.int64)
        for grams in (c[c > 0] * np.uint32(0x165667B1), two * np.uint32(0x9E3779B1) + np.uint32(1),
                      three * np.uint32(0x85EBCA77) + np.uint32(2)):
            counts += np.bincount(grams >> np.uint32(20), minlength=DIMS)
        out[i] = np.sqrt(counts / counts.sum())
    return out


def _featured(labelled: DataFrame) -> DataFrame:
    def run(batches):
        letters = _letters()
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in row_chunks(offsets, 1 << 20):
                x = features(data, offsets[lo:hi + 1], letters)
                some = np.flatnonzero(x.any(axis=1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * DIMS),
                                                 pa.array(x[some].reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(some)), lists],
                                                 names=["lang", "x"])

    return labelled.select("lang", "text").mapInArrow(run, "lang string, x array<float>")


def train(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from ``docs`` (doc_id, text, lang): languages by family, and
    weights of each pair of families and of languages within a family."""
    labelled = docs.filter("lang is not null and text is not null").select(
        F.col("lang").cast("string"), F.col("text").cast("string"), "doc_id")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return {"families": {}, "pairs": {}}
    draw, h = F.lit(False), F.xxhash64("doc_id", "text")
    for lang, n in sorted(counts.items()):
        draw = draw | ((F.col("lang") == lang) & (F.pmod(h, F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30))))
    # rows that repeat id and text are drawn together: one of them is enough
    drawn = _featured(labelled.filter(draw).dropDuplicates(["lang", "doc_id", "text"])).withColumn("family", F.coalesce(
        *[F.when(F.col("lang").isin(langs), family) for family, langs in FAMILIES.items()], F.col("lang")))
    drawn = materialize(drawn, "langid-sample").coalesce(4)
    vectors = drawn.select("lang", "family", array_to_vector("x").alias("features"))
    families: dict[str, list[str]] = {}
    for r in drawn.select("family", "lang").distinct().collect():
        families.setdefault(r["family"], []).append(r["lang"])

    def fit(column, a, b):
        pair = vectors.filter(F.col(column).isin(a, b)).withColumn("label", (F.col(column) == a).cast("double"))
        fitted = LinearSVC(maxIter=25, regParam=1e-4, standardization=False).fit(pair)
        return fitted.coefficients.toArray(), float(fitted.intercept)

    pairs = {("family", a, b): fit("family", a, b) for a, b in combinations(sorted(families), 2)}
    for langs in families.values():
        pairs |= {("lang", a, b): fit("lang", a, b) for a, b in combinations(sorted(langs), 2)}
    return {"families": {k: sorted(v) for k, v in sorted(families.items())}, "pairs": pairs}


def _vote(x: np.ndarray, names: list[str], pairs: dict, level: str) -> tuple[np.ndarray, np.ndarray]:
    """Winner's index by one-versus-one votes (margins settle ties) and its mean
    chance against the others."""
    wins, chance = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
    for (i, a), (j, b) in combinations(enumerate(names), 2):
        w, c = pairs[(level, a, b)]
        p = 1 / (1 + np.exp(-np.clip(2 * (x @ w + c), -40, 40)))
        wins[:, i] += p >= 0.5
        wins[:, j] += p < 0.5
        chance[:, i] += p
        chance[:, j] += 1 - p
    others = max(1, len(names) - 1)
    best = np.argmax(wins + chance / (others + 1), axis=1)
    return best, chance[np.arange(len(x)), best] / others if len(names) > 1 else np.ones(len(x))


def predict(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred and score."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # some weights a language pair

    def run(batches):
        letters, model = _letters(), shipped.value
        names = list(model["families"])
        for batch in batches:
            data, offsets = text_buffers(batch.column(batch.num_columns - 1))
            pred, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for lo, hi in row_chunks(offsets, 1 << 20):
                x = features(data, offsets[lo:hi + 1], letters).astype(np.float64)
                some = x.any(axis=1)
                if not names or not some.any():
                    continue
                family, p = _vote(x, names, model["pairs"], "family")
                for k, name in enumerate(names):
                    at = np.flatnonzero(some & (family == k))
                    langs = model["families"][name]
                    best, q = _vote(x[at], langs, model["pairs"], "lang")
                    pred[lo + at] = np.array(langs, object)[best]
                    score[lo + at] = p[at] * q
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score)],
                                             names=[*keep, "lang_pred", "score"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)
