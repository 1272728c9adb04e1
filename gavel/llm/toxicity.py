"""Toxicity scores: gradient-boosted trees over dense features, calibrated.

* Draw: labels are collapsed to one a document and drawn by hash, at most about
  ``sample`` documents a class; only the drawn ids meet the texts. Equal texts
  count once, and if the drawn ids name more texts than that (repeated ids), the
  texts are drawn again. Classes keep their share of all labels as weights.
* The drawn texts are dealt to three parts by their hash. The first gives a
  lexicon: words and word beginnings (4 to 6 letters) that stand in documents of
  class 1 far more often, by the lower bound of their log odds. The second fits
  boosted trees (Spark ML), the third an isotonic curve from the trees' chance to
  the share of class 1.
* Features of a text, per word unless stated: hits of a fixed list of insults;
  weighted hits of the learned lexicon, their number and the strongest; words of
  the second person, and hits within ``NEAR`` words of one; capitals and
  words in capitals; exclamation and question marks and punctuation; words with
  hidden letters, hits behind them, stretched letters and lone letters.
* Scoring is one Arrow pass for the features, then the trees and the curve in
  the JVM. Nothing is shuffled but labels and the drawn rows.

Only the text enters a score. The curve is flat in places, so a hundredth of the
trees' chance is mixed in to keep the order of documents.

Defined cases: null or empty text has all features 0 and is scored like any
other; rows without a label, an id or a text are not learned from; an id with
several labels has the largest; where a class is missing in a part, the score is
the trees' chance without a curve, or the share of class 1 without trees (0.0
without labels); repeated rows are separate documents; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gavel.llm.common import materialize

SAMPLE = 6000  # drawn documents a class, about
LEXICON = 4096  # learned entries, the strongest
NEAR = 5
STEMS = (4, 5, 6)
TREES, DEPTH = 20, 3

# Common insults and words of address in four languages.
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass fool fools foolish loser losers scum trash garbage "
    "worthless pathetic disgusting clown jerk coward liar ugly filthy vermin imbecile cretin bastard bitch asshole "
    "dummkopf blöd blöde dumm arschloch trottel schwachkopf versager abschaum wertlos widerlich ekelhaft "
    "imbécile crétin stupide débile salaud connard ordure minable dégoûtant raclure "
    "idiota imbécil estúpido estúpida tonto basura asqueroso patético inútil cabrón payaso escoria").split()
SECOND_PERSON = (
    "you your yours yourself yourselves u ur youre du dich dir dein deine deinen deiner ihr euch euer "
    "tu te toi ton ta tes vous votre vos tú ti contigo usted ustedes vosotros os vuestro su").split()
# Characters that stand for letters.
MASKS = str.maketrans("01345789@$!|", "oieasttpasil")

_EDGES = ".,;:!?\"'()[]"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_MASKED = re.compile(r"[^\W\d_][\d@$!|*#_.+-]+[^\W\d_]")


class Measure:
    """Features of texts; facts of a distinct token are kept and reused."""

    KNOWN = 200_000  # kept tokens; beyond it the memory restarts
    FACTS = 16
    NAMES = ["words", "insults", "lexicon", "hits", "strongest", "second_person", "near", "capitals", "shouted", "exclaims",
             "asks", "punctuation", "masked", "masked_hits", "stretched", "lone"]

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.insults, self.you = lexicon, set(INSULTS), set(SECOND_PERSON)
        self.live = {w[:STEMS[0]].rstrip("*") for w in (*lexicon, *INSULTS)}  # beginnings of whatever can hit
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.facts = np.zeros((1024, self.FACTS))

    def _hit(self, word: str) -> tuple[bool, float]:
        """Whether a word is listed, and its weight in the learned lexicon."""
        if word[:STEMS[0]] not in self.live:
            return False, 0.0
        keys = [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]
        return word in self.insults, max(self.lexicon.get(k, 0.0) for k in keys)

    def _fact(self, token: str) -> list[float]:
        core = token.strip(_EDGES)
        low = core.lower()
        if core.isalpha():
            parts, letters, masked, marks = [low], len(low), False, len(token) - len(core)
        else:
            parts = [p for p in _NOT_LETTERS.split(low) if p]
            letters, masked = sum(map(len, parts)), bool(_MASKED.search(token))
            marks = sum(not c.isalnum() for c in token)
        hits = [self._hit(p) for p in parts]
        listed, weight = any(h[0] for h in hits), max((h[1] for h in hits), default=0.0)
        behind = masked and any(self._hit("".join(_NOT_LETTERS.split(low.translate(MASKS)))))
        upper = 0 if core == low else sum(map(str.isupper, core))
        return [letters > 0, listed, weight, listed or weight > 0, weight, any(p in self.you for p in parts), upper, letters,
                1 < letters == upper, token.count("!") if marks else 0, token.count("?") if marks else 0, marks, masked, behind,
                _STRETCHED.search(low) is not None, letters == 1]

    def _look(self, token: str) -> int:
        at = self.index.get(token)
        if at is None:
            at = self.index[token] = len(self.index)
            if at == len(self.facts):
                self.facts = np.concatenate((self.facts, np.zeros_like(self.facts)))
            self.facts[at] = self._fact(token)
        return at

    def _near(self, text: str) -> int:
        """Hits with a word of the second person at most ``NEAR`` words away."""
        you, waiting, near = -NEAR - 1, [], 0
        for i, m in enumerate(re.finditer(r"\S+", text)):
            f = self.facts[self._look(m.group())]
            if f[5]:
                near += sum(i - k <= NEAR for k in waiting)
                you, waiting = i, []
            if f[3] or f[13]:
                if i - you <= NEAR:
                    near += 1
                else:
                    waiting = [k for k in waiting if i - k <= NEAR] + [i]
        return near

    def __call__(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(self.NAMES))
        if not text:
            return out
        if len(self.index) > self.KNOWN:
            self._reset()
        counts = Counter(text.split() if len(text) < 1 << 20 else (m.group() for m in re.finditer(r"\S+", text)))
        if not counts:
            return out
        at = np.fromiter(map(self._look, counts), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.float64, len(counts))
        facts = self.facts[at]
        total = n @ facts
        words = max(total[0], 1.0)
        near = self._near(text) if total[3] or total[13] else 0
        out[:] = [math.log1p(total[0]), total[1] / words, total[2] / words, math.log1p(total[3]), facts[:, 4].max(),
                  total[5] / words, near / words, total[6] / max(total[7], 1.0), total[8] / words, total[9] / words,
                  total[10] / words, total[11] / len(text), *(total[12:] / words)]
        return out


def _measured(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """``rows`` (kept columns, text last) with the text replaced by features."""
    shipped = rows.sparkSession.sparkContext.broadcast(lexicon)  # at most LEXICON entries
    kept = rows.columns[:-1]

    def run(batches):
        measure, width = Measure(shipped.value), len(Measure.NAMES)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            x = np.zeros((batch.num_rows, width))
            for i in range(batch.num_rows):
                x[i] = measure(texts[i].as_py())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*kept, "x"])

    return rows.mapInArrow(run, rows.select(*kept).schema.add("x", ArrayType(DoubleType())))


def _bounded(rows: DataFrame, key: str, counts: dict[int, int], sample: int) -> DataFrame:
    """Rows (toxic, key) drawn by hash of ``key``, about ``sample`` a class."""
    draw, h = F.lit(False), F.pmod(F.xxhash64(F.lit("draw"), F.col(key)), F.lit(1 << 30))
    for toxic, n in counts.items():
        draw = draw | ((F.col("toxic") == toxic) & (h < int(min(1.0, sample / n) * (1 << 30))))
    return rows.filter(draw)


def _classes(rows: DataFrame) -> dict[int, int]:
    return {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows


def learn_lexicon(rows: DataFrame, most: int = LEXICON) -> dict[str, float]:
    """Weights of words and of word beginnings (``abcd*``) from (text, toxic)."""
    n = _classes(rows)
    if len(n) < 2:
        return {}
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w).between(2, 30)))
    stems = F.flatten(F.transform(words, lambda w: F.filter(F.array(
        w, *[F.when(F.length(w) > k, F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEMS]), lambda s: s.isNotNull())))
    seen = rows.select("toxic", F.explode(F.array_distinct(stems)).alias("stem")).groupBy("stem").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (n[1] + 1 - a)) - F.log(b / (n[0] + 1 - b))
    bound = odds - 3 * F.sqrt(1 / a + 1 / b)
    found = seen.filter("a >= 5").select("stem", bound.alias("weight")).filter("weight >= 1")
    return {r["stem"]: r["weight"] for r in found.orderBy(F.desc("weight"), "stem").limit(most).collect()}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1)."""
    one = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    n = _classes(one)
    model = {"lexicon": {}, "trees": None, "curve": None, "prior": n.get(1, 0) / max(1, sum(n.values()))}
    if len(n) < 2:
        return model
    ids = materialize(_bounded(one, "doc_id", n, sample), "toxicity-ids")  # bounded: about 2 * sample ids
    drawn = (docs.filter("text is not null").select("doc_id", F.col("text").cast("string")).join(F.broadcast(ids), "doc_id")
             .withColumn("digest", F.xxhash64("text")).groupBy("digest", "toxic").agg(F.first("text").alias("text")))
    drawn = materialize(drawn, "toxicity-texts")
    drawn = _bounded(drawn, "digest", _classes(drawn), 2 * sample)  # twice: ids that name one text each stay as drawn
    part = F.pmod(F.xxhash64(F.lit("part"), "digest"), F.lit(10))
    model["lexicon"] = learn_lexicon(drawn.filter(part < 4).select("text", "toxic"))
    rows = materialize(_measured(drawn.filter(part >= 4).select("toxic", (part >= 8).alias("late"), "text"), model["lexicon"]),
                       "toxicity-features").coalesce(4)
    share = {t: k / sum(n.values()) for t, k in n.items()}
    for late in (False, True):
        some = rows.filter(F.col("late") == late)
        have = _classes(some)
        if len(have) < 2:
            break
        weight = F.when(F.col("toxic") == 1, share[1] / have[1]).otherwise(share[0] / have[0]) * sum(have.values())
        some = some.select(F.col("toxic").cast("double").alias("label"), weight.alias("weight"), array_to_vector("x").alias("features"))
        if not late:
            model["trees"] = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, weightCol="weight", seed=7,
                                           minInstancesPerNode=3).fit(some)
        else:
            chance = model["trees"].transform(some).select("label", "weight", vector_to_array("probability")[1].alias("chance"))
            model["curve"] = IsotonicRegression(featuresCol="chance", weightCol="weight").fit(chance)
    return model


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``score``, from the column ``text``."""
    if model["trees"] is None:
        return docs.select(*keep, F.lit(float(model["prior"])).alias("score"))
    rows = _measured(docs.select(F.struct(*keep).alias("kept"), F.col("text").cast("string").alias("text")), model["lexicon"])
    rows = model["trees"].transform(rows.select("kept", array_to_vector("x").alias("features")))
    rows = rows.select("kept", vector_to_array("probability")[1].alias("chance"))
    found = F.col("chance")
    if model["curve"] is not None:
        rows = model["curve"].setPredictionCol("curved").transform(rows)
        found = 0.99 * F.col("curved") + 0.01 * F.col("chance")
    return rows.select("kept.*", F.least(F.lit(1.0), F.greatest(F.lit(0.0), found)).alias("score"))
