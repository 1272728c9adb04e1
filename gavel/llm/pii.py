"""Personal data by a skip-chain conditional random field.

Base spans come from fixed patterns and always stay. The field labels the nodes
of a document: base spans, whose label is observed, and other candidates (runs
of seven digits or more with light separators, strings around ``@``). A node's
own potential is a softmax over its shape; neighbours in the text share a chain
potential; repeated or similar nodes (same digits, same last seven digits, same
address but for case and dots) share a skip potential however far apart they
are. Loopy sum-product messages run over all documents of a batch at once, so a
number that is spelt in a way that no pattern takes is still found where the
document repeats it as a recognised one. Occurrences of one key are linked in a
row, and each open one to the nearest recognised one of its key, however many
repeats lie between: edges grow with the nodes, not with their pairs. Messages
run until they settle, document by document (a loop that swings is damped more
and more and left after ``MOST`` rounds).

Weights are trained on base labels of about ``sample`` texts drawn by hash;
Spark sums equal node shapes and pairs, only those sums reach the driver.

Defined cases: null or empty text has no spans; spans of different kinds may
overlap in the result, and are merged for redaction; repeated rows are separate
documents; an empty table gives no rows; a model trained on nothing adds
nothing but what the skip edges carry.
"""

from __future__ import annotations

import re
from bisect import bisect
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]
SAMPLE = 3000  # documents to train on, about
MOST, SETTLED, DAMPING, LEAST = 1000, 1e-3, 0.3, 0.6
NEAR = 40  # code points between chain neighbours, at most
AGREE = {"same": (30.0, 1.0), "similar": (12.0, 1.0)}  # prior counts of agreeing and differing skip pairs
SHAPES = 64

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DIGITS = re.compile(r"[(+]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
AFTER_AT = re.compile(r"[^\s@]+")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str):
    floor, at = 0, text.find("@")
    while at >= 0:
        start = floor + len(text[floor:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        floor = found.end() if found else at + 1
        at = text.find("@", floor)


def _around_at(text: str):
    """Runs without white space on both sides of an @, whole however long; each
    character is looked at once a side."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and not text[start - 1].isspace():
            start -= 1
        after = AFTER_AT.match(text, at + 1) if start < at else None
        if after:
            yield start, after.end()
        floor = after.end() if after else at + 1
        at = text.find("@", floor)


def _addresses(text: str):
    if "." not in text:
        return
    for run in DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        at, parts = run.start(), run[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start; code points."""
    found = [(0, a, b) for a, b in _emails(text)] + [(1, a, b) for a, b in _addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def _nodes(text: str, base: list) -> list[tuple[int, int, int]]:
    """(label or -1, start, end) in text order: base spans and candidates that
    touch none."""
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    more = [(m.start(), m.end()) for m in DIGITS.finditer(text)]
    if "@" in text:
        more += _around_at(text)
    nodes = [(k + 1, a, b) for k, a, b in base]
    for a, b in more:
        k = int(np.searchsorted(starts, b))
        if not k or reach[k - 1] <= a:
            nodes.append((-1, a, b))
    return sorted(nodes, key=lambda n: (n[1], n[2], n[0]))


def _shape(text: str, start: int, end: int) -> list[int]:
    """Numbers of the shape features that hold."""
    s = text[start:end]
    digits = NOT_DIGIT.sub("", s)
    n = len(digits)
    on = [0, 1 + min(n, 24)]
    checks = ["@" in s, s.startswith("+") or text[start - 1:start] == "+", "(" in s, "-" in s, "." in s, " " in s,
              16 <= n <= 19 and luhn(digits), text[start - 1:start].isalnum(), text[end:end + 1].isalnum(),
              s.count(".") == 3 and "@" not in s, "@" in s and "." in s.rpartition("@")[2], any(c.isalpha() for c in s)]
    return on + [27 + i for i, c in enumerate(checks) if c]


def _keys(text: str, start: int, end: int) -> tuple[str, str]:
    """Keys of repeated and of similar nodes."""
    s = text[start:end]
    if "@" in s:
        plain = s.casefold().strip(".,;:<>()[]\"'")
        return "@" + plain, "@" + plain.replace(".", "")
    digits = NOT_DIGIT.sub("", s)
    return digits, digits[-7:]


def _edges(text: str, nodes: list) -> list[tuple[int, int, str]]:
    edges = [(i, i + 1, "chain") for i, (x, y) in enumerate(pairwise(nodes)) if y[1] - x[2] <= NEAR]
    keys = [_keys(text, a, b) for _, a, b in nodes]
    for level, name in enumerate(("same", "similar")):
        rows: dict[str, list[int]] = {}
        for i, key in enumerate(keys):
            if len(key[level]) >= 7:
                rows.setdefault(key[level], []).append(i)
        for row in rows.values():
            links = set(pairwise(row))
            known = [i for i in row if nodes[i][0] > 0]
            for i in row if known else []:
                if nodes[i][0] < 0:
                    k = bisect(known, i)
                    j = min(known[max(0, k - 1):k + 1], key=lambda j: abs(nodes[j][1] - nodes[i][1]))
                    links.add((min(i, j), max(i, j)))
            edges += [(i, j, name) for i, j in sorted(links) if not level or keys[i][0] != keys[j][0]]
    return edges


def drawn_texts(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """About ``sample`` texts of ``docs`` or fewer; copies count as one text."""
    n = max(1, docs.count())
    return docs.select(F.col("text").cast("string")).filter(
        F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30))).distinct()


def train(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Potentials from base labels of a bounded sample of ``docs``."""
    drawn = drawn_texts(docs, sample)

    def run(batches):
        for batch in batches:
            what, a, b = [], [], []
            for text in batch.column(0):
                text = text.as_py() or ""
                nodes = _nodes(text, base_spans(text))
                label = [max(k, 0) for k, _, _ in nodes]
                for (_, s, e), y in zip(nodes, label):
                    what.append("shape " + " ".join(map(str, _shape(text, s, e))))
                    a.append(y)
                    b.append(0)
                for i, j, kind in _edges(text, nodes):
                    what.append(kind)
                    a.append(label[i])
                    b.append(label[j])
            yield pa.RecordBatch.from_arrays([pa.array(what, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32())],
                                             names=["what", "a", "b"])

    sums = drawn.mapInArrow(run, "what string, a int, b int").groupBy("what", "a", "b").agg(F.count("*").alias("n")).collect()
    size = len(LABELS)
    shapes = [(list(map(int, r["what"].split()[1:])), r["a"], r["n"]) for r in sums if r["what"].startswith("shape ")]
    weights = np.zeros((SHAPES, size))
    weights[0, 0] = 3.0  # an unknown shape is none
    if shapes:
        x = np.zeros((len(shapes), SHAPES))
        for i, (on, _, _) in enumerate(shapes):
            x[i, on] = 1
        y = np.eye(size)[[a for _, a, _ in shapes]]
        m = np.minimum([c for _, _, c in shapes], 1000.0)[:, None]
        for _ in range(400):  # softmax regression, full gradient with a ridge
            z = x @ weights
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            weights += 1.0 * (x.T @ (m * (y - p)) / m.sum() - 1e-4 * weights)
    chain = np.ones((size, size))
    agree = {k: list(v) for k, v in AGREE.items()}
    for r in sums:
        if r["what"] == "chain":
            chain[r["a"], r["b"]] += r["n"]
        elif r["what"] in agree and r["a"] and r["b"]:
            agree[r["what"]][r["a"] != r["b"]] += r["n"]
    chain /= chain.sum()
    chain = np.log(chain / (chain.sum(axis=1, keepdims=True) * chain.sum(axis=0, keepdims=True)))
    pair = {"chain": np.clip(chain, -1, 1)} | {k: np.eye(size) * np.log(a / b) for k, (a, b) in agree.items()}
    return {"weights": weights, "pair": pair}


def _beliefs(unary: np.ndarray, edges: list, pair: dict, group: np.ndarray) -> np.ndarray:
    """Loopy sum-product on log potentials; rows of label probabilities.
    ``group``: each node's document; one that has settled takes no more part."""
    if edges:
        src = np.array([e[0] for e in edges] + [e[1] for e in edges])
        dst = np.array([e[1] for e in edges] + [e[0] for e in edges])
        kinds = list(pair)
        k = np.array([kinds.index(e[2]) for e in edges])
        table = np.stack([pair[x] for x in kinds])
        table = np.concatenate([table[k], np.swapaxes(table[k], 1, 2)])
        half = np.arange(len(edges))  # edges that still change, each in both directions
        final = np.zeros((len(src), unary.shape[1]))
        for step in range(MOST):
            live = np.concatenate([half, half + len(edges)])
            back = np.concatenate([half + len(edges), half])
            total = unary.copy()
            np.add.at(total, dst[live], final[live])
            out = (total[src[live]] - final[back])[:, :, None] + table[live]
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - final[live]).max(axis=1)
            damping = max(DAMPING, 1 - 50 / (step + 1))
            final[live] = damping * final[live] + (1 - damping) * new
            moving = np.unique(group[src[live[change > SETTLED]]])
            half = half[np.isin(group[src[half]], moving)]
            if not len(half):
                break
        unary = unary.copy()
        np.add.at(unary, dst, final)
    p = np.exp(unary - unary.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def label_texts(texts: list[str], model: dict) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text, (kind number, start, end)."""
    out, unary, edges, open_nodes, group = [], [], [], [], []
    for t, text in enumerate(texts):
        base = base_spans(text)
        out.append((base, []))
        nodes = _nodes(text, base)
        if all(k > 0 for k, _, _ in nodes):
            continue  # nothing is left to label
        edges += [(i + len(unary), j + len(unary), kind) for i, j, kind in _edges(text, nodes)]
        group += [t] * len(nodes)
        for k, a, b in nodes:
            if k > 0:
                unary.append(np.where(np.arange(len(LABELS)) == k, 0.0, -30.0))
            else:
                open_nodes.append((len(unary), t, a, b))
                unary.append(model["weights"][_shape(text, a, b)].sum(axis=0))
    if open_nodes:
        belief = _beliefs(np.array(unary), edges, model["pair"], np.array(group))
        for i, t, a, b in open_nodes:
            k = int(belief[i].argmax())
            if k and belief[i, k] >= LEAST:
                out[t][1].append((k - 1, a, b))
    return out


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by its kind; overlapping spans merge
    under the first."""
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def _batches(batch, at: int, most: int = 1 << 20):
    lo = 0
    while lo < batch.num_rows:
        hi, size, texts = lo, 0, []
        while hi < batch.num_rows and (hi == lo or size < most):
            texts.append(batch.column(at)[hi].as_py() or "")
            size += len(texts[-1])
            hi += 1
        yield batch.slice(lo, hi - lo), texts
        lo = hi


def find(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with base and added: arrays of spans (kind,
    start, end), base ones by kind, then start."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part, texts in _batches(batch, batch.num_columns - 1):
                labelled = label_texts(texts, shipped.value)
                as_spans = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in x[i]] for x in labelled], span)
                            for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *as_spans], names=[*keep, "base", "added"])

    kind = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))
    schema = docs.select(*keep).schema.add("base", kind).add("added", kind)
    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def redact(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with every span of every text replaced by its kind; null texts
    stay null."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at, columns = docs.columns.index("text"), list(docs.columns)

    def run(batches):
        for batch in batches:
            for part, texts in _batches(batch, at):
                new = [redacted(t, base + added) for t, (base, added) in zip(texts, label_texts(texts, shipped.value))]
                nulls = part.column(at).is_null().to_pylist()
                text = pa.array([None if n else x for x, n in zip(new, nulls)], pa.string())
                yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(part.columns)], names=columns)

    return docs.mapInArrow(run, docs.schema)
