"""Toxicity by held-out accuracy and plain features, tokenizer alignment and the
conversation trie against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gavel.llm import align, catalog, toxicity, trie

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CONV = "conv_id long, turn long, role string, text string, head string, path int, up string, depth int, words string, salt int"


# ---------------------------------------------------------------- toxicity

def _labelled(n, seed=1):
    """Clean prose; every fifth text holds insults or an invented stem's forms."""
    rng = random.Random(seed)
    plain = ["the", "river", "You", "walks", "under", "bridges", "and", "sees", "old", "stones", "Water", "tur", "your", "light"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) + rng.choice(["", "", "a", "en", "iso"]) for _ in range(rng.randint(8, 60))]
        if i % 5 == 0:
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "glorp" + rng.choice("abcdefgh") * 2, "Moron!", "scum"])
        docs.append((i, " ".join(words), "x", 0.5, [1.0], "k"))
        labels.append((i, 1, int(i % 5 == 0)))
    return docs, labels


DOCS = "doc_id long, text string, kept string, score double, x array<double>, features string"


def test_toxicity_learns_words_and_stems(spark):
    docs, labels = _labelled(3000)
    docs = spark.createDataFrame(docs + [(None, None, None, None, None, None), (9000, "", "e", 1.0, None, None)], DOCS)
    labels = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None), (7, 0, 0), (9001, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs.filter("doc_id % 4 != 2"), labels.filter("doc_id % 4 != 2"))
    assert "glor*" in model["lexicon"] and "scum" in model["lexicon"] and "river" not in model["lexicon"]
    out = toxicity.score(docs, model, ["doc_id", "kept", "x", "features"])
    assert out.columns == ["doc_id", "kept", "x", "features", "score"]
    rows = out.collect()
    assert len(rows) == 3002 and all(0 <= r["score"] <= 1 for r in rows)
    held = [(r["doc_id"] % 5 == 0, r["score"] >= 0.3) for r in rows if r["doc_id"] is not None and r["doc_id"] < 3000 and r["doc_id"] % 4 == 2]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0
    copies = docs.filter("doc_id = 10").select("doc_id", F.concat("text").alias("text"), F.lit("other").alias("source"))
    assert len({r["score"] for r in toxicity.score(copies.union(copies), model, ["source"]).collect()}) == 1


def test_toxicity_without_labels_or_one_class(spark):
    docs, labels = _labelled(20)
    docs = spark.createDataFrame(docs, DOCS)
    clean = spark.createDataFrame([(i, 0) for i, *_ in labels], "doc_id long, toxic int")
    for some, score in ((clean.limit(0), 0.0), (clean, 0.0), (clean.select("doc_id", F.lit(1).alias("toxic")), 1.0)):
        got = toxicity.score(docs, toxicity.train(docs, some), ["doc_id"]).collect()
        assert len(got) == 20 and {r["score"] for r in got} == {score}


def test_features_of_plain_cases():
    m = toxicity.Measure({"glor*": 2.0, "zap": 3.0})
    f = dict(zip(m.NAMES, m("You GLORPIX!! i am a wo0ord, 1d10t zap")))
    words = 8
    assert f["words"] == pytest.approx(np.log1p(words))
    assert f["lexicon"] == pytest.approx((2 + 3) / words) and f["hits"] == pytest.approx(np.log1p(2)) and f["strongest"] == 3
    assert f["second_person"] == pytest.approx(1 / words) and f["exclaims"] == pytest.approx(2 / words)
    assert f["shouted"] == pytest.approx(1 / words) and f["lone"] == pytest.approx(2 / words)
    assert f["masked"] == pytest.approx(2 / words) and f["masked_hits"] == pytest.approx(1 / words)
    assert f["near"] == pytest.approx(1 / words)  # the second hit is seven words away
    assert not m(None).any() and not m("").any() and not m(" \n ").any()
    long = "word " * 300000 + "zap"  # beyond the size that is split at once
    assert m(long)[m.NAMES.index("hits")] == pytest.approx(np.log1p(1))


# --------------------------------------------------------------- alignment

def _brute(rows):
    """Per row (doc_id, n_a, n_b, groups, links) and the corpus-wide counts."""
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)

    def spans(tokens):
        at, out = 0, []
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    found, total = [], Counter()
    for doc_id, text in rows:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        xa = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        xb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(xa) != whole or b"".join(xb) != whole:
            found.append((doc_id, 0, 0, [], []))
            continue
        sa, sb = spans(xa), spans(xb)
        links, j = [], 0
        for i, (s, e) in enumerate(sa):
            while sb[j][1] <= s:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < e:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        ends = {e for _, e in sa} & {e for _, e in sb}
        groups, ga, gb, j = [], [], [], 0
        for i, (_, e) in enumerate(sa):
            ga.append(ids_a[i])
            if e in ends:
                while j < len(sb) and sb[j][1] <= e:
                    gb.append(ids_b[j])
                    j += 1
                groups.append((ga, gb))
                ga, gb = [], []
        total.update(links)
        found.append((doc_id, len(ids_a), len(ids_b), groups, links))
    return found, total


def _texts():
    rng = random.Random(4)
    parts = ["the ", "  ", "\n", "\t", "caf\u00e9", "\u00fcber", "\u5317\u4eac", "\U0001f600", "<|endoftext|>", "<s>", "</s>", "don't", "12345", "...",
             "\x00", "\x1c", "\xa0", "\u3000", "qzx", "ing "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    return [None, "", " ", "a", "\u2581x", "x\u2581 y", "<unk>", *texts, texts[0], "word " * 3000, "b" * 5000, " " * 4000 + "x"]


@pytest.mark.parametrize("block", [align.BLOCK, 40])
def test_alignment_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(align, "BLOCK", block)
    monkeypatch.setattr(align, "CHUNK", 1 << 19 if block > 40 else 64)
    rows = [(None if i == 9 else i // 2 * 2, t) for i, t in enumerate(_texts())]
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, block long, places string")
    found, total = _brute(rows)
    most = defaultdict(int)
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    want = []
    for doc_id, n_a, n_b, groups, links in found:
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        want.append((doc_id, n_a, n_b, len(groups), len(links), sum(total[p] == most[p[1]] for p in links),
                     sum(total[p] for p in links), hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    got = align.measured(docs, PATH_A, PATH_B).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    real = align.alignments(docs, PATH_A, PATH_B).collect()
    plain = [(r["doc_id"], [(list(g["a"]), list(g["b"])) for g in r["groups"]]) for r in real]
    assert sorted(map(repr, plain)) == sorted(repr((f[0], f[3])) for f in found)


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in align.measured(docs, PATH_A, PATH_B).collect()) == [(1, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0)]
    assert align.measured(docs.limit(0), PATH_A, PATH_B).count() == 0


# -------------------------------------------------------------------- trie

def _conversations():
    rng = random.Random(8)
    said = [("user", "hello there"), ("assistant", "well  a b c"), ("user", ""), (None, None), ("tool", "x\ny"), ("", "assistant")]
    rows = []
    for c in [*range(0, 130), 400, 405, 1021, -3, -20]:
        if c % 7 == 3:  # copies of one conversation
            rows += [(c, t, "user", f"same {t}") for t in range(3)]
            continue
        rows += [(c, rng.choice([None, t, t]) if t else t, *rng.choice(said[:2] if t < 2 else said)) for t in range(rng.randint(1, 6))]
    rows = {(c, t): (c, t, r, x) for c, t, r, x in rows}.values()  # ties of a number are ordered by hash: tested apart
    return [*rows, (None, 0, "user", "lost")]


def _nodes(rows):
    words = lambda x: len([w for w in __import__("re").split("[\x20\x09-\x0D]+", x) if w])
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((-1 << 70) if t is None else t, r or "", x or ""))
    own = {c: [v[1:] for v in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rest = int(np.fmod(c, 20))
        built[c] = tuple(own.get(c - rest, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = []
    for node, cs in members.items():
        below = [m for m in members if m[:len(node)] == node]
        kids = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(k[:-1] == m for k in below if k)]
        saved = sum((len(members[m]) - 1) * words(m[-1][1]) for m in below if m)
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("container", [trie.CONTAINER, 4, 1])
def test_trie_equals_brute_force(spark, container):
    rows = _conversations()
    df = spark.createDataFrame([(*r, "h", 1, "u", 2, "w", 3) for r in rows], CONV)
    got = trie.nodes(trie.rebuilt(trie.turn_lists(df)), container)
    want = _nodes(rows)
    got = [tuple(r) for r in got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                        "ends_sha256").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_trie_ties_repeats_and_empty_table(spark):
    rows = [(1, 1, "user", "a"), (1, 1, "user", "a"), (1, 1, "user", "b"), (2, None, None, None)]
    df = spark.createDataFrame([(*r, "h", 1, "u", 2, "w", 3) for r in rows], CONV)
    lists = trie.turn_lists(df)
    assert {r["conv_id"]: len(r["turns"]) for r in lists.collect()} == {1: 3, 2: 1}
    assert sorted(map(tuple, lists.collect())) == sorted(map(tuple, trie.turn_lists(df.repartition(3)).collect()))
    assert trie.nodes(trie.rebuilt(trie.turn_lists(df.limit(0)))).count() == 0


def test_trie_digest_spans_packets(spark, monkeypatch):
    monkeypatch.setattr(trie, "PACKET", 50)
    convs = spark.range(3000).selectExpr("id AS conv_id", "array(named_struct('id', md5(string(id % 2)), 'words', 2L)) AS turns")
    got = {r["conv_id"]: r for r in trie.nodes(convs.repartition(5), 1).filter("depth = 1").collect()}
    for first in (0, 1):
        ids = ",".join(str(i) for i in range(first, 3000, 2))
        assert got[first]["ends_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
        assert (got[first]["n_convs"], got[first]["saved_tokens"]) == (1500, 1499 * 2)


def test_new_queries_are_registered():
    assert {"op11_boosted_trees", "op12_align", "op13_burst_trie"} <= catalog.QUERIES.keys()
