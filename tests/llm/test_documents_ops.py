"""MinHash, packing, word BPE, language ID, personal data, fingerprints and
sharding against brute force, over fixtures with nulls, empty and long texts,
ties, repeated rows, clashing columns and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gavel.llm import editprint, langid, minhash, packing, pii, sharding, wordbpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label long, rank string, key int"


def _words(rng, n):
    return " ".join("".join(rng.choice(["ta", "ri", "mo", "ke", "su", "lan"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def _rows():
    rng = random.Random(5)
    base = _words(rng, 60)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "ONE two"), (5, base), (6, base), (7, base.upper())]
    for i in range(8, 40):
        words = base.split(" ")
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = _words(rng, 1)
        rows.append((i, " ".join(words)))
    rows += [(40, _words(rng, 9000)), (41, "a" * 20000), (42, "übergröße čas 北京 \U0001f600  x\x1cy "), (6, base)]
    return [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 2}", 1, 2, "r", 3) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _sets(rows):
    out = {}
    for i, text, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def _components(sets, percent=75):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_minhash_equals_brute_force(docs):
    sets = _sets(_rows())
    want = _components(sets)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(_rows())
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (
            len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"]), r


def test_minhash_hot_family_loses_no_link(spark):
    """A family whose members straddle the threshold: all rounds take part."""
    rng = random.Random(9)
    base = _words(rng, 80).split(" ")
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(words)))
    want = _components(_sets(rows))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert len(set(want.values())) > 1


def test_minhash_rows_without_id(spark):
    rows = [(1, "a b c d e f"), (None, "a b c d e f"), (None, "other words stand here alone"), (None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str) == sorted(
        [(1, 2, 1, True), (None, 2, 1, False), (None, 1, None, True), (None, 0, None, True)], key=str)


def test_signature_estimate_is_close(spark):
    rng = random.Random(3)
    words = _words(rng, 400).split(" ")
    other = words[:300] + _words(rng, 100).split(" ")
    rows = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(other))], "doc_id long, text string")
    sig = minhash.signatures(rows)
    pair = sig.filter("doc_id = 0").select(F.col("planes").alias("x"), F.lit(1).alias("k")).join(
        sig.filter("doc_id = 1").select(F.col("planes").alias("y"), F.lit(1).alias("k")), "k")
    a, b = _sets([(0, " ".join(words)), (1, " ".join(other))]).values()
    true = len(a & b) / len(a | b)
    assert abs(pair.select(minhash.estimate("x", "y").alias("e")).first()["e"] - true) < 0.07


def _byte_ids(text):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return model.encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_and_sequences(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.materialize(packing.tokenized_pieces(docs, path), "t")
    by = defaultdict(list)
    for r in pieces.collect():
        by[r["doc_id"]].append(r)
    for i, text, *_ in _rows():
        ids = _byte_ids(text)
        rows = sorted(by[i], key=lambda r: r["piece"])
        rows = rows[:len(rows) // (2 if i == 6 else 1)] if i != 6 else rows[:1]
        assert b"".join(bytes(r["ids"]) for r in rows) == np.array(ids, "<u4").tobytes()
        assert all(r["length"] == 2048 for r in rows[1:]) and all(0 < r["length"] <= 2048 for r in rows)
        assert [r["start"] for r in rows] == list(np.cumsum([0, *[r["length"] for r in rows]])[:-1])
    placed = packing.pack(pieces.drop("ids"), ["doc_id", "piece"]).collect()
    assert len(placed) == sum(len(v) for v in by.values())
    bins = defaultdict(list)
    for r in placed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048


def test_special_token_text_and_odd_white_space(spark):
    texts = ["a <|endoftext|> b", "x<|endoftext|>", "a  b\n\n c\t", "tail   ", " \xa0 y\x1cz　q", " " * 300000 + "x", " \t" * 9000 + "y\x85z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = packing.tokenized_pieces(rows, public_tokenizers.path("byte_bpe_50k.json")).collect()
    got = {i: b"".join(bytes(r["ids"]) for r in sorted(pieces, key=lambda r: r["piece"]) if r["doc_id"] == i) for i in range(len(texts))}
    assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in pieces)
    for i, t in enumerate(texts):
        assert got[i] == np.array(_byte_ids(t), "<u4").tobytes(), t


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_the_histogram(seed):
    rng = np.random.default_rng(seed)
    capacity = 64
    counts = np.zeros(capacity + 1, np.int64)
    counts[1:] = rng.integers(0, 30, capacity) * (rng.random(capacity) < 0.6)
    left = counts.copy()
    for repeats, items in packing.plan_patterns(counts):
        assert repeats > 0 and sum(n * c for n, c in items) <= capacity
        for n, c in items:
            left[n] -= repeats * c
    assert not left.any()


def test_replacement_fills_more_tightly():
    """Greedy takes 6 + 3; the 3 gives way to 2 + 2 (capacity 10)."""
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]
    assert packing.plan_patterns(counts)[0] == (1, [(6, 1), (2, 2)])


def test_hot_length_ranks_are_gapless(spark):
    rows = packing.materialize(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(700).cast("long").alias("length")), "t")
    got = packing.pack(rows, ["doc_id"], salts=5).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert len(got) == 1500 and all(r["n"] == 1400 for r in got)


def test_pack_leaves_clashing_columns_and_spreads_equal_rows(spark):
    rows = spark.range(2000).selectExpr("1L AS doc_id", "1000L AS length", "'a' AS _salt", "2 AS _n", "3 AS _rank", "4 AS _before",
                                        "5 AS salt", "6 AS n", "7 AS rank", "8 AS row", "9L AS offset")
    got = packing.pack(rows, ["doc_id"], salts=7)
    assert got.columns == [*rows.columns[:-1], "sequence_id", "offset"]
    assert got.drop("sequence_id", "offset").distinct().collect() == rows.drop("offset").distinct().collect()
    bins = got.groupBy("sequence_id").agg(F.sort_array(F.collect_list("offset")).alias("o")).collect()
    assert len(bins) == 1000 and all(r["o"] == [0, 1000] for r in bins)


def test_word_bpe_equals_the_library(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    got = wordbpe.encode_decode(docs, path).collect()
    assert len(got) == len(_rows())
    text = {i: t or "" for i, t, *_ in _rows()}
    for r in got:
        ids = model.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert bytes(r["ids"]) == np.array(ids, "<u4").tobytes()
        assert r["decoded"] == model.decode(ids, skip_special_tokens=False)


def test_word_bpe_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(wordbpe, "BLOCK_WORDS", 7)
    rows = spark.createDataFrame([(i, f"the cat {i % 3} sat <|startoftext|> on É{i}") for i in range(30)], "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    for r in wordbpe.encode_decode(rows, path).collect():
        ids = model.encode(f"the cat {r['doc_id'] % 3} sat <|startoftext|> on É{r['doc_id']}", add_special_tokens=False).ids
        assert bytes(r["ids"]) == np.array(ids, "<u4").tobytes()


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn(
        "held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    out = langid.predict(docs, langid.train(docs.filter("not held")), ["doc_id", "lang", "held"]).filter("held").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_edge_cases(docs, empty):
    model = langid.train(docs.filter("text is not null").limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, model, ["doc_id"]).collect()} == {"und"}
    one = langid.train(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, one, ["doc_id"]).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[40] == "en"


def _base(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                  if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_samples_stay_bounded_on_skewed_rows(spark, monkeypatch):
    """Rows of one id, of none, and copies of one text."""
    rows = [(None if i % 2 else 7, f"the text number {i} of many", "en") for i in range(3000)]
    rows += [(None, "the same text", "en")] * 1000 + [(i, f"un autre texte {i}", "fr") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    featured = langid._featured
    monkeypatch.setattr(langid, "_featured", lambda labelled: seen.append(Counter(r["lang"] for r in labelled.collect())) or featured(labelled))
    langid.train(docs, 100)
    assert 50 <= seen[0]["en"] <= 150 and seen[0]["fr"] == 50
    texts = [f"copied text {i}" for i in range(200)]
    h = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("h")).collect()}
    hot = min(texts, key=h.get)  # the one that every draw takes first
    assert h[hot] < (1 << 30) * 100 / 3000
    copies = spark.createDataFrame([(hot,)] * 1000 + [(f"a text {i}",) for i in range(2000)], "text string")
    drawn = [r["text"] for r in pii.drawn_texts(copies, 100).collect()]
    assert drawn.count(hot) == 1 and 30 <= len(drawn) <= 130


def test_base_spans_equal_the_patterns():
    rng = random.Random(11)
    parts = ["a@b.c", "x.y+z@q-w.co.uk", "@", "a@@b.c.", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111",
             "4111-1111-1111-1111-", "+1 (415) 555-2671", "+44.20.7946.0958 ", "++1", " ", "é", "%", ".", "-", "9", "m@x.y@z.w", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == _base(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300000, "a" * 300000 + "@", "x@" + "a" * 300000, "1." * 150000, "+1" + " " * 200000, "@a" * 100000):
        pii.base_spans(text)


def test_skip_edges_carry_a_label(spark):
    docs = spark.createDataFrame([(1, "call +1 (415) 555-2671 now, later (415) 555-2671; no 12345678 here"), (2, "order 12345678 alone"),
                                  (3, None), (4, "")], "doc_id long, text string")
    model = pii.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    got = {r["doc_id"]: r for r in pii.find(docs, model, ["doc_id"]).collect()}
    assert [(s["kind"], s["start"]) for s in got[1]["added"]] == [("phone", 34)]
    assert not got[2]["base"] and not got[2]["added"] and not got[3]["base"] and not got[4]["base"]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).collect()}
    assert clean[1] == "call <PHONE> now, later <PHONE>; no 12345678 here"
    assert clean[3] is None and clean[4] == ""


def test_skip_edges_reach_every_repeat(spark):
    """Thirty repeats far apart, one of them recognised: first, last, in the middle."""
    model = pii.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    gap = " and then a good many words without any number follow here "
    texts, want = [], []
    for kind, known, other in ((3, "+1 (415) 555-2671", "14155552671"), (1, "10.200.30.41", "10 200 30 41")):
        for at in (0, 15, 30):
            parts = [known if i == at else other for i in range(31)]
            texts.append(gap.join(parts))
            starts = np.cumsum([0, *[len(x) + len(gap) for x in parts]])
            want.append([(kind, int(starts[i]), int(starts[i]) + len(other)) for i in range(31) if i != at])
    alone = [gap.join([other] * 31) for other in ("14155552671", "10 200 30 41")]  # nothing recognises them
    got = pii.label_texts([*texts, *alone], model)
    assert [added for _, added in got] == [*want, [], []]
    nodes = pii._nodes(texts[1], pii.base_spans(texts[1]))
    assert len(pii._edges(texts[1], nodes)) <= 3 * len(nodes)


def _walk(text, table):
    votes, seen, at, j = [0] * editprint.BITS, [0] * editprint.BITS, 0, 0
    sym = [((ord(c) * 2654435761) & 0xFFFFFFFF) >> 24 for c in text]
    while at < len(sym):
        x = int(table[(j % editprint.PERIOD) * 512 + sym[at]])
        votes[j % editprint.BITS] += 1 if x & 2 else -1
        seen[j % editprint.BITS] += 1
        at += x & 1
        j += 1
    return editprint._hex(*editprint._signs(np.array([votes]), np.array([seen])))[0]


def test_fingerprints_equal_a_plain_walk(docs):
    table = editprint._table()
    rows = sorted([(i, t or "") for i, t, *_ in _rows()])
    got = sorted(editprint.fingerprint_edited(docs, 3).collect(), key=lambda r: r["doc_id"])
    assert len(got) == len(rows)
    for k, r in enumerate(got):
        i, t = rows[k]
        nxt = rows[(k + 1) % len(rows)][1]
        edited = t[:len(t) - len(t) // 4] + nxt[:len(t) // 4]
        assert (r["doc_id"], r["n_chars"]) == (i, len(t))
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if i != 40:
            assert r["fingerprint"] == _walk(t, table)
            assert r["edited_fingerprint"] == _walk(edited, table)
    assert all(r["near_next"] == 1.0 for r in got if r["doc_id"] == 5)  # equal texts


def test_fingerprint_likeness_follows_edits(spark):
    rng = random.Random(1)
    text = _words(rng, 600)
    some = text[:500] + "xyz" + text[500:]
    whole, _ = editprint.sketch([text, some, _words(rng, 600)], [None] * 3)
    pick = lambda i: (whole[0][i:i + 1], whole[1][i:i + 1])
    assert editprint._likeness(pick(0), pick(1))[0] > 0.6 > 0.4 > editprint._likeness(pick(0), pick(2))[0]


def test_near_copies_by_edit_distance(docs):
    got = {r["doc_id"]: r["class_id"] for r in editprint.near_copies(docs).collect()}
    assert got[5] == got[6] == 5 and got[40] == 40 and got[0] == 0


def _within(a, b, most):
    """Whether the edit distance is ``most`` at most: the plain table, only its band."""
    if abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = i if not j else min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (a[i - 1] != b[j - 1]))
        if min(new.values()) > most:
            return False
        row = new
    return row[len(b)] <= most


def test_near_copies_equal_brute_force(spark):
    """Families with edits spread over up to a tenth of the text, short texts,
    and pairs just beyond the threshold."""
    rng = random.Random(17)
    rows = []
    for family in range(24):
        base = _words(rng, 12 if family < 3 else 45)[:40 if family < 3 else 200]
        rows.append(base)
        for most in (len(base) // 10, len(base) // 10, len(base) // 20, len(base) // 7):
            text, kind = list(base), rng.choice(["s", "i", "d", "sid"])
            for at in sorted(rng.sample(range(len(base)), most), reverse=True):
                one = rng.choice(kind)
                text[at:at + 1] = [] if one == "d" else ["#"] if one == "s" else ["#", text[at]]
            rows.append("".join(text))
    rows += ["", "ab", "abc", "a" * 30, "a" * 33, "\U0001f600" * 20, "\U0001f600" * 21]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    linked = 0
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            if a and rows[j] and _within(a, rows[j], max(len(a), len(rows[j])) // 10):
                linked += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert linked > 70
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in editprint.near_copies(df).collect()}
    assert got == {i: root(i) for i in range(len(rows))}


def test_single_row_and_empty_tables(spark, empty):
    one = spark.createDataFrame([(9, "abcdefgh")], "doc_id long, text string")
    r = editprint.fingerprint_edited(one, 2).collect()[0]
    assert r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    byte, word = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    assert editprint.fingerprint_edited(empty, 2).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    pieces = packing.materialize(packing.tokenized_pieces(empty, byte), "t")
    assert packing.pack(pieces, ["doc_id"]).count() == 0
    assert wordbpe.encode_decode(empty, word).count() == 0
    assert langid.predict(empty, langid.train(empty), ["doc_id"]).count() == 0
    assert pii.find(empty, pii.train(empty), ["doc_id"]).count() == 0
    assert sharding.interleave(empty.select("doc_id", "source"), "source", "doc_id", 4).count() == 0


def test_shards_match_the_mixture(spark):
    rows = [(i, None if i % 10 == 0 else "hot" if i % 3 else "cold", "x") for i in range(1000)] + [(5, "hot", "x")] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, shards string")
    got = sharding.interleave(df, "source", "doc_id", 7, cells=16).collect()
    assert len(got) == 1002
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
        for source in (None, "hot", "cold"):
            share = sum(r["source"] == source for r in got) / 7
            assert abs(sum(r["source"] == source and r["shard"] == s for r in got) - share) <= 2
    # the brute-force order: rank by digest in a source, then by fraction
    draw = lambda i: hashlib.md5(f"1/{i}".encode()).hexdigest()
    groups = defaultdict(list)
    for i, source, _ in rows:
        groups["" if source is None else "=" + source].append(i)
    order = sorted(((k + 0.5) / len(ids), s, i) for s, ids in groups.items()
                   for k, i in enumerate(sorted(ids, key=lambda i: (draw(i), i))))
    want = Counter((i, g * 7 // 1002) for g, (_, _, i) in enumerate(order))
    assert Counter((r["doc_id"], r["shard"]) for r in got) == want


def test_crc_columns_of_op9(spark):
    from gavel.llm import catalog

    sf = "/root/testdata/sf0.001"
    text = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in catalog.QUERIES["op9_interleave"](spark, sf).collect():
        assert (r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 1, zlib.crc32(text[r["doc_id"]]))
