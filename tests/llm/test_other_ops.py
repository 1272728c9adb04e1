"""Chat formatting, WARC and top-k against brute force; registered queries
against their SQL; the pipeline stage by stage."""

import time
import gzip
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import corpus_pipeline
from gavel.llm import catalog, chat, topk, warc
from gavel.llm.common import connected_components, shared_path

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "conversations"]


def _canon(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(float(r[i]) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i] for i in at))
                  for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(catalog.ORACLE[name])
    columns, rows = [d[0] for d in found.description], found.fetchall()
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert _canon([tuple(r) for r in df.collect()], df.columns) == _canon(rows, columns)


def _turns():
    control = ["</s>", "[INST]", "[/INST]", "<s>", "[NEXT]", "[END]", "[ROLE]", "\\", "<", "[", "x", "é\U0001f600", "\n", "/s>", ""]
    rng = random.Random(2)
    rows = [(i, t, rng.choice(["user", "assistant", "assistant", "system", "tool[/ROLE]", None]),
             None if rng.random() < 0.1 else "".join(rng.choice(control) for _ in range(rng.randint(0, 6))))
            for i in range(60) for t in range(rng.randint(1, 6))]
    return rows + [(None, 1, "user", "lost"), (7, None, "user", "early"), (8, 0, "user", "same"), (8, 0, "user", "same")]


def test_chat_gives_every_turn_back(spark):
    rows = _turns()
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], "conv_id long, turn long, role string, text string, loss int, formatted string")
    out = chat.format_conversations(df)
    got = out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("t"),
                     chat.loss_texts(F.col("formatted"), F.col("loss")).alias("lost")).collect()
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        turns = sorted([(-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"]])
        assert [(x["role"], x["text"]) for x in r["t"]] == [x[1:] for x in turns], r["formatted"]
        assert list(r["lost"]) == [x[2] for x in turns if x[1] == "assistant"]


def test_chat_merges_adjacent_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b</s>"), (1, 2, "assistant", "c")],
                               "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).first()["formatted"] == "<s>[INST]a[NEXT]b<\\/s>[/INST]c</s>"
    assert chat.format_conversations(df.limit(0)).count() == 0


def _pages(spark):
    big = "".join(f"<p>{i} é WARC/1.1\r\n WARC/1.1\r\n" for i in range(4000))
    rows = [(1, "http://a/ é", big), (2, "u", big), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
            (7, "u", "WARC/1.1\r\n" * 30), (8, "u", "y" * 16384), (9, "u", "z" * 99), (10, "u", "z" * 99), (11, "u", "q" * 100),
            (12, "u", "q" * 100), (13, "u\r\nWARC/1.1\r\n", "w" * 50000)]
    return rows, spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, type string")


def test_warc_round_trip(spark):
    rows, df = _pages(spark)
    path = shared_path(spark, "warc-test")
    warc.write_archive(df, path)
    got = {int(r["id"][len("<urn:page:"):-1]): r for r in warc.read_archive(spark, path).collect()}
    assert set(got) == {r[0] for r in rows}
    first = {}
    for page, _, html in rows:
        body = (html or "").encode()
        r = got[page]
        assert r["digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
        if len(body) >= 100 and first.setdefault(body, page) != page:
            assert (r["type"], r["refers_to"], r["body"]) == ("revisit", f"<urn:page:{first[body]}>", None)
        else:
            assert (r["type"], bytes(r["body"])) == ("response", body)
    types = [r["type"] for r in warc.read_records(spark, path).collect()]
    assert types.count("continuation") > 10


def _warc_rows(spark, rows, segment):
    path = shared_path(spark, "warc-test")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path, segment)
    got = warc.read_archive(spark, path).collect()
    return sorted((r["id"], r["type"], r["uri"] or "", None if r["body"] is None else bytes(r["body"]).decode()) for r in got)


def test_warc_version_at_the_seams(spark):
    """``WARC/1.1`` before a line end that only the framing adds: at a body's or
    chunk's end, at every place of a segment, at a url's end."""
    mark = "WARC/1.1"
    rows = [(1, "u", "ends with " + mark), (2, "u", "x" * (4096 - len(mark)) + mark + "y" * 10), (3, "http://a/" + mark, "z"),
            (4, mark, mark), (5, "u", mark + "\r"), (6, "u\n" + mark, mark + "\n")]
    rows += [(10 + k, "u", "-" * k + (mark + "." * 5) * 20 + mark) for k in range(64)]
    for segment in (64, warc.SEGMENT):
        assert _warc_rows(spark, rows, segment) == sorted(
            (f"<urn:page:{p}>", "response", u.replace("\n", "%20")[:-1] + "%31" if u.endswith(mark) else u, b) for p, u, b in rows)


def test_warc_rows_that_share_an_id(spark):
    big = [c * 500 for c in "abcd"]
    rows = [(None, "u", big[0]), (None, "u", big[1]), (None, "v", big[1]), (7, "u", big[2]), (7, "u", big[3]), (7, "v", big[3]),
            (7, "u", big[3]), (8, "w", big[3]), (9, "u", big[0])]
    want = [(f"<urn:page:{'' if p is None else p}>", "revisit" if p == 8 else "response", u, None if p == 8 else b) for p, u, b in rows]
    assert _warc_rows(spark, rows, 100) == sorted(want, key=lambda r: (r[0], r[1], r[2], r[3] or ""))


def test_warc_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "x" * 40000)] * 2 + [(2, "u", "s")] * 2, "page_id long, url string, html string")
    for frame, n in ((df, 4), (df.limit(0), 0)):
        path = shared_path(spark, "warc-test")
        warc.write_archive(frame, path)
        assert warc.read_archive(spark, path).count() == n if n else True


def test_warc_refuses_broken_archives(spark, tmp_path):
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\n"
    block = "HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
    good = f"{head}Content-Length: {len(block)}\r\n\r\n{block}\r\n\r\n"
    bad_length = f"{head}Content-Length: {len(block) - 1}\r\n\r\n{block}\r\n\r\n"
    bad_chunk = good.replace("5\r\nhello", "6\r\nhello")
    cut = f"{head}WARC-Segment-Number: 1\r\nContent-Length: {len(block)}\r\n\r\n{block}\r\n\r\n"
    for k, (text, ok) in enumerate([(good, True), (bad_length, False), (bad_chunk, False), (cut, False)]):
        folder = tmp_path / str(k)
        folder.mkdir()
        with gzip.open(folder / "a.warc.gz", "wb") as f:
            f.write(text.encode())
        read = lambda: warc.read_archive(spark, f"file://{folder}").collect()
        if ok:
            assert bytes(read()[0]["body"]) == b"hello"
        else:
            with pytest.raises(PySparkException):
                read()


def _vectors():
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 12)))]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (500, None), (501, [None] * 12), (502, [float("nan")] * 12),
             (503, [float("inf")] * 12), (504, [1.0, 2.0]), (600, [0.5, 0.5]), (700, [1e6] * 12), (800, []), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("block", [64, 5000])
def test_top_k_equals_brute_force(spark, block):
    df = spark.createDataFrame([(*r, 0) for r in _vectors()], "vec_id long, embedding array<double>, rank int")
    rows = topk.quantised(df, "vec_id", "embedding")
    got = topk.top_k(rows, rows.filter("vec_id % 100 = 0"), 10, block, 2).collect()
    ok = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in _vectors()
          if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, qv in {i: v for i, v in ok if i % 100 == 0}.items():
        scored = sorted(((-int(v @ qv), i) for i, v in ok if i != q and len(v) == len(qv)))[:10]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want
    assert topk.top_k(rows.limit(0), rows.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    rng = random.Random(8)
    names = rng.sample(range(1000), 200)
    edges = [(a, b) for part in (names[:120], names[120:]) for a, b in zip(part, part[1:])]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(part) for part in (names[:120], names[120:]) for n in part}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ugly = docs.limit(30).unionByName(spark.createDataFrame(
        [(90001, None, None, None, None), (90002, "12 34", "en", "s", 5), (90003, "", "de", "s", 0),
         (None, "A text without an id stays in the corpus.", "en", "s", 41)], docs.schema))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "redact_personal_data", "best_fit_packing"]
    before, seen = ugly, {}
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.common.materialize(stage(spark, before, SF), "t")
        seen[name] = after
        if name != "best_fit_packing":
            assert after.columns == docs.columns
            before = after
    kept = {r["doc_id"] for r in seen["language_id"].collect()}
    assert not kept & {90001, 90002, 90003} and len(kept) == 31 and None in kept
    assert seen["minhash_near_dedup"].count() <= 31
    packed = {r["doc_id"] for r in seen["best_fit_packing"].collect()}
    assert packed == {r["doc_id"] for r in seen["minhash_near_dedup"].collect()}


def test_pipeline_keeps_different_texts_under_one_id_and_clashing_columns(spark):
    """Two texts share an id, one is a copy of another row's; columns named like
    the stages' own."""
    words = [" ".join(f"the {w}{k} is and of {w}" for k in range(30)) for w in ("river", "stone", "cloud")]
    rows = [(5, words[0]), (5, words[1]), (5, words[1]), (3, words[2]), (9, words[2]), (None, words[2])]
    docs = spark.createDataFrame([(i, t, "en", "d", 1, "r", "x") for i, t in rows],
                                 "doc_id long, text string, lang string, document string, row int, _row string, id string")
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(
        [(5, words[0]), (5, words[1]), (3, words[2]), (None, words[2])], key=repr)
    assert corpus_pipeline.language_id(spark, docs, SF).columns == docs.columns


def test_pii_runs_around_an_at_are_whole():
    from gavel.llm import pii
    long = "a" * 300 + "@m\u00fcnchen." + "b" * 400
    text = f"mail {long} x@ @y a@b@c @@ q@r"
    assert [text[a:b] for a, b in pii._around_at(text)] == [long, "a@b", "q@r"]
    assert (-1, 5, 5 + len(long)) in pii._nodes(text, pii.base_spans(text)) or any(
        a <= 5 + len(long) and k > 0 for k, a, b in pii.base_spans(text))
    assert list(pii._around_at("@")) == [] and list(pii._around_at("x" * 100000)) == []


def test_chat_of_48000_turns(spark):
    """Offsets and merging grow with the turns, not with their square."""
    n = 48000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("</s> é\U0001f600"), F.col("id").cast("string")).alias("text"))
    started = time.time()
    got = chat.format_conversations(rows).select(
        F.size(chat.parse(F.col("formatted"))).alias("n"), F.sha2(F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss")), ""), 256).alias("h")).first()
    said = "".join(f"</s> é\U0001f600{i}" for i in range(n) if i % 3)
    assert (got.n, got.h) == (n, hashlib.sha256(said.encode()).hexdigest())
    assert time.time() - started < 60


def test_warc_page_of_12_mb(spark, tmp_path):
    page = spark.range(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.expr("repeat('é0123456789abcde', 786432)").alias("html"))
    started = time.time()
    warc.write_archive(page, f"{tmp_path}/a")
    got = warc.read_archive(spark, f"{tmp_path}/a").select(F.sha2("body", 256).alias("h")).first()
    assert got.h == hashlib.sha256("é0123456789abcde".encode() * 786432).hexdigest()
    assert time.time() - started < 90
