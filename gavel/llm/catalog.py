"""Registered queries of the training-data operators, each a thin layer that
derives the contract's columns from an operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.llm import align, chat, editprint, langid, minhash, packing, pii, sharding, topk, toxicity, trie, warc, wordbpe
from gavel.llm.common import materialize, shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed_documents(docs: DataFrame) -> DataFrame:
    pieces = packing.tokenized_pieces(docs, _tokenizer("byte_bpe_50k.json"), ids=False)
    return packing.pack(pieces.drop("ids"), ["doc_id", "piece", "ids_crc32"])


def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(_table(spark, sf_dir, "documents"))


def op3_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = wordbpe.encode_decode(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{said}' AS text "
                      "FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_conversations(turns).select("conv_id", "formatted", "loss", chat.parse(F.col("formatted")).alias("t"))
    lines = F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    out = out.withColumn("lost", F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss")), ""))
    return out.select("conv_id", F.size("t").cast("long").alias("n_turns"),
                      F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
                      F.char_length("lost").cast("long").alias("loss_chars"),
                      F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"),
                      F.char_length("formatted").cast("long").alias("formatted_chars"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1)  # noqa: E731
    rows = materialize(warc.read_archive(spark, path).select(
        "type", F.nullif(page("id"), F.lit("")).cast("long").alias("page_id"),
        page("refers_to").alias("refers_to"), F.regexp_extract("digest", "^sha256:(.*)$", 1).alias("stated"), F.octet_length("body").cast("long").alias("payload_bytes"),
        F.sha2("body", 256).alias("payload_digest")), "warc-rows")  # the archive is read once
    responses = rows.filter("type = 'response'")
    full = responses.select(F.col("page_id").alias("first"), "payload_bytes", "payload_digest").dropDuplicates(["first", "payload_digest"])
    revisits = rows.filter("type = 'revisit'").select("page_id", F.col("refers_to").cast("long").alias("first"),
                                                      F.col("stated").alias("payload_digest")).join(full, ["first", "payload_digest"])
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
                            F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"),
                        F.col("first").alias("refers_to"))).select(*columns)


def op6_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"))
    return langid.predict(docs, langid.train(docs.filter("not held_out")), ["doc_id", "held_out"])


def op7_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs), ["doc_id"])
    order = F.array(*[F.lit(k) for k in pii.KINDS])

    def listed(spans):
        keyed = F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"], s["end"]))
        return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(
            ":", F.element_at(order, s["k"].cast("int")), s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")  # noqa: E731
    return found.select("doc_id", *[count(k) for k in pii.KINDS],
                        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op8_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.fingerprint_edited(_table(spark, sf_dir, "documents"))


def op9_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.interleave(rows, "source", "doc_id", 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source")


def op10_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantised(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(rows, rows.filter("vec_id % 100 = 0"), 10)


def op11_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    model = toxicity.train(docs.filter("not held_out"), _table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.measured(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.rebuilt(trie.turn_lists(_table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_best_two_fit": op2_best_two_fit,
    "op3_word_bpe": op3_word_bpe,
    "op4_chat": op4_chat,
    "op5_warc": op5_warc,
    "op6_hierarchical": op6_hierarchical,
    "op7_skip_chain": op7_skip_chain,
    "op8_edit_embedding": op8_edit_embedding,
    "op9_interleave": op9_interleave,
    "op10_bit_sliced": op10_bit_sliced,
    "op11_boosted_trees": op11_boosted_trees,
    "op12_align": op12_align,
    "op13_burst_trie": op13_burst_trie,
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE: dict[str, str] = {
    "op1_minhash": rf"""
        WITH RECURSIVE w AS MATERIALIZED (
          SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                 '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (
          SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
              FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
              WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
        u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(doc_id, reach) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.reach),
        c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
        SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept
        FROM c LEFT JOIN n ON n.doc_id = c.doc_id""",
    "op4_chat": r"""
        WITH turns AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
          UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        sized AS (
          SELECT *, length(text) + length(text) - length(replace(text, chr(92), ''))
              + len(regexp_extract_all(replace(text, chr(92), chr(92) || chr(92)),
                    '(<|\[)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|NEXT\]|END\])')) AS esc,
            role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS opens
          FROM turns)
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          (3 + sum(esc + CASE WHEN NOT opens THEN 6 WHEN role = 'system' THEN 11 WHEN role = 'user' THEN 13
             WHEN role = 'assistant' THEN 4 ELSE 18 + length(role) END))::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op5_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS digest,
                min(page_id) OVER (PARTITION BY sha256(body)) AS first FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
          CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
        FROM d""",
    "op9_interleave": r"""
        WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k:
                     CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        b AS (SELECT doc_id, source, encode(coalesce(text, '')) AS x FROM documents),
        h AS (SELECT *, list_transform(string_split(regexp_replace(hex(x), '(..)', '0x\1,', 'g'), ','),
                     lambda y: try_cast(y AS BIGINT)) AS bytes FROM b),
        d AS (SELECT doc_id, source, octet_length(x) + 1 AS size, md5('1/' || doc_id) AS u,
                CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS s,
                xor(list_reduce([4294967295::BIGINT] || list_filter(bytes, lambda y: y IS NOT NULL),
                    lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1])), 4294967295) AS text_crc32 FROM h, t),
        r AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY u, doc_id) - 1 + 0.5::DOUBLE)
                / count(*) OVER (PARTITION BY s) AS f FROM d),
        g AS (SELECT *, row_number() OVER (ORDER BY f, s, doc_id) - 1 AS g, count(*) OVER () AS n FROM r)
        SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (g * 16 // n)::INT AS shard,
          (g - (g * 16 // n * n + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard, source FROM g""",
    "op10_bit_sliced": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op13_burst_trie": r"""
        WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k:
                     CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        o AS MATERIALIZED (
          SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
            coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        c AS MATERIALIZED (
          SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce([4294967295::BIGINT] || list_transform(
              string_split(conv_id::VARCHAR, ''), lambda y: ascii(y)::BIGINT),
              lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1])), 4294967295) % 4 AS h
          FROM (SELECT DISTINCT conv_id FROM o), t),
        r AS MATERIALIZED (
          SELECT c.conv_id, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.h
          UNION ALL SELECT c.conv_id, o.pos + 3, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
        n AS MATERIALIZED (
          SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth,
            md5(length(role) || ':' || role || ':' || text) AS turn, len(list_filter(string_split_regex(text,
              '[ 	

]+'), lambda x: x <> '')) AS words FROM r),
        p AS MATERIALIZED (
          SELECT conv_id, depth, words, md5(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node,
            count(*) OVER (PARTITION BY conv_id) AS len FROM n
          UNION ALL SELECT c.conv_id, 0, 0, md5(''), coalesce(l.len, 0) FROM c LEFT JOIN (
            SELECT conv_id, count(*) AS len FROM n GROUP BY conv_id) l ON l.conv_id = c.conv_id),
        a AS MATERIALIZED (
          SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len), '')) AS ends_sha256
          FROM p GROUP BY node),
        e AS MATERIALIZED (
          SELECT a.node, u.node AS up, m.conv_id AS parent_conv_id FROM a
          LEFT JOIN p u ON u.conv_id = a.conv_id AND u.depth = a.depth - 1 LEFT JOIN a m ON m.node = u.node),
        k AS (SELECT up AS node, count(*) AS n_children FROM e WHERE up IS NOT NULL GROUP BY up),
        s AS (
          SELECT u.node, sum((a.n_convs - 1) * a.words) AS saved, count(*) FILTER (k.node IS NULL) AS leaves
          FROM a LEFT JOIN k ON k.node = a.node JOIN p u ON u.conv_id = a.conv_id AND u.depth <= a.depth GROUP BY u.node)
        SELECT a.conv_id, a.depth, e.parent_conv_id, a.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
          s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, a.ends_sha256
        FROM a JOIN e ON e.node = a.node JOIN s ON s.node = a.node LEFT JOIN k ON k.node = a.node""",
}
