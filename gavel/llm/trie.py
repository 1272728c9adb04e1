"""Prefix trie of conversations, built as a burst trie.

A turn's id is the MD5 of its role and text, 32 hex digits, so a conversation is
one string, a prefix of turns a prefix of it, and string order is trie order.
Texts never leave the scan.

* Equal sequences are collapsed first (smallest id, copies, digest of their
  ids), so a group of copies is one row however large it is. The digest of a
  group is streamed: ids are range-sorted by (sequence, id) over all tasks,
  packed into texts of about ``PACKET`` bytes, and a task per group hashes only
  the packets.
* Burst: a container holds the sequences below one trie head. Containers with
  more than ``CONTAINER`` sequences become trie nodes and deal their sequences
  to new containers by the next turn id; the others wait. A round is one
  map-side combined aggregate and one join with the few oversized heads, both
  salted, so the root or a common first turn is no hot key. There are as many
  rounds as turns that more than ``CONTAINER`` sequences have in common.
* Sweep: the remaining containers are dealt to shards by head, sorted in the JVM
  and swept by one pass in each task: a stack holds the open path, and a node is
  complete when the next sequence leaves it. Memory is one container.
* The burst nodes take their children, leaves and saved tokens from the round
  below, deepest first.

``nodes`` gives one row per distinct sequence of leading turns, from the root of
depth 0: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
n_leaves, saved_tokens (over the subtree, copies beyond the first times the
words of the last turn) and ends_sha256 (ids that end there).

Defined cases: null role or text is the empty string; a null turn number comes
first, equal numbers are ordered by role and turn id; rows without a conv_id
belong to no conversation; an empty table has no nodes; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import materialize

CONTAINER = 1024
SALTS = 64
PACKET = 1 << 16
WIDTH = 32  # of a turn id
NODE_SCHEMA = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
               "saved_tokens long, ends_sha256 string, up string")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's (id, words) in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")
    coded = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("numbered"), "turn", role.alias("role"),
        F.md5(F.concat_ws("\n", F.octet_length(role).cast("string"), role, text)).alias("id"), words.alias("words"))
    listed = coded.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("numbered", "turn", "role", "id", "words"))).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["words"].alias("words"))).alias("turns"))


def rebuilt(lists: DataFrame, heads: int = 4, family: int = 20) -> DataFrame:
    """(conv_id, turns): the first h turns of the family's first conversation,
    then the own turns after the first h; h is crc32(conv_id) % ``heads``."""
    lists = materialize(lists, "trie-turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    first = lists.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, max(1, heads - 1)).alias("head"))
    named = lists.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", h)
    own = F.when(F.col("h") < F.size("turns"), F.slice("turns", F.col("h") + 1, F.greatest(F.lit(1), F.size("turns"))))
    given = F.when(F.col("h") > 0, F.slice("head", F.lit(1), F.greatest(F.lit(1), F.col("h"))))
    none = F.slice("turns", 1, 0)
    return named.join(first, "base", "left").select("conv_id", F.concat(F.coalesce(given, none), F.coalesce(own, none)).alias("turns"))


def _packets(rows: DataFrame) -> DataFrame:
    """Rows (key, conv_id), sorted within partitions, as (key, first, ids): runs
    of one key's ids as decimal text."""

    def run(batches):
        key, ids, size = None, [], 0
        for batch in batches:
            out = []
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key or size >= PACKET:
                    if ids:
                        out.append((key, int(ids[0]), ",".join(ids)))
                    key, ids, size = k, [], 0
                ids.append(str(i))
                size += len(ids[-1]) + 1
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("key", "first", "ids"), r)) for r in out])
        if ids:
            yield pa.RecordBatch.from_pylist([{"key": key, "first": int(ids[0]), "ids": ",".join(ids)}])

    return rows.mapInArrow(run, "key string, first long, ids string")


def _digests(packets: DataFrame) -> DataFrame:
    """(key, ends_sha256) of packets sorted by (key, first) within partitions."""

    def run(batches):
        key, digest = None, None
        for batch in batches:
            keys, found = [], []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
                if k != key:
                    if digest is not None:
                        keys.append(key)
                        found.append(digest.hexdigest())
                    key, digest = k, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_py().encode())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(found)], names=["key", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    return packets.mapInArrow(run, "key string, ends_sha256 string")


def sequences(convs: DataFrame) -> DataFrame:
    """(path, words, conv_id, copies, ends): the distinct sequences of (conv_id, turns)."""
    path = F.array_join(F.transform("turns", lambda t: t["id"]), "")
    rows = convs.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))
    rows = materialize(rows.withColumn("key", F.md5("path")), "trie-paths")
    packets = materialize(_packets(rows.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions(
        "key", "conv_id")), "trie-packets")
    ends = _digests(packets.repartition("key").sortWithinPartitions("key", "first"))
    one = rows.groupBy("key").agg(F.min_by(F.struct("path", "words"), "conv_id").alias("s"), F.min("conv_id").alias("conv_id"),
                                  F.count("*").alias("copies"))
    return materialize(one.join(ends, "key").select("s.path", "s.words", "conv_id", "copies", F.col("ends_sha256").alias("ends")),
                       "trie-sequences")


def _salted(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def burst(rows: DataFrame, container: int = CONTAINER) -> tuple[list[DataFrame], list[DataFrame]]:
    """Containers that need no burst, a table a round, and the trie heads of the
    others, a table a depth: (head, up, parent_conv_id, conv_id, n_convs, words,
    ends)."""
    done, heads, depth = [], [], 0
    rows = rows.select("*", F.lit("").alias("head"), F.lit(None).cast("string").alias("up"),
                       F.lit(None).cast("long").alias("parent_conv_id"))
    while True:
        stands = F.length("path") == WIDTH * depth
        facts = materialize(rows.groupBy("head", "up", "parent_conv_id").agg(
            F.count("*").alias("rows"), F.min("conv_id").alias("smallest"), F.sum("copies").alias("n_convs"),
            F.max(F.get("words", F.lit(depth - 1))).alias("words"), F.max(F.when(stands, F.col("ends"))).alias("ends"))
            .filter(F.col("rows") > container), "trie-heads")
        if facts.isEmpty():
            done.append(rows.withColumn("depth", F.lit(depth)))
            return done, heads
        heads.append(facts.select("head", "up", "parent_conv_id", F.col("smallest").alias("conv_id"), "n_convs",
                                  F.coalesce("words", F.lit(0)).alias("words"), "ends"))
        big = facts.select("head", "smallest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        dealt = materialize(rows.withColumn("salt", _salted("conv_id")).join(big, ["head", "salt"], "left").drop("salt"), "trie-burst")
        done.append(dealt.filter("smallest is null").drop("smallest").withColumn("depth", F.lit(depth)))
        depth += 1
        rows = dealt.filter(F.col("smallest").isNotNull() & (F.length("path") >= WIDTH * depth)).select(
            "path", "words", "conv_id", "copies", "ends", F.md5(F.substring("path", 1, WIDTH * depth)).alias("head"),
            F.col("head").alias("up"), F.col("smallest").alias("parent_conv_id"))


def _swept(batches):
    """Nodes of containers sorted by (head, path); columns: head, path, conv_id,
    copies, words, ends, up, parent_conv_id, depth."""
    out, stack, head, path = [], [], None, ""

    def close():
        smallest, n, words, ends, kids, leaves, saved, up, parent, depth = node = stack.pop()
        if not kids:
            leaves = node[5] = 1
        saved = node[6] = saved + (n - 1) * words
        for k in kids:
            out.append((k[0], k[9], smallest, k[1], k[4], k[5], k[6], k[3], None))
        node[4] = len(kids)
        if stack:
            top = stack[-1]
            top[0], top[1] = min(top[0], smallest), top[1] + n
            top[4].append(node)
            top[5] += leaves
            top[6] += saved
        else:
            out.append((smallest, depth, parent, n, len(kids), leaves, saved, ends, up))

    def flush(least):
        if len(out) < least:
            return
        names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
        schema = pa.schema([(c, pa.string() if c in ("ends_sha256", "up") else pa.int64()) for c in names])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        out.clear()

    for batch in batches:
        for h, p, conv, copies, words, ends, up, parent, depth in zip(*(c.to_pylist() for c in batch.columns)):
            if h != head:
                while stack:
                    close()
                head, common, base = h, depth - 1, depth
            else:
                common, most = base, min(len(p), len(path)) // WIDTH
                while common < most and p[WIDTH * common:WIDTH * (common + 1)] == path[WIDTH * common:WIDTH * (common + 1)]:
                    common += 1
                while len(stack) > common - base + 1:
                    close()
            size, path = len(p) // WIDTH, p
            for d in range(common + 1, size + 1):  # smallest, n, words, ends, children, leaves, saved, up, parent, depth
                stack.append([conv, 0, words[d - 1] if d else 0, NO_ENDS, [], 0, 0, up, parent, d])
            top = stack[-1]  # the sequence ends here
            top[0], top[1], top[3] = min(top[0], conv), top[1] + copies, ends
        yield from flush(20000)
    while stack:
        close()
    yield from flush(1)


def sweep(containers: DataFrame) -> DataFrame:
    """Node rows of whole containers; ``up`` names the trie head above a top node."""
    rows = containers.select("head", "path", "conv_id", "copies", "words", "ends", "up", "parent_conv_id", "depth")
    return rows.repartition("head").sortWithinPartitions("head", "path").mapInArrow(_swept, NODE_SCHEMA)


def nodes(convs: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The trie's nodes of (conv_id, turns), turns an array of (id, words)."""
    done, heads = burst(sequences(convs), container)
    containers = done[0]
    for more in done[1:]:
        containers = containers.unionByName(more)
    found = materialize(sweep(containers), "trie-nodes")
    columns = [c for c in found.columns if c != "up"]
    out, tops = found.select(columns), found.filter("up is not null")
    for depth in range(len(heads) - 1, -1, -1):
        below = tops.groupBy(F.col("up").alias("head")).agg(
            F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        at = materialize(heads[depth].join(below, "head").select(
            "conv_id", F.lit(depth).cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
            (F.col("below") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
            F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"), "up"), "trie-upper")
        out = out.unionByName(at.select(columns))
        tops = found.filter("up is not null").unionByName(at.filter("up is not null"))
    return out
