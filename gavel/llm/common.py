"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's shared folder (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at a
    table that every executor can read again after a loss."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, most: int = 1 << 21):
    """Consecutive row ranges of about ``most`` bytes, one row at least."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield start, end
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the
    smallest node reachable.

    Each round hooks every root to its smallest neighbour, follows the hooks to
    their roots by pointer doubling and contracts the edges. Only joins and
    map-side combined minima, so no neighbourhood is ever gathered in a task;
    rounds end at tables in the shared folder.
    """
    cur = materialize(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                      .filter("hi <> lo").distinct(), "cc-edges")
    labels = cur.select(F.col("hi").alias("node")).union(cur.select("lo")).distinct().withColumn("label", F.col("node"))
    while not cur.isEmpty():
        up = materialize(cur.groupBy("hi").agg(F.min("lo").alias("parent")), "cc-hooks")
        while True:
            nxt = up.alias("x").join(up.select(F.col("hi").alias("h2"), F.col("parent").alias("p2")),
                                     F.col("parent") == F.col("h2"), "left")
            nxt = materialize(nxt.select("hi", F.coalesce("p2", "parent").alias("parent"),
                                         F.col("p2").isNotNull().alias("moved")), "cc-jump")
            moved = not nxt.filter("moved").isEmpty()
            up = nxt.select("hi", "parent")
            if not moved:
                break
        labels = materialize(labels.join(up, labels["label"] == up["hi"], "left")
                             .select("node", F.coalesce("parent", "label").alias("label")), "cc-labels")
        ua, ub = up.select(F.col("hi").alias("ka"), F.col("parent").alias("pa")), up.select(
            F.col("hi").alias("kb"), F.col("parent").alias("pb"))
        mapped = (cur.join(ua, F.col("hi") == F.col("ka"), "left").join(ub, F.col("lo") == F.col("kb"), "left")
                  .select(F.coalesce("pa", "hi").alias("x"), F.coalesce("pb", "lo").alias("y")))
        cur = materialize(mapped.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo"))
                          .filter("hi <> lo").distinct(), "cc-edges")
    return labels.select("node", F.col("label").alias("component"))


def link_buckets(rows: DataFrame, members: DataFrame, likely: Callable[[str, str], Column], least: float,
                 confirm: Callable[[DataFrame], DataFrame], star_rounds: int = 2) -> DataFrame:
    """(rep, label): connected components of the confirmed links between
    members that share a bucket; label is the smallest member reachable.

    ``rows``: (key, band, rep), the buckets with two members or more, one key a
    band and member. ``members``: (rep, bands, sig), the keys in band order and
    a signature. ``likely(x, y)`` estimates the similarity of two signature
    columns, pairs below ``least`` are dropped; ``confirm`` keeps the pairs (a,
    b) that are links.

    In a bucket each member meets only the bucket's centre, the member with
    the heaviest buckets, and of its centres only the likeliest; members
    already in the centre's component need no test. After ``star_rounds`` such
    rounds, all pairs that are left in one bucket but in two components are
    estimated inside the bucket join, each pair in the first band it shares,
    and confirmed in full. So no link that a bucket holds is lost, and no
    bucket's pairs are emitted.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    weight = materialize(rows.join(sizes, "key").groupBy("rep").agg(F.sum("n").alias("w")), "links-weights")
    buckets = materialize(rows.select("key", "band", "rep").join(weight, "rep"), "links-buckets")
    left = members.select(F.col("rep").alias("a"), F.col("sig").alias("sa"))
    right = members.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    close = likely("sa", "sb") >= F.lit(least)
    labels = weight.select("rep", F.col("rep").alias("label"))
    edges = tested = None
    for step in range(star_rounds + 1):
        labelled = buckets.join(labels, "rep")
        if step < star_rounds:
            centre = labelled.groupBy("key").agg(
                F.max(F.struct("w", (-F.col("rep")).alias("neg"), F.col("label").alias("cl"))).alias("c"))
            pairs = (labelled.join(centre, "key").filter(F.col("label") != F.col("c.cl"))
                     .select(F.col("rep").alias("a"), (-F.col("c.neg")).alias("b")).distinct())
        else:
            per = labelled.groupBy("key", "label").agg(F.count("*").alias("m"))
            main = (per.groupBy("key").agg(F.max(F.struct("m", "label")).alias("top"), F.count("*").alias("k"))
                    .filter("k > 1").select("key", F.col("top.label").alias("main")))
            mixed = labelled.join(main, "key").join(members, "rep")
            odd = mixed.filter("label <> main").select("key", "band", F.col("rep").alias("a"), F.col("label").alias("la"),
                                                       F.col("bands").alias("ba"), F.col("sig").alias("sa"))
            every = mixed.select("key", F.col("rep").alias("b"), F.col("label").alias("lb"), "main",
                                 F.col("bands").alias("bb"), F.col("sig").alias("sb"))
            earlier = F.exists(F.zip_with(F.slice("ba", F.lit(1), F.col("band")), F.slice("bb", F.lit(1), F.col("band")),
                                          lambda x, y: x == y), lambda z: z)
            pairs = odd.join(every, (odd["key"] == every["key"]) & F.expr("la <> lb and (lb = main or a < b)")
                             & close & ~earlier).select("a", "b")
        if tested is not None:
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(
                tested, ["a", "b"], "left_anti")
        if step < star_rounds:
            scored = pairs.join(left, "a").join(right, "b").withColumn("est", likely("sa", "sb")).filter(F.col("est") >= least)
            pairs = scored.groupBy("a").agg(F.max_by("b", F.struct("est", -F.col("b"))).alias("b"))
        pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                            "links-pairs")
        found = materialize(confirm(pairs), "links-confirmed")
        tested = pairs if tested is None else tested.union(pairs)
        if found.isEmpty():
            continue
        edges = found if edges is None else edges.union(found)
        comp = connected_components(edges)
        labels = materialize(weight.select("rep").join(comp, F.col("rep") == F.col("node"), "left")
                             .select("rep", F.coalesce("component", "rep").alias("label")), "links-labels")
    return labels


def shared_buckets(members: DataFrame, name: str) -> DataFrame:
    """(key, band, rep) of the buckets that hold two members (rep, bands) or more."""
    rows = members.select("rep", F.posexplode("bands").alias("band", "key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    return materialize(rows.join(sizes, "key"), name)
