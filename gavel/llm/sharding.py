"""Proportional stratified interleaving with DataFrame functions only.

Rows are ranked within their source in a seeded random order; the rank as a
fraction of the source's size orders all rows, which spreads every source
evenly over the order; cutting the order into equal parts gives shards whose
mixture matches the whole (law ``rows``: row counts at most one apart).

No window spans a source or the table. Both ranks are two-level: rows fall in
cells of equal share (by the random number, then by the fraction), cell counts
give prefix sums, and rows are ranked inside their cell. Only ids, sources and
random numbers are shuffled, never texts.

Defined cases: a null source is a stratum of its own; ties in the order go by
stratum and order columns; repeated rows are separate rows; an empty table
gives no rows; a null text has size 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.common import materialize

CELLS = 1024


def _ranked(rows: DataFrame, stratum: list[str], cell: str, order: list, name: str) -> DataFrame:
    """``rows`` with rank ``name`` from 0 within ``stratum``: by ``cell``, then ``order``."""
    keys = [*stratum, cell]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*stratum) if stratum else Window.partitionBy(F.lit(0))
    before = counts.select(*keys, (F.sum("_n").over(by.orderBy(cell)) - F.col("_n")).alias("_before"),
                           F.sum("_n").over(by).alias(f"{name}_of"))
    return rows.join(before, keys).withColumn(
        name, F.col("_before") + F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).drop("_before")


def interleave(rows: DataFrame, stratum: str, key: str, shards: int, seed: int = 1, cells: int = CELLS) -> DataFrame:
    """``rows`` plus shard and slot. ``key`` identifies rows and seeds their
    random numbers. Pass narrow rows: they are shuffled and written once."""
    drawn = F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    base = rows.withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit(""))).withColumn(
        "_u", drawn)
    base = base.withColumn("_c", (F.conv(F.substring("_u", 1, 8), 16, 10).cast("long") * cells / F.lit(1 << 32)).cast("int"))
    one = _ranked(base, ["_s"], "_c", ["_u", key], "_r")
    one = one.withColumn("_f", (F.col("_r") + F.lit(0.5)) / F.col("_r_of"))
    one = materialize(one.withColumn("_c", (F.col("_f") * cells).cast("int")).drop("_r", "_r_of", "_u"), "sharding-fractions")
    two = _ranked(one, [], "_c", ["_f", "_s", key], "_g")
    cut = two.withColumn("shard", F.expr(f"_g * {shards} div _g_of").cast("int"))
    first = F.expr(f"(shard * _g_of + {shards} - 1) div {shards}")
    return cut.withColumn("slot", (F.col("_g") - first).cast("long")).select(*rows.columns, "shard", "slot")
