"""Positions in a global order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocrlake.session import cut

_ROW_BITS = 33  # bits of monotonically_increasing_id that count within a partition


def row_numbers(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their position from 1 in ``order`` (which should name rows apart).

    Rows are sorted in ranges; the first position of a range comes from the sizes of the ranges before it.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = cut(placed)
    part = F.shiftright("_m", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))  # one row per range
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    within = F.col("_m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    out = placed.withColumn("_p", part).join(F.broadcast(starts), "_p")
    return out.withColumn(name, (F.col("_s") + within + 1).cast("long")).drop("_p", "_m", "_s")


def ranked_values(rows: DataFrame, by: list[str], col: str, picks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per group of ``by`` the number of non-null values (``n``) and the values at given positions in order.

    A pick takes the number of values and gives a position from 0. Equal values are counted together first, then ranges
    of values are numbered, so neither a large group nor a frequent value is seen by one task alone.
    """
    counts = rows.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("_c"))
    parts = cut(counts.repartitionByRange(*by, col).withColumn("_p", F.spark_partition_id()))
    sums = parts.groupBy(*by, "_p").agg(F.sum("_c").alias("_s"))  # one row per range and group
    group = [F.lit(0), *(F.col(b) for b in by)]
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"), F.sum("_s").over(Window.partitionBy(*group)).alias("_n"))
    run = Window.partitionBy("_p", *by).orderBy(col)
    ranged = parts.join(F.broadcast(offsets), [*by, "_p"]).withColumn("_hi", F.col("_b") + F.sum("_c").over(run))
    here = lambda k: (F.col("_hi") - F.col("_c") <= k) & (k < F.col("_hi"))
    chosen = [F.max(F.when(here(pick(F.col("_n"))), F.col(col))).alias(name) for name, pick in picks.items()]
    return ranged.groupBy(*by).agg(F.max("_n").alias("n"), *chosen)
