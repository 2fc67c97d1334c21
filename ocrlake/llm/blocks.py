"""Joins on keys that may be hot: each key's rows are spread over blocks, and each pair of blocks is a join key of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_pairs(rows: DataFrame, keys: list[str], val: str, n: str, carry: list[str], block: int, apart: Column | None = None) -> DataFrame:
    """All pairs of rows with equal ``keys`` and different ``val``, once each: the columns as ``{c}_a`` and ``{c}_b``.

    ``n`` says how many rows have a row's keys. They are spread over ceil(n / block) blocks by a hash of ``val``, and each
    pair of blocks is a join key of its own: no task gets a hot key as a whole. Both sides of the join are one table, so
    it is shuffled once. ``apart`` filters pairs in the join.
    """
    c = F.ceil(F.col(n) / block).cast("int")
    own = F.when(c > 1, F.pmod(F.xxhash64(val), c)).otherwise(0).cast("int")
    placed = rows.select(*keys, val, *carry, own.alias("_own"), F.explode(F.when(c > 1, F.sequence(F.lit(0), c - 1)).otherwise(F.array(F.lit(0)))).alias("_other"))
    placed = placed.select(*keys, F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"), val, *carry, "_own")
    cols = [val, *carry, "_own"]
    on = [*keys, "_lo", "_hi"]
    left, right = placed.select(*on, *(F.col(x).alias(f"{x}_a") for x in cols)), placed.select(*on, *(F.col(x).alias(f"{x}_b") for x in cols))
    pairs = left.join(right, on).filter((F.col(f"{val}_a") < F.col(f"{val}_b")) & ((F.col("_lo") == F.col("_hi")) | (F.col("_own_a") != F.col("_own_b"))))
    pairs = pairs if apart is None else pairs.filter(apart)
    return pairs.select(*keys, *(f"{x}_{side}" for side in "ab" for x in cols[:-1]))


def spread_join(left: DataFrame, right: DataFrame, key: str, block: int = 2_000) -> DataFrame:
    """Equality join of two tables whose rows of one ``key`` may be very many on both sides (null keys never match).

    A key with n and m rows is cut into ceil(n / block) and ceil(m / block) parts, and each pair of parts is joined by
    itself; only keys with more than ``block`` rows on a side (rows / block of them at most) are looked up for that. Both
    tables are read twice: pass tables that are written.
    """
    hot = lambda df, name: df.groupBy(key).agg(F.count("*").alias("_k")).filter(F.col("_k") > block).select(key, F.ceil(F.col("_k") / block).cast("int").alias(name))
    many_left, many_right = hot(left, "_n"), hot(right, "_m")
    n, m = F.coalesce("_n", F.lit(1)), F.coalesce("_m", F.lit(1))

    def placed(df: DataFrame, own: str, parts: Column, other: str, others: Column) -> DataFrame:
        hashed = df.withColumn("_h", F.xxhash64(*df.columns)).join(many_left, key, "left").join(many_right, key, "left")
        spread = hashed.withColumn(own, F.pmod(F.col("_h"), parts).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), others - 1)))
        return spread.drop("_h", "_n", "_m")

    return placed(left, "_i", n, "_j", m).join(placed(right, "_j", m, "_i", n), [key, "_i", "_j"]).drop("_i", "_j")
