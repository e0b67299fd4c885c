"""States from tables: amplitude and basis encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def amplitude_encode(df: DataFrame, key: Column, n: int, weight: Column) -> DataFrame:
    """Amplitude of index ``key mod 2^n``: the sum of its weights over the root of all squared sums.

    One map-side aggregate and shuffle; the norm is one row, broadcast back.  Rows with a
    null key or weight are left out; sums of 0 give no row.
    """
    sums = df.select(F.pmod(key.cast("long"), F.lit(1 << n)).alias("idx"), weight.cast("double").alias("w")).na.drop().groupBy("idx").agg(F.sum("w").alias("w"))
    total = sums.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return sums.join(F.broadcast(total)).filter("w <> 0").select("idx", (F.col("w") / F.col("norm")).alias("real"), F.lit(0.0).alias("imag"))


def basis_encode(df: DataFrame, key: Column, n: int) -> DataFrame:
    """Equal amplitudes on the distinct indices ``key mod 2^n``."""
    found = df.select(F.pmod(key.cast("long"), F.lit(1 << n)).alias("idx")).na.drop().distinct()
    total = found.agg(F.sqrt(F.count("*")).alias("norm"))
    return found.join(F.broadcast(total)).select("idx", (1 / F.col("norm")).alias("real"), F.lit(0.0).alias("imag"))


def vector_encode(df: DataFrame, vector: str) -> DataFrame:
    """A single vector column's entries as amplitudes, summed over the rows by position."""
    entries = df.select(F.posexplode(vector).alias("idx", "x")).groupBy(F.col("idx").cast("long").alias("idx")).agg(F.sum(F.col("x").cast("double")).alias("w"))
    total = entries.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return entries.join(F.broadcast(total)).filter("w <> 0").select("idx", (F.col("w") / F.col("norm")).alias("real"), F.lit(0.0).alias("imag"))
