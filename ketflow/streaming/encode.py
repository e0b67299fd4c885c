"""Streams of rows into states.

Encoding is an aggregate, and diagonal and permutation gates are projections.  Both run on a stream as they
are, so a state can be kept up to date while rows arrive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ketflow.operators.apply import apply_gate
from ketflow.plans.circuit import Gate
from ketflow.plans.rewrite import lower


def stream_weights(rows: DataFrame, key: Column, n: int, weight: Column) -> DataFrame:
    """Running unnormalised amplitudes (idx, real, imag) of a stream; use with the update or complete mode."""
    keyed = rows.select(F.pmod(key.cast("long"), F.lit(1 << n)).alias("idx"), weight.cast("double").alias("w"))
    return keyed.groupBy("idx").agg(F.sum("w").alias("real")).withColumn("imag", F.lit(0.0))


def windowed_weights(rows: DataFrame, time: str, key: Column, n: int, weight: Column, window: str, late: str) -> DataFrame:
    """Unnormalised amplitudes of each time window; rows later than ``late`` are dropped by the watermark."""
    keyed = rows.withWatermark(time, late).select(F.window(time, window).alias("window"), F.pmod(key.cast("long"), F.lit(1 << n)).alias("idx"), weight.cast("double").alias("w"))
    return keyed.groupBy("window", "idx").agg(F.sum("w").alias("real")).select("window", "idx", "real", F.lit(0.0).alias("imag"))


def stream_gates(rows: DataFrame, gates: Iterable[Gate]) -> DataFrame:
    """Gates on a stream of (idx, real, imag) contributions.  Gates are linear, so a sum of
    contributions may be taken after them; general gates would need an aggregate each and
    are refused."""
    for g in gates:
        if lower(g).kind == "G":
            raise ValueError(f"{g.name} is no projection; aggregate the stream first")
        rows = apply_gate(rows, g)
    return rows


def fold(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch's updates to ``sink`` (exactly once with an idempotent sink)."""
    return rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).start()
