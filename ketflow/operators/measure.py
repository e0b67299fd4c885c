"""Measurement, comparison and sparsity queries over states."""

from __future__ import annotations

import os
import socket
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ketflow.functions import bits as B
from ketflow.schema import EPSILON


def probability() -> Column:
    return F.col("real") * F.col("real") + F.col("imag") * F.col("imag")


def norm(state: DataFrame) -> DataFrame:
    """One row: the sum of squared magnitudes."""
    return state.agg(F.coalesce(F.sum(probability()), F.lit(0.0)).alias("norm"))


def is_normalized(state: DataFrame, tolerance: float = 1e-10) -> bool:
    return abs(norm(state).first()[0] - 1) < tolerance


def marginal(state: DataFrame, qubits) -> DataFrame:
    """(outcome, probability) of measuring some qubits; qubits[0] is bit 0 of the outcome."""
    return state.groupBy(B.pattern(F.col("idx"), qubits).alias("outcome")).agg(F.sum(probability()).alias("probability"))


def qubit_probability(state: DataFrame, qubit: int, value: int = 1) -> DataFrame:
    """One row: the probability of reading ``value`` at one qubit."""
    hit = F.when(B.bit(F.col("idx"), qubit) == value, probability()).otherwise(0.0)
    return state.agg(F.coalesce(F.sum(hit), F.lit(0.0)).alias("probability"))


def project(state: DataFrame, qubits, values=None, n: int | None = None, renormalize: bool = True, drop: bool = True) -> DataFrame:
    """Rows where the qubits read ``values`` (0 by default), divided by the root of their weight.

    With ``drop`` the measured bits are taken out of the index and the others move down;
    that needs the width ``n``.
    """
    qubits = list(qubits)
    values = list(values) if values is not None else [0] * len(qubits)
    want = sum(v << q for q, v in zip(qubits, values, strict=True))
    out = state.filter(F.col("idx").bitwiseAND(B.long_lit(B.mask_of(qubits))) == B.long_lit(want))
    if renormalize:
        weight = out.agg(F.sum(probability()).alias("w"))  # one row
        out = out.join(F.broadcast(weight)).select("idx", (F.col("real") / F.sqrt("w")).alias("real"), (F.col("imag") / F.sqrt("w")).alias("imag"))
    if drop:
        if n is None:
            raise ValueError("dropping qubits needs the width n")
        kept = [q for q in range(n) if q not in set(qubits)]
        out = out.select(B.permute(F.col("idx"), kept).alias("idx") if kept else B.long_lit(0).alias("idx"), "real", "imag")
    return out


def reset(state: DataFrame, qubit: int, u: float = 0.0) -> DataFrame:
    """Measure-and-flip reset of one qubit: outcome 0 if ``u`` is below its probability, its bit cleared, the norm kept.

    On an entangled qubit the result depends on the outcome: draw ``u`` from [0, 1) for one
    run of the program.  With ``u`` = 0 the outcome is 0 wherever that is possible.
    """
    zero = B.bit(F.col("idx"), qubit) == 0
    weight = state.agg(F.sum(F.when(zero, probability()).otherwise(0.0)).alias("w0"), F.sum(probability()).alias("w"))
    use_zero = F.col("w0") > F.greatest(F.lit(float(u)), F.lit(1e-12)) * F.col("w")
    kept = state.join(F.broadcast(weight)).filter(F.when(use_zero, zero).otherwise(~zero))
    scale = F.sqrt(F.when(use_zero, F.col("w0")).otherwise(F.col("w") - F.col("w0")) / F.col("w"))
    return kept.select(B.clear(F.col("idx"), [qubit]).alias("idx"), (F.col("real") / scale).alias("real"), (F.col("imag") / scale).alias("imag"))


def collapse(state: DataFrame, qubit: int, u: float) -> tuple[DataFrame, int]:
    """(state after measuring one qubit, its outcome): 0 if ``u`` is below its probability.  One row comes to the driver."""
    zero = B.bit(F.col("idx"), qubit) == 0
    w0, w = state.agg(F.coalesce(F.sum(F.when(zero, probability())), F.lit(0.0)), F.coalesce(F.sum(probability()), F.lit(0.0))).first()
    if not w:
        raise ValueError("a state without weight cannot be measured")
    outcome = 0 if w0 > max(u, 1e-12) * w else 1
    return project(state, [qubit], [outcome], drop=False), outcome


def allocate(state: DataFrame, n: int, count: int = 1) -> tuple[DataFrame, int]:
    """``count`` new qubits in |0> above the others: the index stays, the width grows."""
    return state, n + count


def cumulative(state: DataFrame, buckets: int = 1024) -> DataFrame:
    """(idx, probability, cumulative) in index order.

    Two levels, so that no task has to hold the whole order: totals of ``buckets`` index
    ranges first, then running sums inside each range on top of the totals before it.
    """
    span = state.agg(F.max("idx").alias("top"))
    spread = state.join(F.broadcast(span)).select("idx", probability().alias("probability"), F.floor(F.col("idx") / (F.col("top") + 1.0) * buckets).cast("int").alias("bucket"))
    totals = spread.groupBy("bucket").agg(F.sum("probability").alias("p"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows
    base = totals.select("bucket", F.coalesce(F.sum("p").over(before), F.lit(0.0)).alias("base"))
    inside = Window.partitionBy("bucket").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return spread.join(F.broadcast(base), "bucket").select("idx", "probability", (F.col("base") + F.sum("probability").over(inside)).alias("cumulative"), "bucket")


def pick(state: DataFrame, draws: DataFrame, buckets: int = 1024) -> DataFrame:
    """(draw_id, idx) for draws (draw_id, u): the first index whose cumulative probability exceeds u.

    Draws and cumulative rows are merged by value, in cells of equal probability, and each
    draw takes the last index seen in falling order; no pairs are made, and a state of few
    indices still spreads its draws.  A cell without a greater row takes the first of the
    next cell that has one (one row a cell is broadcast).  A draw beyond the total gets the
    largest index.
    """
    cdf = cumulative(state, buckets).select("idx", "cumulative")
    ends = cdf.agg(F.max("cumulative").alias("total"), F.max("idx").alias("top"))
    cell = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor(F.col("v") / F.col("total") * buckets))).cast("int").alias("cell")
    none = F.lit(None)
    both = cdf.select(F.col("cumulative").alias("v"), F.lit(1).alias("kind"), "idx", none.cast(draws.schema["draw_id"].dataType).alias("draw_id"))
    both = both.unionByName(draws.select(F.col("u").alias("v"), F.lit(0).alias("kind"), none.cast("long").alias("idx"), "draw_id"))
    placed = both.join(F.broadcast(ends)).select(cell, "v", "kind", "idx", "draw_id", "top")
    falling = Window.partitionBy("cell").orderBy(F.desc("v"), "kind", F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    seen = placed.withColumn("seen", F.last("idx", ignorenulls=True).over(falling)).filter("kind = 0")
    firsts = placed.filter("kind = 1").groupBy("cell").agg(F.min(F.struct("v", "idx"))["idx"].alias("first"))
    every = state.sparkSession.range(buckets).select(F.col("id").cast("int").alias("cell")).join(firsts, "cell", "left")
    after = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)  # ``buckets`` rows
    following = every.select("cell", F.last("first", ignorenulls=True).over(after).alias("following"))
    return seen.join(F.broadcast(following), "cell").select("draw_id", F.coalesce("seen", "following", "top").alias("idx"))


def sample(state: DataFrame, n_samples: int, seed: int = 0, qubits=None) -> DataFrame:
    """(outcome, count) of repeated measurement with a seeded generator."""
    spark = state.sparkSession
    draws = spark.range(n_samples).select(F.col("id").alias("draw_id"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)).alias("u"))
    outcome = F.col("idx") if qubits is None else B.pattern(F.col("idx"), qubits)
    return pick(state, draws).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("count"))


def _paired(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("idx", F.col("real").alias("ar"), F.col("imag").alias("ai"))
    right = b.select("idx", F.col("real").alias("br"), F.col("imag").alias("bi"))
    return left.join(right, "idx", "full_outer").na.fill(0.0, ["ar", "ai", "br", "bi"])


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: <a|b> as real and imag, and its magnitude (the fidelity's root)."""
    left = a.select("idx", F.col("real").alias("ar"), F.col("imag").alias("ai"))
    right = b.select("idx", F.col("real").alias("br"), F.col("imag").alias("bi"))
    sums = left.join(right, "idx").agg(
        F.coalesce(F.sum(F.col("ar") * F.col("br") + F.col("ai") * F.col("bi")), F.lit(0.0)).alias("real"),
        F.coalesce(F.sum(F.col("ar") * F.col("bi") - F.col("ai") * F.col("br")), F.lit(0.0)).alias("imag"),
    )
    return sums.select("real", "imag", F.hypot("real", "imag").alias("magnitude"))


def max_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the largest magnitude of a difference; a missing row is 0."""
    return _paired(a, b).agg(F.coalesce(F.max(F.hypot(F.col("ar") - F.col("br"), F.col("ai") - F.col("bi"))), F.lit(0.0)).alias("max_diff"))


def states_equal(a: DataFrame, b: DataFrame, tolerance: float = 1e-10) -> bool:
    return max_diff(a, b).first()[0] < tolerance


def sparsity(state: DataFrame, n: int, epsilon: float = 1e-10) -> DataFrame:
    """One row: non-zero amplitudes, their share of 2^n and the bytes saved against a dense state (16 each, 24 a row here)."""
    big = F.hypot("real", "imag") > epsilon
    return state.agg(F.count_if(big).alias("nonzero")).select("nonzero", (F.col("nonzero") / float(2**n)).alias("density"), (F.lit(16.0 * 2**n) - 24.0 * F.col("nonzero")).alias("bytes_saved"))


def count_above(state: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    return state.agg(F.count_if(F.hypot("real", "imag") > epsilon).alias("nonzero"))


def top_amplitudes(state: DataFrame, k: int) -> DataFrame:
    """The k most probable rows; ties to the smaller index."""
    return state.withColumn("probability", probability()).orderBy(F.desc("probability"), "idx").limit(k)


def to_dense(state: DataFrame, n: int) -> DataFrame:
    """All 2^n rows in index order; rows beyond 2^n are dropped, missing ones are 0."""
    every = state.sparkSession.range(1 << n).withColumnRenamed("id", "idx")
    return every.join(state, "idx", "left").na.fill(0.0, ["real", "imag"]).orderBy("idx")


def to_dict(state: DataFrame) -> dict[int, complex]:
    """Driver-side copy for states known to be small (an API edge, not an operator)."""
    return {r.idx: complex(r.real, r.imag) for r in state.collect()}


def merge(states: Iterable[DataFrame]) -> DataFrame:
    """The sum of partial states: their rows together, amplitudes of an index added.

    Right for terms of one linear sum (as the branches of an operator); states of separate
    circuits are not such terms and need a tensor product.
    """
    together = reduce(DataFrame.unionByName, states)
    return together.groupBy("idx").agg(F.sum("real").alias("real"), F.sum("imag").alias("imag"))


def spread(metrics: DataFrame, value: str = "rows") -> DataFrame:
    """One row: least, greatest and mean of a metric over partitions, ranks or tasks."""
    return metrics.agg(F.min(value).alias("least"), F.max(value).alias("greatest"), F.avg(value).alias("mean"))


def rows_per_worker(df: DataFrame) -> DataFrame:
    """(worker, rows): the hosts and executors that hold a DataFrame's partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sum(b.num_rows for b in batches)
        worker = f"{socket.gethostname()}/{os.getppid()}"  # workers of an executor are forks of one daemon
        yield pa.RecordBatch.from_arrays([pa.array([worker]), pa.array([rows], pa.int64())], names=["worker", "rows"])

    return df.select(df.columns[0]).mapInArrow(run, "worker string, rows bigint").groupBy("worker").agg(F.sum("rows").alias("rows"))


def rows_per_partition(df: DataFrame) -> DataFrame:
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("rows"))
