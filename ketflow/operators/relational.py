"""Circuit analysis as relational queries, for circuits that live in tables.

A circuit relation has ``seq`` (order) and ``qubits`` (array); ``uses`` explodes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def uses(gates: DataFrame) -> DataFrame:
    """(seq, qubit), one row a use."""
    return gates.select("seq", F.explode("qubits").alias("qubit"))


def direct_edges(gates: DataFrame, ranges: int = 256) -> DataFrame:
    """(src, dst, qubit): each gate after the last earlier one on the same qubit; windows, no self join.

    A circuit has few qubits, so a qubit's gates are looked at in ``ranges`` spans of seq; the
    first gate of a span follows the last one of the spans before (one row a qubit and span
    is gathered for that).
    """
    span = gates.agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    at = F.floor((F.col("seq") - F.col("low")) / (F.col("high") - F.col("low") + 1.0) * ranges).cast("int").alias("span")
    placed = uses(gates).join(F.broadcast(span)).select("seq", "qubit", at)
    ends = placed.groupBy("qubit", "span").agg(F.max("seq").alias("end"))
    before = ends.select("qubit", "span", F.lag("end").over(Window.partitionBy("qubit").orderBy("span")).alias("before"))
    inside = F.lag("seq").over(Window.partitionBy("qubit", "span").orderBy("seq")).alias("inside")
    found = placed.select("seq", "qubit", "span", inside).join(before, ["qubit", "span"])
    return found.select(F.coalesce("inside", "before").alias("src"), F.col("seq").alias("dst"), "qubit").filter("src IS NOT NULL")


def all_edges(gates: DataFrame, block: int = 2048) -> DataFrame:
    """(src, dst): every earlier gate on a shared qubit, the transitive form (quadratic in a qubit's gates by definition).

    Gates with the same qubits are packed, in blocks of at most ``block``, and blocks that
    share a qubit meet once, so a pair is made once: nothing of the result's size is
    shuffled or made distinct.  Rows with the same seq count as one gate on all their qubits.
    """
    one = uses(gates).filter("seq IS NOT NULL AND qubit IS NOT NULL").groupBy("seq").agg(F.sort_array(F.collect_set("qubit")).alias("qubits"))
    # dealt by hash to about n / block blocks a set of qubits; a block that is too full by chance stays right
    sized = one.join(one.groupBy("qubits").agg(F.ceil(F.count("*") / block).alias("blocks")), "qubits")
    packed = sized.groupBy("qubits", F.pmod(F.xxhash64("seq"), F.col("blocks")).alias("block")).agg(F.sort_array(F.collect_list("seq")).alias("seqs"))
    ends = packed.select("qubits", "block", F.col("seqs")[0].alias("low"), F.element_at("seqs", -1).alias("high"), F.explode("qubits").alias("qubit"))
    x, y = ends.alias("x"), ends.alias("y")
    first = F.array_min(F.array_intersect("x.qubits", "y.qubits")) == F.col("x.qubit")
    meet = x.join(y, (F.col("x.qubit") == F.col("y.qubit")) & (F.col("x.low") < F.col("y.high")) & first)
    meet = meet.select(F.col("x.qubits").alias("xq"), F.col("x.block").alias("xb"), F.col("y.qubits").alias("qubits"), F.col("y.block").alias("block"))
    sources = packed.select(F.col("qubits").alias("xq"), F.col("block").alias("xb"), F.col("seqs").alias("sources"))
    pairs = meet.join(packed, ["qubits", "block"]).join(sources, ["xq", "xb"]).select("sources", "seqs")
    tasks = int(gates.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: a small shuffle in front of much output must not shrink to a few tasks
    return pairs.repartition(tasks, F.xxhash64("sources", "seqs")).select(F.explode("sources").alias("src"), "seqs").select("src", F.explode("seqs").alias("dst")).filter("src < dst")


def batch_ids(gates: DataFrame, size: int) -> DataFrame:
    """(seq, batch): runs of ``size`` by the gate number itself, no ordering needed."""
    return gates.select("seq", F.floor(F.col("seq") / size).cast("long").alias("batch"))


def qubit_frequency(gates: DataFrame) -> DataFrame:
    return uses(gates).groupBy("qubit").agg(F.count("*").alias("uses"))


def partition_overlap(parts: DataFrame) -> DataFrame:
    """(a, b, shared): qubits that two parts share; parts meet on the qubit, not by a cross join."""
    own = parts.select("part", F.explode("qubits").alias("qubit")).distinct()
    x, y = own.alias("x"), own.alias("y")
    return x.join(y, (F.col("x.qubit") == F.col("y.qubit")) & (F.col("x.part") != F.col("y.part"))).groupBy(F.col("x.part").alias("a"), F.col("y.part").alias("b")).agg(F.count("*").alias("shared"))


def orders_by_part(parts: DataFrame) -> DataFrame:
    """(part, orders): the sorted order ids of each part."""
    return parts.groupBy("part").agg(F.sort_array(F.collect_list("order_id")).alias("orders"))


def latest(log: DataFrame, by, order: str) -> DataFrame:
    """The row of greatest ``order`` for each key, by one aggregate."""
    keys = [by] if isinstance(by, str) else list(by)
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def pending_after(log: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Pending steps that start after their run's last checkpointed step."""
    last = checkpoints.groupBy("run_id").agg(F.max("last_step").alias("last_step"))
    return log.filter("status = 'PENDING'").join(last, "run_id", "left").filter(F.col("step_start") > F.coalesce("last_step", F.lit(-1)))


def match_gates(original: DataFrame, parted: DataFrame) -> DataFrame:
    """(seq, part): the part of each gate of a circuit, from a listing (order_id, gate, qubits, part) in another order.

    Equal gates (same name, same qubits) are matched first to first, so none is used twice;
    a gate that the listing lacks has a null part.
    """
    rank = lambda order: F.row_number().over(Window.partitionBy("gate", "qubits").orderBy(order)).alias("nth")
    a = original.select("seq", "gate", "qubits", rank("seq"))
    b = parted.select("gate", "qubits", "part", rank("order_id"))
    return a.join(b, ["gate", "qubits", "nth"], "left").select("seq", "part")
