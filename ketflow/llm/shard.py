"""Sharding by minimax contiguous partition (operator 4).

Rows of equal text are one atomic group.  Groups lie in the order of their text's
SHA-256, and the shards are contiguous runs of that order.  The capacity of a shard is
the smallest for which a greedy cut needs no more shards than allowed; it is found by
search between a proven lower and upper bound, and the cuts of the greedy run at that
capacity are the answer.

The driver never sees the groups.  It holds the totals of ``BUCKETS`` ranges of the
hash (a fixed number) and asks one aggregate job at a time where greedy runs at many
capacities cut next; each job looks at the few buckets concerned.  A row's shard is
then a comparison of its hash with at most ``n_shards - 1`` cut hashes: no join.
Slots are numbered inside (shard, part) with parts dealt by a written row number, so
neither copies nor repeated ids gather in one task.

Edge cases: null and empty texts are one group of size 1 a row and checksum 0; a group
larger than the mean shard makes its shard large, as the minimax bound says; fewer
groups than shards leave shards empty; repeated rows get a slot each; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ketflow.llm.common import discard, materialize

N_SHARDS = 8
BUCKETS = 4096
#: Capacities tried at once.
FAN = 31
PARTS = 512


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, size, text_crc32, g): g is the SHA-256 of the text, rid a row number of the written table."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = text.cast("binary")
    return materialize(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(raw).cast("long").alias("text_crc32"),
            F.unhex(F.sha2(raw, 256)).alias("g"),
        )
    )


def _bucket(g: Column) -> Column:
    """The first 12 bits of the hash, in its order."""
    return F.conv(F.substring(F.hex(g), 1, 3), 16, 10).cast("int")


@dataclass(frozen=True)
class Plan:
    """Capacity and the last group hash of each shard but the last."""

    capacity: int
    cuts: tuple[bytes, ...]


def plan(rows: DataFrame, n_shards: int = N_SHARDS, fan: int = FAN) -> Plan:
    """Smallest capacity for which greedy contiguous shards number at most ``n_shards``, and its cuts."""
    groups = rows.groupBy("g").agg(F.sum("size").alias("size")).withColumn("bucket", _bucket(F.col("g")))
    order = Window.partitionBy("bucket").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    groups = materialize(groups.select("bucket", "g", "size", F.sum("size").over(order).alias("upto")))
    totals = groups.groupBy("bucket").agg(F.sum("size").alias("size"), F.max("size").alias("most")).orderBy("bucket").collect()
    if not totals:
        return Plan(0, ())
    names, starts, at = [], [], 0
    for r in totals:
        names.append(r.bucket)
        starts.append(at)
        at += r["size"]
    total, most = at, max(r.most for r in totals)

    def last_within(points: list[int]) -> list[int]:
        """The largest group boundary at or before each of the points."""
        where = [bisect_right(starts, p) - 1 for p in points]
        inside = [F.max(F.when((F.col("bucket") == names[b]) & (F.col("upto") <= p - starts[b]), F.col("upto"))) for p, b in zip(points, where, strict=True)]
        near = groups.filter(F.col("bucket").isin(sorted({names[b] for b in where})))
        found = near.agg(*[x.alias(f"c{i}") for i, x in enumerate(inside)]).first()
        return [starts[b] + (found[i] or 0) for i, b in enumerate(where)]

    def greedy(capacities: list[int]) -> list[list[int]]:
        """Cut positions of a greedy run at each capacity; a run that needs too many shards ends short of the total."""
        cuts: list[list[int]] = [[] for _ in capacities]
        for _ in range(n_shards):
            live = [i for i, c in enumerate(cuts) if not c or c[-1] < total]
            points = [(cuts[i][-1] if cuts[i] else 0) + capacities[i] for i in live]
            inner = [k for k, p in enumerate(points) if p < total]
            found = dict(zip(inner, last_within([points[k] for k in inner]), strict=True)) if inner else {}
            for k, i in enumerate(live):
                cuts[i].append(found.get(k, total))
        return cuts

    low = max(-(-total // n_shards), most)  # no capacity below can hold all
    high = -(-total // n_shards) + most  # greedy fills each closed shard above the mean, so this suffices
    best = None
    while best is None or low < high:
        step = max(1, -(-(high - low) // fan))
        tried = sorted({min(low + k * step, high) for k in range(fan + 1)})
        runs = greedy(tried)
        ok = [k for k, c in enumerate(runs) if c[-1] >= total]
        k = ok[0]
        high, best = tried[k], runs[k]
        low = tried[k - 1] + 1 if k else high
    edges = [c for c in best if c < total]
    where = [bisect_right(starts, c - 1) - 1 for c in edges]
    cuts = []
    if edges:
        same = F.lit(False)
        for c, b in zip(edges, where, strict=True):
            same = same | ((F.col("bucket") == names[b]) & (F.col("upto") == c - starts[b]))
        cuts = [bytes(r.g) for r in groups.filter(same).select("g").orderBy("g").collect()]
    discard(groups)
    return Plan(high, tuple(cuts))


def assign(rows: DataFrame, found: Plan, parts: int = PARTS) -> DataFrame:
    """``rows`` with ``shard`` and a gapless ``slot`` from 0 in each shard."""
    shard = F.lit(0)
    for c in found.cuts:
        shard = shard + (F.col("g") > F.lit(bytearray(c))).cast("int")
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int"))
    sizes = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # at most shards x parts rows
    slot = F.row_number().over(Window.partitionBy("shard", "part").orderBy("rid")) - 1
    return placed.withColumn("slot", slot.cast("long")).join(F.broadcast(offsets), ["shard", "part"]).withColumn("slot", F.col("slot") + F.col("base"))


def shard(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; the law is ``bytes``."""
    rows = keyed(docs, id_col, text_col)
    placed = assign(rows, plan(rows, n_shards))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
