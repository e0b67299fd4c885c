"""Stored states, the write-ahead log, checkpoints and recovery.

Everything is a file that Spark reads and writes, at any path it knows (a local folder in
tests, an object store or HDFS on a cluster):

    <base>/states/run_id=R/state_version=V/   Parquet of one version of a state
    <base>/wal/                               append-only JSON records
    <base>/checkpoints/                       append-only JSON records

A version is complete when its committer has written ``_SUCCESS``; only then is the log
record appended.  The log's latest record of a step is its status.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ketflow.operators.relational import latest
from ketflow.schema import CHECKPOINT, STATE, WAL

PENDING, COMMITTED, FAILED = "PENDING", "COMMITTED", "FAILED"


class Files:
    """Existence, listing, deletion and exclusive creation through Spark's own file systems."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def create(self, path: str, text: str) -> bool:
        """Create a file that must not exist; False if it does."""
        fs, p = self._at(path)
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def text(self, path: str) -> str:
        """A small file of text, through the file system's own reader."""
        fs, p = self._at(path)
        stream = self.jvm.java.io.BufferedReader(self.jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
        lines = []
        while (line := stream.readLine()) is not None:
            lines.append(line)
        stream.close()
        return "\n".join(lines)


class StateStore:
    """Versions of the states of one run."""

    def __init__(self, spark: SparkSession, base: str, run_id: str) -> None:
        self.spark, self.run_id, self.files = spark, run_id, Files(spark)
        self.base = base.rstrip("/")
        self.root = f"{self.base}/states/run_id={run_id}"

    def path(self, version: int) -> str:
        return f"{self.root}/state_version={version}"

    def save(self, state: DataFrame, version: int) -> str:
        state.write.mode("overwrite").parquet(self.path(version))
        return self.path(version)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(self.path(version))

    def exists(self, version: int) -> bool:
        return self.files.exists(f"{self.path(version)}/_SUCCESS")

    def versions(self) -> list[int]:
        """Complete versions, by a directory listing."""
        found = (int(n.partition("=")[2]) for n in self.files.names(self.root) if n.startswith("state_version="))
        return sorted(v for v in found if self.exists(v))

    def all_versions(self) -> DataFrame:
        """All versions as one relation; a filter on state_version prunes folders."""
        schema = T.StructType([*STATE.fields, T.StructField("state_version", T.IntegerType())])
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(self.root)

    def delete(self, version: int) -> None:
        self.files.delete(self.path(version))

    # CSV in and out, as one ordered file with a header
    def export_csv(self, state: DataFrame, path: str) -> str:
        """Write idx, real, imag in index order; returns the SHA-256 of the content (order-free, over the rows)."""
        state.orderBy("idx").coalesce(1).write.mode("overwrite").csv(path, header=True)
        return checksum(self.import_csv(path))

    def import_csv(self, path: str) -> DataFrame:
        return self.spark.read.schema(STATE).csv(path, header=True)


def checksum(state: DataFrame) -> str:
    """SHA-256 over the sums of row hashes: order-free, one aggregate, no row leaves the executors."""
    row = F.xxhash64("idx", "real", "imag").cast("decimal(38,0)")
    other = F.xxhash64("imag", "real", "idx").cast("decimal(38,0)")
    r = state.agg(F.count("*").alias("n"), F.sum(row).alias("a"), F.sum(other).alias("b"))
    return r.select(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("n", "a", "b")]), 256)).first()[0]


class Log:
    """Append-only write-ahead log."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.path, self.files = spark, f"{base.rstrip('/')}/wal", Files(spark)

    def append(self, **record) -> None:
        record["logged_at"] = datetime.now(timezone.utc)
        self.spark.createDataFrame([tuple(record[f.name] for f in WAL.fields)], WAL).coalesce(1).write.mode("append").json(self.path)

    def records(self) -> DataFrame:
        if not self.files.exists(self.path):
            return self.spark.createDataFrame([], WAL)
        return self.spark.read.schema(WAL).json(self.path)

    def status(self) -> DataFrame:
        """Latest record of each step."""
        return latest(self.records(), ["run_id", "wal_id"], "logged_at")

    def pending(self, run_id: str) -> DataFrame:
        return self.status().filter((F.col("run_id") == run_id) & (F.col("status") == PENDING)).orderBy("step_start")

    def last_committed(self, run_id: str):
        return self.status().filter((F.col("run_id") == run_id) & (F.col("status") == COMMITTED)).orderBy(F.desc("step_end")).limit(1).first()


class Checkpoints:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.path, self.files = spark, f"{base.rstrip('/')}/checkpoints", Files(spark)

    def create(self, run_id: str, plan_hash: str, version: int, last_step: int, state_path: str, state: DataFrame | None = None) -> None:
        row = (run_id, plan_hash, version, last_step, state_path, checksum(state) if state is not None else None, datetime.now(timezone.utc))
        self.spark.createDataFrame([row], CHECKPOINT).coalesce(1).write.mode("append").json(self.path)

    def all(self) -> DataFrame:
        if not self.files.exists(self.path):
            return self.spark.createDataFrame([], CHECKPOINT)
        return latest(self.spark.read.schema(CHECKPOINT).json(self.path), ["run_id", "state_version"], "created_at").select(*CHECKPOINT.fieldNames())

    def last(self, run_id: str):
        return self.all().filter(F.col("run_id") == run_id).orderBy(F.desc("state_version")).limit(1).first()

    def verify(self, record) -> bool:
        """The stored state still has the recorded checksum (True if none was recorded)."""
        if not self.files.exists(f"{record.state_path}/_SUCCESS"):
            return False
        return record.checksum is None or checksum(self.spark.read.schema(STATE).parquet(record.state_path)) == record.checksum


@dataclass(frozen=True)
class Policy:
    """When to record a checkpoint: the first version, every n versions, or after so many steps or seconds."""

    every_versions: int = 1
    every_steps: int = 10
    every_seconds: float = 60.0

    def due(self, version: int, steps_since: int, seconds_since: float) -> bool:
        return version == 1 or version % self.every_versions == 0 or steps_since >= self.every_steps or seconds_since >= self.every_seconds


@dataclass(frozen=True)
class ResumePoint:
    version: int
    next_step: int
    complete: bool


def recover(spark: SparkSession, base: str, run_id: str, plan_hash: str, n_steps: int) -> ResumePoint:
    """Where a run goes on: after the last step whose state is complete and whose plan is this one.

    Steps left pending are marked failed and their states deleted.  Records of another
    plan under the same run id are refused: their step numbers mean something else.
    """
    log, store, points = Log(spark, base), StateStore(spark, base, run_id), Checkpoints(spark, base)
    mine = [r for r in log.status().filter(F.col("run_id") == run_id).collect()]
    if any(r.plan_hash != plan_hash for r in mine):
        raise ValueError(f"run {run_id} belongs to another plan; use a new run id")
    done = [(r.step_end, r.state_version_out) for r in mine if r.status == COMMITTED and store.exists(r.state_version_out)]
    point = points.last(run_id)
    if point is not None and point.plan_hash == plan_hash and store.exists(point.state_version):
        done.append((point.last_step + 1, point.state_version))
    step, version = max(done, default=(0, 0))
    for r in mine:
        if r.status == PENDING:
            log.append(**{**r.asDict(), "status": FAILED})
            if r.state_version_out > version:
                store.delete(r.state_version_out)
    return ResumePoint(version, step, step >= n_steps)


def cleanup(store: StateStore, keep: set[int]) -> list[int]:
    """Delete all versions but those to keep; returns the deleted ones."""
    gone = [v for v in store.versions() if v not in keep]
    for v in gone:
        store.delete(v)
    return gone


class Fence:
    """A lock file so that one driver runs a run id at a time; a lock older than ``stale_s`` may be taken over."""

    def __init__(self, spark: SparkSession, base: str, run_id: str, stale_s: float = 86_400.0) -> None:
        self.files, self.path, self.stale_s = Files(spark), f"{base.rstrip('/')}/locks/{run_id}", stale_s
        self.owner = f"{spark.sparkContext.applicationId}-{time.time_ns()}"
        self.held = False

    def acquire(self, force: bool = False) -> None:
        told = f"{self.owner} {time.time()}"
        if not self.files.create(self.path, told):
            held = self.files.text(self.path).split()
            age = time.time() - float(held[1]) if len(held) == 2 else self.stale_s
            if not force and age < self.stale_s:
                raise RuntimeError(f"{self.path} is held by {held[0]}")
            self.files.delete(self.path)
            if not self.files.create(self.path, told):
                raise RuntimeError(f"{self.path} was taken by another driver")
        self.held = True

    def release(self) -> None:
        if self.held:
            self.files.delete(self.path)
            self.held = False

    def __enter__(self) -> Fence:
        self.acquire()
        return self

    def __exit__(self, *_) -> None:
        self.release()
