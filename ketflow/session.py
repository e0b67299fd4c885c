"""Running circuits: plan, execute cut by cut, optionally durable and resumable."""

from __future__ import annotations

import os
import random
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ketflow.operators import dense as D
from ketflow.operators import measure as M
from ketflow.operators.apply import checked, initial_state, run_stages
from ketflow.plans import circuit as C
from ketflow.plans import rewrite as R
from ketflow.sources import store as S
from ketflow.sources.qasm import Program

#: Session settings that the engine relies on; nothing else is set.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "snappy",
}


@dataclass(frozen=True)
class Config:
    """Knobs of a run.

    ``keep_versions`` old versions stay besides the last; ``crash_after`` raises after that
    many steps (for recovery tests).
    """

    base_path: str = ""
    run_id: str = "default"
    fusion: bool = True
    staging: bool | str = True
    local_qubits: int | None = None
    block_width: int = R.MAX_BLOCK
    cut_every: int = R.CUT_EVERY
    epsilon: float = 1e-15
    policy: S.Policy = field(default_factory=S.Policy)
    checksums: bool = False
    keep_versions: int = 2
    crash_after: int | None = None


def spark_session(app: str = "ketflow", master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; without a master the cluster's own is used."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **settings}.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


@dataclass
class Result:
    """Final state and what the run did."""

    state: DataFrame
    n: int
    steps: int
    resumed_from: int = 0
    version: int | None = None
    seconds: float = 0.0
    plan_hash: str = ""

    def to_dict(self) -> dict[int, complex]:
        return M.to_dict(self.state)

    def to_dense(self) -> DataFrame:
        return M.to_dense(self.state, self.n)

    def metrics(self) -> dict:
        return {"n_qubits": self.n, "steps": self.steps, "resumed_from": self.resumed_from, "version": self.version, "seconds": self.seconds}


class InjectedCrash(RuntimeError):
    """Raised by ``Config.crash_after``."""


class Session:
    """Entry point: ``Session(spark, Config(...)).run(circuit)``."""

    def __init__(self, spark: SparkSession, config: Config | None = None) -> None:
        self.spark, self.config = spark, config or Config()

    def plan(self, circuit: C.Circuit | dict) -> R.Plan:
        circuit = C.parse(circuit) if isinstance(circuit, dict) else circuit
        c = self.config
        return R.plan(circuit, c.fusion, c.staging, c.local_qubits, c.block_width, c.cut_every)

    def lazy(self, circuit: C.Circuit | dict, state: DataFrame | None = None) -> DataFrame:
        """The whole circuit as one lazy DataFrame, for circuits of few general operators."""
        df = initial_state(self.spark) if state is None else state
        for cut in self.plan(circuit).cuts:
            df = run_stages(df, cut.stages, self.config.epsilon)
        return df

    def run(self, circuit: C.Circuit | dict, state: DataFrame | None = None, durable: bool = False, resume: bool = True) -> Result:
        """Run a circuit from |0...0> or a given state.

        Each cut is one job whose result is written and read back: to the run's versioned
        states if ``durable``, else to the shared checkpoint folder.  A durable run logs each
        step before and after it and goes on after the last complete one.
        """
        circuit = C.parse(circuit) if isinstance(circuit, dict) else circuit
        return self._durable(circuit, state, resume) if durable else self._plain(circuit, state)

    def _plain(self, circuit: C.Circuit, state: DataFrame | None) -> Result:
        began, plan = time.time(), self.plan(circuit)
        df = initial_state(self.spark) if state is None else state
        for k, cut in enumerate(plan.cuts):
            df = run_stages(df, cut.stages, self.config.epsilon)
            if k < len(plan.cuts) - 1:
                df = cut_lineage(df)
        return Result(df, circuit.n, len(plan.cuts), seconds=time.time() - began, plan_hash=plan.hash)

    def _durable(self, circuit: C.Circuit, state: DataFrame | None, resume: bool) -> Result:
        c, plan, began = self.config, self.plan(circuit), time.time()
        if not c.base_path:
            raise ValueError("a durable run needs a base_path")
        store, log, points = S.StateStore(self.spark, c.base_path, c.run_id), S.Log(self.spark, c.base_path), S.Checkpoints(self.spark, c.base_path)
        with S.Fence(self.spark, c.base_path, c.run_id):
            at = S.recover(self.spark, c.base_path, c.run_id, plan.hash, len(plan.cuts)) if resume else S.ResumePoint(0, 0, False)
            if at.next_step == 0:
                store.save(checked(initial_state(self.spark) if state is None else state), 0)
            df, version = store.load(at.version if at.next_step else 0), at.version if at.next_step else 0
            last_step, last_time = at.next_step, time.time()
            for k in range(at.next_step, len(plan.cuts)):
                record = {"wal_id": k, "run_id": c.run_id, "plan_hash": plan.hash, "step_start": k, "step_end": k + 1, "state_version_in": version, "state_version_out": version + 1}
                log.append(**record, status=S.PENDING)
                try:
                    path = store.save(checked(run_stages(df, plan.cuts[k].stages, c.epsilon)), version + 1)
                    if c.crash_after is not None and k - at.next_step + 1 >= c.crash_after:
                        raise InjectedCrash(f"after step {k}")
                except InjectedCrash:
                    raise
                except Exception:
                    log.append(**record, status=S.FAILED)
                    raise
                version += 1
                if c.policy.due(version, k + 1 - last_step, time.time() - last_time):
                    points.create(c.run_id, plan.hash, version, k, path, store.load(version) if c.checksums else None)
                    last_step, last_time = k + 1, time.time()
                log.append(**record, status=S.COMMITTED)
                df = store.load(version)
                if version > c.keep_versions:
                    store.delete(version - c.keep_versions - 1)
        return Result(df, circuit.n, len(plan.cuts), at.next_step, version, time.time() - began, plan.hash)

    def run_dense(self, circuit: C.Circuit | dict, state: DataFrame | None = None) -> Result:
        """Run a circuit on whole blocks of amplitudes, for states with most amplitudes present."""
        circuit = C.parse(circuit) if isinstance(circuit, dict) else circuit
        began, k = time.time(), self.config.local_qubits or D.LOCAL
        first = D.zero(self.spark, circuit.n, k) if state is None else D.from_rows(state, circuit.n, k)
        done = D.run(first, circuit, self.config.block_width, cut_lineage)
        return Result(D.to_rows(done, self.config.epsilon), circuit.n, 1, seconds=time.time() - began)

    def run_program(self, program: Program, seed: int = 0, state: DataFrame | None = None) -> tuple[Result, dict[str, int]]:
        """One run of a program with measurements, resets and classically controlled gates: its state and its registers.

        Outcomes come from a generator with ``seed``, in program order.  Gates between two
        measurements are planned together; the state is written before each outcome is read,
        so that a recomputed task cannot see another one.
        """
        began, draw, n = time.time(), random.Random(seed), program.circuit.n
        bits = {name: [0] * size for name, size in program.registers.items()}
        value = lambda name: sum(b << i for i, b in enumerate(bits[name]))
        df = initial_state(self.spark) if state is None else state
        pending: list[dict] = []
        steps = 0

        def settle() -> DataFrame:
            nonlocal steps
            if not pending:
                return df
            done = self._plain(C.parse({"number_of_qubits": n, "gates": list(pending)}), df)
            steps += done.steps
            pending.clear()
            return done.state

        for e in program.events:
            if e.condition and value(e.condition[0]) != e.condition[1]:
                continue
            if e.kind == "gates":
                pending += e.gates
                continue
            df = cut_lineage(settle())
            if e.kind == "measure":
                df, bits[e.bit[0]][e.bit[1]] = M.collapse(df, e.qubit, draw.random())
            else:
                df = M.reset(df, e.qubit, draw.random())
        df = settle()
        return Result(df, n, steps, seconds=time.time() - began), {name: value(name) for name in bits}

    def run_named(self, generator: Callable[..., C.Circuit], *args, **kwargs) -> Result:
        """Run a generated circuit, e.g. ``run_named(generators.ghz, 5)``."""
        return self.run(generator(*args, **kwargs))


def cut_lineage(df: DataFrame) -> DataFrame:
    """``checkpoint()`` to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; a local session without one, as in tests, gets one, on a cluster that is an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        told = spark.conf.get("spark.checkpoint.dir", None)
        if not told and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(told or f"file:///tmp/ketflow-checkpoints-{os.getuid()}")
    return spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().get()


def probability_of(result: Result, qubit: int, value: int = 1) -> float:
    return M.qubit_probability(result.state, qubit, value).first()[0]


def run_sql(spark: SparkSession, circuit: C.Circuit | dict, view: str = "state", cut_every: int = 4) -> DataFrame:
    """The SQL path: one SELECT a gate over a versioned temp view; all versions in the end.

    The view holds the last version only, and every ``cut_every`` gates it is written, so
    the plan of a version stays that short and the whole plan grows with the gates, no faster.
    """
    from ketflow.operators.sqltext import apply_sql

    circuit = C.parse(circuit) if isinstance(circuit, dict) else circuit
    last = initial_state(spark).select(F.lit(0).alias("version"), "idx", "real", "imag")
    versions = [last]
    for v, g in enumerate(circuit.gates):
        last.createOrReplaceTempView(view)
        last = spark.sql(apply_sql(g, v, view))
        if (v + 1) % cut_every == 0:
            last = cut_lineage(last)
        versions.append(last)
    last.createOrReplaceTempView(view)
    return reduce(DataFrame.unionByName, versions)
