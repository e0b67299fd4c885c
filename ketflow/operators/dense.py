"""Dense states in blocks: matrix kernels over whole blocks of amplitudes.

For states with most amplitudes present a row an amplitude is the wrong size.  Here a row
is ``(chunk, amps)``: 2^k amplitudes as little-endian complex numbers, and a *layout* says
which qubit each bit is, the k bits inside a block first, then those of ``chunk``.  A block
of zeros has no row.

A stage (``plans.rewrite.stages``) runs on one layout: its operators move local qubits
only, so each is a matrix product inside a block; controls and diagonals on the chunk's
bits only choose what a block does.  Between stages m local qubits are swapped with m of
the chunk: each block is cut into 2^m pieces and the pieces of a new block meet in one
aggregation, whose groups are one block by definition.  That is one exchange of the state
and no row per amplitude.  Every ``CUT_STAGES`` stages the state is checkpointed.

The workers get plain tuples and closures only, so executors need no copy of this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ketflow.plans import circuit as C
from ketflow.plans import rewrite as R

#: Qubits inside a block by default: 4 MB a block of complex128.
LOCAL = 18
#: Blocks of a task after an exchange, and the most tasks of one.  Tasks follow the dense size: blocks of like amplitudes compress so well that bytes shuffled say nothing of the work.
TASK_BLOCKS = 8
MAX_TASKS = 1 << 16
#: Stages between two writes of the state.
CUT_STAGES = 4
BLOCK = "chunk bigint, amps binary"


@dataclass(frozen=True)
class Dense:
    """Block rows, their layout (qubit of each bit), bits inside a block, and the type of amplitudes."""

    blocks: DataFrame
    layout: tuple[int, ...]
    k: int
    dtype: str = "<c16"

    @property
    def n(self) -> int:
        return len(self.layout)


def zero(spark: SparkSession, n: int, k: int = LOCAL, dtype: str = "<c16") -> Dense:
    """|0...0>: one block."""
    k = min(k, n)
    first = np.zeros(1 << k, dtype)
    first[0] = 1
    text = F.unhex(F.concat(F.lit(first[:1].tobytes().hex()), F.repeat(F.lit("00"), ((1 << k) - 1) * first.itemsize)))
    return Dense(spark.range(1).select(F.col("id").alias("chunk"), text.alias("amps")), tuple(range(n)), k, dtype)


def from_rows(state: DataFrame, n: int, k: int = LOCAL, dtype: str = "<c16") -> Dense:
    """Blocks of (idx, real, imag) rows; a block gathers its own amplitudes only, rows of equal idx add up."""
    k = min(k, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, rows in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at, re, im = (c.to_numpy(zero_copy_only=False) for c in rows.values.flatten())
                v = np.zeros(1 << k, dtype)
                np.add.at(v, at, re + 1j * im)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([v.tobytes()], pa.binary())], names=["chunk", "amps"])

    low = F.col("idx").bitwiseAND(F.lit((1 << k) - 1)).cast("int").alias("at")
    rows = state.select(F.shiftright("idx", k).alias("chunk"), F.struct(low, "real", "imag").alias("e"))
    return Dense(rows.groupBy("chunk").agg(F.collect_list("e").alias("e")).mapInArrow(run, BLOCK), tuple(range(n)), k, dtype)


def to_rows(state: Dense, epsilon: float = 0.0) -> DataFrame:
    """(idx, real, imag) rows of the amplitudes with a part above ``epsilon``."""
    layout, k, dtype = state.layout, state.k, state.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.zeros(1 << k, np.int64)
        for p in range(k):
            low |= (np.arange(1 << k) >> p & 1) << layout[p]
        for b in batches:
            for chunk, amps in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.frombuffer(amps.as_buffer(), dtype)
                at = np.flatnonzero((np.abs(v.real) > epsilon) | (np.abs(v.imag) > epsilon))
                base = sum((chunk >> j & 1) << q for j, q in enumerate(layout[k:]))
                for i in range(0, len(at), 1 << 16):
                    part = at[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(low[part] + base), pa.array(v.real[part].astype(float)), pa.array(v.imag[part].astype(float))], names=["idx", "real", "imag"])

    return state.blocks.mapInArrow(run, "idx bigint, real double, imag double")


def norm(state: Dense) -> DataFrame:
    """One row: the sum of squared magnitudes, a number a block before any shuffle."""
    dtype = state.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [float(np.sum(np.abs(np.frombuffer(a.as_buffer(), dtype)) ** 2, dtype=float)) for a in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.float64())], names=["s"])

    return state.blocks.mapInArrow(run, "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("norm"))


def _kernel(layout: tuple[int, ...], k: int, dtype: str, ops: list[R.Op]) -> Callable:
    """Function (chunk, block) -> block for the operators of a stage."""
    place = {q: p for p, q in enumerate(layout)}
    plain = [([place[q] for q in op.controls], [place[q] for q in op.targets], np.asarray(op.u, dtype), op.kind) for op in ops]
    for _, targets, _, kind in plain:
        if kind != "D" and any(p >= k for p in targets):
            raise ValueError("a stage moves a qubit that is not local")

    def run(chunk: int, block: np.ndarray) -> np.ndarray:
        v = block.reshape((2,) * k)
        axis = lambda p: k - 1 - p
        for controls, targets, u, kind in plain:
            if any(p >= k and not chunk >> (p - k) & 1 for p in controls):
                continue
            spot: list = [slice(None)] * k
            for p in controls:
                if p < k:
                    spot[axis(p)] = slice(1, 2)
            part = v[tuple(spot)]
            if kind == "D":
                d = np.diag(u).reshape((2,) * len(targets))  # axis 0 is the last target
                outer = tuple(chunk >> (p - k) & 1 if p >= k else slice(None) for p in reversed(targets))
                d, inner = d[outer], [p for p in reversed(targets) if p < k]
                order = sorted(range(len(inner)), key=lambda i: -inner[i])
                shape = [1] * k
                for p in inner:
                    shape[axis(p)] = 2
                part *= np.transpose(d, order).reshape(shape) if inner else d
                continue
            axes = [axis(p) for p in reversed(targets)]
            moved = np.moveaxis(part, axes, range(len(axes)))
            flat = u @ moved.reshape(len(u), -1)
            part[...] = np.moveaxis(flat.reshape(moved.shape), range(len(axes)), axes)
        return v.reshape(-1)

    return run


def run_stage(state: Dense, stage: R.Stage) -> Dense:
    """Operators of one stage on blocks whose local qubits are the stage's."""
    if not stage.ops:
        return state
    work, dtype = _kernel(state.layout, state.k, state.dtype, list(stage.ops)), state.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, amps in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                done = work(chunk, np.frombuffer(amps.as_buffer(), dtype).copy())
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([done.tobytes()], pa.binary())], names=["chunk", "amps"])

    return Dense(state.blocks.mapInArrow(run, BLOCK), state.layout, state.k, dtype)


def exchange(state: Dense, local: frozenset[int]) -> Dense:
    """The same state with all qubits of ``local`` inside the blocks; only as many swap places as must."""
    layout, k, dtype = state.layout, state.k, state.dtype
    if len(local) > k:
        raise ValueError(f"{len(local)} local qubits in blocks of {k}")
    enter = [p for p in range(k, len(layout)) if layout[p] in local]
    leave = [p for p in range(k) if layout[p] not in local][-len(enter) :] if enter else []  # the highest bits: pieces stay long
    if not enter:
        return state
    m = len(enter)
    after = list(layout)
    for a, b in zip(leave, enter, strict=True):
        after[a], after[b] = layout[b], layout[a]
    axes = [k - 1 - p for p in reversed(leave)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, amps in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.frombuffer(amps.as_buffer(), dtype).reshape((2,) * k)
                pieces = np.ascontiguousarray(np.moveaxis(v, axes, range(m))).reshape(1 << m, -1)
                place = sum((chunk >> (p - k) & 1) << i for i, p in enumerate(enter))
                base = chunk & ~sum(1 << (p - k) for p in enter)
                new, kept = [], []
                for j in range(1 << m):
                    if pieces[j].any():
                        new.append(base | sum((j >> i & 1) << (p - k) for i, p in enumerate(enter)))
                        kept.append(pieces[j].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([place] * len(new), pa.int32()), pa.array(kept, pa.binary())], names=["chunk", "place", "piece"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, parts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                places, pieces = parts.values.flatten()
                v = np.zeros((1 << m, (1 << k) >> m), dtype)
                for j, piece in zip(places.to_pylist(), pieces, strict=True):
                    v[j] = np.frombuffer(piece.as_buffer(), dtype)
                whole = np.ascontiguousarray(np.moveaxis(v.reshape((2,) * k), range(m), axes))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([whole.tobytes()], pa.binary())], names=["chunk", "amps"])

    pieces = state.blocks.mapInArrow(cut, "chunk bigint, place int, piece binary")
    tasks = min(MAX_TASKS, -(-(1 << (len(layout) - k)) // TASK_BLOCKS))
    met = pieces.repartition(tasks, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("place", "piece")).alias("parts"))
    return Dense(met.mapInArrow(join, BLOCK), tuple(after), k, dtype)


def run(state: Dense, circuit: C.Circuit, width: int = R.MAX_BLOCK, cut: Callable[[DataFrame], DataFrame] | None = None) -> Dense:
    """A circuit on a dense state; ``cut`` writes the blocks every ``CUT_STAGES`` stages (``session.cut_lineage``)."""
    if circuit.n != state.n:
        raise C.CircuitError(f"a circuit of {circuit.n} qubits on a state of {state.n}")
    ops = R.fuse([R.lower(g) for g in circuit.gates], min(width, state.k))
    for i, stage in enumerate(R.stages(ops, circuit.n, state.k)):
        moving = frozenset().union(*(op.moving for op in stage.ops))
        state = run_stage(exchange(state, moving), stage)
        if cut is not None and (i + 1) % CUT_STAGES == 0:
            state = Dense(cut(state.blocks), state.layout, state.k, state.dtype)
    return state
