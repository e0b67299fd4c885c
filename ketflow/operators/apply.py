"""Gate application over state DataFrames.

Three physical forms, chosen from the matrix and not from the gate's name:

D  diagonal     one projection that multiplies by a phase; never a shuffle
P  monomial     one projection that rewrites bits and multiplies; a bijection on the index
G  general      explode into the non-zero entries of the column, then a hash aggregate

Inside a stage the state is (hi, lo, real, imag), where ``lo`` holds the local bits and
``hi`` all others, each at its own place, so idx = hi | lo.  Rows are distributed by
``hi`` once; general operators on local qubits only change ``lo``, and their aggregates
by (hi, lo) need no further exchange.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ketflow.functions import bits as B
from ketflow.functions import gates as G
from ketflow.plans.circuit import Gate
from ketflow.plans.rewrite import Op, Stage, angle_of, combined, lower
from ketflow.schema import EPSILON, GATE_MATRIX, STATE


def initial_state(spark: SparkSession) -> DataFrame:
    """|0...0>: one row, made in the JVM."""
    return spark.range(1).select(F.col("id").alias("idx"), F.lit(1.0).alias("real"), F.lit(0.0).alias("imag"))


def prune(df: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Drop amplitudes both of whose parts are at most ``epsilon``."""
    return df.filter((F.abs("real") > epsilon) | (F.abs("imag") > epsilon))


def to_blocks(state: DataFrame, local: Iterable[int]) -> DataFrame:
    """(idx, real, imag) -> (hi, lo, real, imag) for a set of local qubits."""
    mask = B.mask_of(local)
    return state.select(F.col("idx").bitwiseAND(B.long_lit(~mask)).alias("hi"), F.col("idx").bitwiseAND(B.long_lit(mask)).alias("lo"), "real", "imag")


def from_blocks(df: DataFrame) -> DataFrame:
    return df.select(F.col("hi").bitwiseOR(F.col("lo")).alias("idx"), "real", "imag")


def _times(re: Column, im: Column, z: complex) -> tuple[Column, Column]:
    """Column pair times a constant, without the terms that vanish."""
    a, b = float(z.real), float(z.imag)
    if b == 0:
        return (re, im) if a == 1 else (re * a, im * a)
    if a == 0:
        return im * -b, re * b
    return re * a - im * b, re * b + im * a


def _select(p: Column, values: list[Column], fallback: Column) -> Column:
    """CASE over small patterns; equal tails fall through to ``fallback``."""
    out = fallback
    for k in reversed(range(len(values))):
        if values[k] is not None:
            out = F.when(p == k, values[k]).otherwise(out)
    return out


def _diagonal(df: DataFrame, idx: Column, op: Op, keep: list[str]) -> DataFrame:
    re, im = F.col("real"), F.col("imag")
    p = B.pattern(idx, op.targets)
    parts = [None if abs(z - 1) <= G.ZERO else _times(re, im, z) for z in np.diag(op.u)]
    new_re = _select(p, [None if x is None else x[0] for x in parts], re)
    new_im = _select(p, [None if x is None else x[1] for x in parts], im)
    if op.controls:
        on = B.all_set(idx, op.controls)
        new_re, new_im = F.when(on, new_re).otherwise(re), F.when(on, new_im).otherwise(im)
    return df.select(*keep, new_re.alias("real"), new_im.alias("imag"))


def _phases(df: DataFrame, idx: Column, ops: list[Op], keep: list[str]) -> DataFrame:
    """A run of diagonal unitaries as one projection: the angles add up, then one rotation."""
    angle = None
    for op in ops:
        p = B.pattern(idx, op.targets)
        angles = [angle_of(z) for z in np.diag(op.u)]
        term = _select(p, [F.lit(a) if a else None for a in angles], F.lit(0.0))
        if op.controls:
            term = F.when(B.all_set(idx, op.controls), term).otherwise(F.lit(0.0))
        angle = term if angle is None else angle + term
    turned = df.select(*keep, "real", "imag", angle.alias("angle"))
    rotated = turned.select(*keep, "real", "imag", F.cos("angle").alias("c"), F.sin("angle").alias("s"))
    return rotated.select(*keep, (F.col("real") * F.col("c") - F.col("imag") * F.col("s")).alias("real"), (F.col("real") * F.col("s") + F.col("imag") * F.col("c")).alias("imag"))


def _monomial(idx: Column, op: Op) -> tuple[Column, Column, Column]:
    """(new index, real, imag) of a permutation with phases."""
    re, im = F.col("real"), F.col("imag")
    p = B.pattern(idx, op.targets)
    flips, new_re, new_im = [], [], []
    for col in range(len(op.u)):
        row = int(np.argmax(np.abs(op.u[:, col])))
        z = op.u[row, col]
        flips.append(B.scatter(row ^ col, op.targets))
        same = abs(z - 1) <= G.ZERO
        x = None if same else _times(re, im, z)
        new_re.append(None if same else x[0])
        new_im.append(None if same else x[1])
    if len(set(flips)) == 1:
        flip = B.long_lit(flips[0])
    else:
        flip = _select(p, [B.long_lit(f) if f else None for f in flips], B.long_lit(0))
    out_re, out_im = _select(p, new_re, re), _select(p, new_im, im)
    if op.controls:
        on = B.all_set(idx, op.controls)
        flip = F.when(on, flip).otherwise(B.long_lit(0))
        if any(x is not None for x in new_re):
            out_re, out_im = F.when(on, out_re).otherwise(re), F.when(on, out_im).otherwise(im)
    return idx.bitwiseXOR(flip), out_re, out_im


def _branches(idx: Column, lo: Column, op: Op) -> Column:
    """Array of (lo, real, imag) that a row contributes to under a general operator."""
    re, im = F.col("real"), F.col("imag")
    base = B.clear(lo, op.targets)
    p = B.pattern(idx, op.targets)

    def entry(row: int, z: complex) -> Column:
        a, b = _times(re, im, z)
        return F.struct(base.bitwiseOR(B.long_lit(B.scatter(row, op.targets))).alias("lo"), a.alias("real"), b.alias("imag"))

    columns = [F.array(*[entry(r, op.u[r, c]) for r in range(len(op.u)) if abs(op.u[r, c]) > G.ZERO]) for c in range(len(op.u))]
    out = columns[-1]
    for c in reversed(range(len(columns) - 1)):
        out = F.when(p == c, columns[c]).otherwise(out)
    if op.controls:
        alone = F.array(F.struct(lo.alias("lo"), re.alias("real"), im.alias("imag")))
        out = F.when(B.all_set(idx, op.controls), out).otherwise(alone)
    return out


#: Projections in a row before a fence.
_FENCE = 5


def fence(df: DataFrame, keep: list[str], made: list[str]) -> DataFrame:
    """The same rows behind a one-element explode, which the optimiser does not move filters through.

    A filter on an amplitude would else be pushed below a chain of projections by putting
    each into the next, which doubles the expression at every step.  ``keep`` stays what it
    is, so a distribution by it stays known.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*made))))


def run_stage(df: DataFrame, stage: Stage, epsilon: float = EPSILON) -> DataFrame:
    """Operators of one stage over (hi, lo, real, imag)."""
    ops = list(stage.ops)
    k = chain = 0
    while k < len(ops):
        op = ops[k]
        kind = op.kind
        chain = 0 if kind == "G" else chain + 1
        if chain > _FENCE:
            df, chain = fence(df, ["hi"], ["lo", "real", "imag"]), 1
        idx = F.col("hi").bitwiseOR(F.col("lo"))
        if kind == "D":
            end = k
            while end < len(ops) and ops[end].kind == "D" and np.allclose(np.abs(np.diag(ops[end].u)), 1, atol=1e-12):
                end += 1
            if end - k > 1:
                df = _phases(df, idx, ops[k:end], ["hi", "lo"])
                k = end
                continue
            df = _diagonal(df, idx, op, ["hi", "lo"])
        elif kind == "P":
            new, re, im = _monomial(idx, op)
            if set(op.targets) <= stage.local:
                mask = B.long_lit(B.mask_of(stage.local))
                df = df.select("hi", new.bitwiseAND(mask).alias("lo"), re.alias("real"), im.alias("imag"))
            else:
                df = to_blocks(df.select(new.alias("idx"), re.alias("real"), im.alias("imag")), stage.local)
        elif set(op.targets) <= stage.local:
            spread = df.select("hi", F.explode(_branches(idx, F.col("lo"), op)).alias("e"))
            spread = spread.select("hi", "e.lo", "e.real", "e.imag")
            df = prune(spread.groupBy("hi", "lo").agg(F.sum("real").alias("real"), F.sum("imag").alias("imag")), epsilon)
        else:
            df = to_blocks(apply_op(from_blocks(df), op, epsilon), stage.local)
        k += 1
    return df


def run_stages(state: DataFrame, todo: Iterable[Stage], epsilon: float = EPSILON) -> DataFrame:
    """Stages one after the other over (idx, real, imag); one exchange before a stage with several general operators."""
    for st in todo:
        df = to_blocks(state, st.local)
        if st.general > 1:
            df = df.repartition("hi")
        state = from_blocks(run_stage(df, st, epsilon))
    return state


def apply_op(state: DataFrame, op: Op, epsilon: float = EPSILON) -> DataFrame:
    """One operator over (idx, real, imag); a general one costs one exchange with map-side sums."""
    idx = F.col("idx")
    if op.kind == "D":
        return _diagonal(state, idx, op, ["idx"])
    if op.kind == "P":
        new, re, im = _monomial(idx, op)
        return state.select(new.alias("idx"), re.alias("real"), im.alias("imag"))
    spread = state.select(F.explode(_branches(idx, idx, op)).alias("e")).select(F.col("e.lo").alias("idx"), "e.real", "e.imag")
    return prune(spread.groupBy("idx").agg(F.sum("real").alias("real"), F.sum("imag").alias("imag")), epsilon)


def apply_gate(state: DataFrame, gate: Gate) -> DataFrame:
    return apply_op(state, lower(gate))


def apply_gates(state: DataFrame, gates: Iterable[Gate]) -> DataFrame:
    """Gates in order, lazily."""
    chain = 0
    for g in gates:
        chain = 0 if lower(g).kind == "G" else chain + 1
        if chain > _FENCE:
            state, chain = fence(state, [], ["idx", "real", "imag"]), 1
        state = apply_gate(state, g)
    return state


def apply_one_qubit(state: DataFrame, u: np.ndarray, q: int) -> DataFrame:
    return apply_op(state, Op((), (q,), np.asarray(u, dtype=complex)))


def apply_two_qubit(state: DataFrame, u: np.ndarray, q0: int, q1: int) -> DataFrame:
    """Matrix over sub-index b(q0) | b(q1) << 1."""
    return apply_op(state, Op((), (q0, q1), np.asarray(u, dtype=complex)))


def apply_parallel(state: DataFrame, gates: list[Gate], width: int = 3) -> DataFrame:
    """Gates without a common qubit as tensor products of at most ``width`` qubits, one pass each."""
    group: list[Gate] = []
    for g in gates:
        if group and len({q for x in (*group, g) for q in x.qubits}) > width:
            state = apply_op(state, combined(group))
            group = []
        group.append(g)
    return apply_op(state, combined(group)) if group else state


def apply_level(state: DataFrame, level: list[Gate]) -> DataFrame:
    return apply_parallel(state, level)


def apply_matrix_join(state: DataFrame, matrix: DataFrame, qubits: tuple[int, ...]) -> DataFrame:
    """The relational form: the state joined to a gate's matrix relation (col, row, real, imag) on the sub-index.

    A gate matrix has at most 4^m rows for m qubits, so it is broadcast; m is checked.
    """
    if len(qubits) > 5:
        raise ValueError("matrix relations of more than 5 qubits are not broadcast")
    m = matrix.select(F.col("col").alias("m_col"), F.col("row").alias("m_row"), F.col("real").alias("m_re"), F.col("imag").alias("m_im"))
    bits = [F.when(F.col("m_row").bitwiseAND(F.lit(1 << i)) != 0, B.long_lit(1 << q)).otherwise(B.long_lit(0)) for i, q in enumerate(qubits)]
    joined = state.withColumn("sub", B.pattern(F.col("idx"), qubits).cast("int")).join(F.broadcast(m), F.col("sub") == F.col("m_col"))
    moved = joined.select(
        B.bit_or([B.clear(F.col("idx"), qubits), *bits]).alias("idx"),
        (F.col("real") * F.col("m_re") - F.col("imag") * F.col("m_im")).alias("real"),
        (F.col("real") * F.col("m_im") + F.col("imag") * F.col("m_re")).alias("imag"),
    )
    return prune(moved.groupBy("idx").agg(F.sum("real").alias("real"), F.sum("imag").alias("imag")))


def matrix_relation(spark: SparkSession, gates: Iterable[Gate]) -> DataFrame:
    """The matrices of some gates as one relation; the key holds the parameters, so equal names with other angles stay apart."""
    rows, seen = [], set()
    for g in gates:
        key = matrix_key(g)
        if key not in seen:
            seen.add(key)
            rows += [(key, len(g.qubits), r, c, re, im) for r, c, re, im in G.rows_of(g.name, g.params)]
    return spark.createDataFrame(rows, GATE_MATRIX)


def matrix_key(gate: Gate) -> str:
    """Name and parameters of a gate, the key of its matrix."""
    shown = ",".join(f"{k}={np.asarray(v).tolist()}" for k, v in sorted(gate.params.items()))
    return f"{G.canonical(gate.name)}({shown})"


def permute_state(state: DataFrame, log_to_phys: list[int]) -> DataFrame:
    """Move bit ``log_to_phys[q]`` of the index to bit q."""
    return state.select(B.permute(F.col("idx"), log_to_phys).alias("idx"), "real", "imag")


def checked(state: DataFrame) -> DataFrame:
    """The state with exactly the columns and types of the schema."""
    return state.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STATE.fields])
