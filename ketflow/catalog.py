"""Every query of the engine by name, with its DuckDB oracle.

States are anchored in the tables by amplitude encoding, and the oracles are written as
the textbook join and group-by over inlined matrices, a formulation that shares nothing
with the projections and explodes that the engine runs.  Doubles are rounded to nine
places on both sides; rows with both parts below 1e-12 are left out on both sides.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ketflow.functions import gates as G
from ketflow.operators import apply as A
from ketflow.operators import dense as D
from ketflow.operators import encode as E
from ketflow.operators import measure as M
from ketflow.operators import relational as Q
from ketflow.operators import sqltext as X
from ketflow.plans import circuit as C
from ketflow.plans import generators as gen
from ketflow.plans import rewrite as R
from ketflow.session import Config, InjectedCrash, Session, run_sql, shared_folder
from ketflow.sources import chunks, qasm
from ketflow.sources import store as S

Query = Callable[[SparkSession, str], DataFrame]

N = 6
EPS = 1e-12
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r9(c) -> Column:
    return F.round(c, 9) + F.lit(0.0)


def out(state: DataFrame) -> DataFrame:
    """A state as the queries return it."""
    return A.prune(state, EPS).select("idx", r9("real").alias("real"), r9("imag").alias("imag"))


def out_sql(source: str) -> str:
    return f"SELECT idx::BIGINT AS idx, round(real, 9) + 0.0 AS real, round(imag, 9) + 0.0 AS imag FROM {source} WHERE abs(real) > {EPS} OR abs(imag) > {EPS}"


# --- encodings --------------------------------------------------------------

ENCODINGS = {
    "lineitem": ("l_orderkey", "l_quantity", N),
    "orders": ("o_custkey", "o_totalprice", N),
    "events": ("user_id", "value", 8),
    "customer": ("c_custkey", "c_acctbal", N),
}


def encoded(spark: SparkSession, sf_dir: str, name: str = "lineitem", n: int | None = None) -> DataFrame:
    key, weight, width = ENCODINGS[name]
    return E.amplitude_encode(table(spark, sf_dir, name), F.col(key), n or width, F.col(weight))


def encoded_sql(name: str = "lineitem", n: int | None = None) -> str:
    key, weight, width = ENCODINGS[name]
    size = 1 << (n or width)
    return (
        f"(SELECT idx, w / sqrt(sum(w * w) OVER ()) AS real, 0.0::DOUBLE AS imag FROM "
        f"(SELECT ({key} % {size})::BIGINT AS idx, sum({weight}::DOUBLE) AS w FROM {name} WHERE {key} IS NOT NULL AND {weight} IS NOT NULL GROUP BY 1) WHERE w <> 0)"
    )


ZERO_SQL = "(SELECT 0::BIGINT AS idx, 1.0::DOUBLE AS real, 0.0::DOUBLE AS imag)"


def add(name: str, query: Query, sql: str | None = None) -> None:
    assert name not in QUERIES, name
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def circuit_sql(circuit: C.Circuit, start: str, select: Callable[[str], str] = out_sql) -> str:
    """Oracle of a circuit: one CTE a gate from the relation ``start``."""
    items, last = X.circuit_ctes(circuit, "s0")
    return f"WITH s0 AS {start}{', ' + items if items else ''} {select(last)}"


for _t in ENCODINGS:
    add(f"enc_{_t}", lambda s, d, t=_t: out(encoded(s, d, t)), f"WITH s0 AS {encoded_sql(_t)} {out_sql('s0')}")

add("enc_basis", lambda s, d: out(E.basis_encode(table(s, d, "part"), F.col("p_size"), N)), f"WITH k AS (SELECT DISTINCT (p_size % {1 << N})::BIGINT AS idx FROM part WHERE p_size IS NOT NULL), s0 AS (SELECT idx, 1 / sqrt(count(*) OVER ()) AS real, 0.0::DOUBLE AS imag FROM k) {out_sql('s0')}")
add("enc_vector", lambda s, d: out(E.vector_encode(table(s, d, "embeddings"), "embedding")), f"WITH v AS (SELECT (i - 1)::BIGINT AS idx, sum(embedding[i]::DOUBLE) AS w FROM (SELECT embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1), s0 AS (SELECT idx, w / sqrt(sum(w * w) OVER ()) AS real, 0.0::DOUBLE AS imag FROM v WHERE w <> 0) {out_sql('s0')}")


# --- one query a gate -------------------------------------------------------

_PARAMS = {"theta": 0.7, "phi": 0.4, "lam": 1.1, "k": 3, "p": 3, "num": 3, "pow": 2}
_U2 = [[math.cos(0.3), -math.sin(0.3)], [math.sin(0.3), math.cos(0.3)]]
_U4 = G.matrix("RXX", {"theta": 0.9}) @ G.matrix("CX")
#: Distinct places, not in order, with local and other qubits mixed.
_PLACES = (4, 1, 5, 0, 3)


def gate_circuit(name: str) -> C.Circuit:
    """H on qubit 1 (so that phases matter), then the gate."""
    if name in G.CUSTOM:
        arity, params = sum(G.CUSTOM[name]), {"U": _U4 if name == "C2" else _U2, "exponent": 1}
    else:
        arity, params = G.SPECS[name].arity, {p: _PARAMS[p] for p in G.SPECS[name].params}
    return C.of(N, [("H", (1,), {}), (name, _PLACES[:arity], params)])


def _run_gate(name: str) -> Query:
    return lambda s, d: out(A.apply_gates(encoded(s, d, "customer"), gate_circuit(name).gates))


for _g in (*G.SPECS, *G.CUSTOM):
    add(f"gate_{_g.lower()}", _run_gate(_g), circuit_sql(gate_circuit(_g), encoded_sql("customer")))


# --- circuits from |0...0> --------------------------------------------------

CIRCUITS = {
    "bell": gen.bell(),
    "ghz": gen.ghz(8),
    "ghz_reverse": gen.ghz(6, reverse=True),
    "qft": gen.qft(5),
    "qft_reverse": gen.qft(4, reverse=True),
    "qpe": gen.qpe(4),
    "w": gen.w(7),
    "hwall": gen.hadamard_wall(8),
    "w_qft": gen.w_qft(4),
    "ghz_qft": gen.ghz_qft(4),
    "ghz_alternating": gen.ghz_alternating(5, 12),
    "x_on_first": gen.x_on_first(),
    "ry_third": gen.ry_third(),
    "cr3": gen.cr3(),
    **{f"load_{k}": gen.load(k, 5) for k in ("ry", "h_t", "h_t_cr", "g", "r", "cu")},
    "sparse_4": gen.sparse(4, 6),
    "sparse_16": gen.sparse(16, 8),
    "partial": gen.partial(7, 3),
    "cluster": gen.cluster(6),
    "ring": gen.cluster(6, ring=True),
    "deutsch_jozsa": gen.deutsch_jozsa(7),
    "grover": gen.grover(3, 5, 2),
    "qaoa": gen.qaoa_ring(5, [(0.4, 0.7)]),
    "real_amplitudes": gen.real_amplitudes(4, 2),
    "ising": gen.ising(5, 2),
    "adder": gen.adder(2, 3, 2),
    "bernstein_vazirani": gen.bernstein_vazirani("10110"),
}

for _n, _c in CIRCUITS.items():
    add(f"circ_{_n}", lambda s, d, c=_c: out(Session(s).run(c).state), circuit_sql(_c, ZERO_SQL))


# --- circuits on an encoded state: fusion, tensor products, staging ---------

_MIXED = gen.random_circuit(N, 18, seed=11)


def _session(**knobs) -> Callable[[SparkSession, DataFrame, C.Circuit], DataFrame]:
    return lambda s, state, c: Session(s, Config(**knobs)).run(c, state).state


_RUNS = C.of(N, [("H", (0,), {}), ("T", (0,), {}), ("RY", (0,), {"theta": 0.4}), ("S", (3,), {}), ("H", (3,), {}), ("CX", (0, 3), {}), ("T", (3,), {}), ("H", (3,), {})])
add("fused_1q", lambda s, d: out(_session()(s, encoded(s, d), _RUNS)), circuit_sql(_RUNS, encoded_sql()))
add("fused_blocks", lambda s, d: out(_session(block_width=3)(s, encoded(s, d), _MIXED)), circuit_sql(_MIXED, encoded_sql()))
add("unfused", lambda s, d: out(_session(fusion=False)(s, encoded(s, d), _RUNS)), circuit_sql(_RUNS, encoded_sql()))

_LAYER = C.of(N, [("H", (0,), {}), ("T", (2,), {}), ("RY", (3,), {"theta": 0.9}), ("X", (5,), {}), ("CX", (1, 4), {})])
add("tensor_layer", lambda s, d: out(A.apply_parallel(encoded(s, d), list(_LAYER.gates))), circuit_sql(_LAYER, encoded_sql()))
add("level_layer", lambda s, d: out(A.apply_level(encoded(s, d), C.levelize(_LAYER)[0])), circuit_sql(_LAYER, encoded_sql()))
add("staged_qft", lambda s, d: out(_session(local_qubits=3)(s, encoded(s, d), gen.qft(N))), circuit_sql(gen.qft(N), encoded_sql()))
add("staged_exact", lambda s, d: out(_session(local_qubits=3, staging="exact")(s, encoded(s, d), _MIXED)), circuit_sql(_MIXED, encoded_sql()))
add("staged_mixed", lambda s, d: out(_session(local_qubits=3, cut_every=3)(s, encoded(s, d), _MIXED)), circuit_sql(_MIXED, encoded_sql()))


def _nonlocal(*gates) -> tuple[Query, str]:
    c = C.of(N, gates)
    stage = R.Stage(frozenset(range(3)), tuple(R.lower(g) for g in c.gates))
    return (lambda s, d: out(A.run_stages(encoded(s, d), [stage]))), circuit_sql(c, encoded_sql())


add("nonlocal_1q", *_nonlocal(("RY", (5,), {"theta": 0.6}), ("H", (1,), {})))
add("nonlocal_2q", *_nonlocal(("CU", (1, 4), {"U": _U2, "exponent": 2}), ("SWAP", (0, 5), {}), ("RXX", (4, 5), {"theta": 0.8})))
add("diagonal_run", *_nonlocal(("T", (5,), {}), ("CZ", (0, 4), {}), ("CR", (5, 1), {"k": 4}), ("RZZ", (2, 3), {"theta": 0.3})))

# the relational forms: joined matrix relation, and SQL text


def _matrix(spark: SparkSession, name: str, params: dict | None = None) -> DataFrame:
    return spark.createDataFrame(G.rows_of(name, params), "row int, col int, real double, imag double")


for _j, (_g, _p, _q) in {"join_1q": ("RY", {"theta": 0.7}, (2,)), "join_2q": ("SWAP", {}, (1, 4)), "join_3q": ("CCX", {}, (5, 0, 2))}.items():
    add(f"gate_{_j}", lambda s, d, g=_g, p=_p, q=_q: out(A.apply_matrix_join(encoded(s, d), _matrix(s, g, p), q)), circuit_sql(C.of(N, [(_g, _q, _p)]), encoded_sql()))

_SQL = C.of(3, [("H", (0,), {}), ("CX", (0, 2), {}), ("T", (2,), {}), ("RY", (1,), {"theta": 0.5})])
add("sql_path", lambda s, d: out(run_sql(s, _SQL).filter(f"version = {len(_SQL.gates)}").select("idx", "real", "imag")), circuit_sql(_SQL, ZERO_SQL))
add("one_qubit_matrix", lambda s, d: out(A.apply_one_qubit(encoded(s, d), G.matrix("SX"), 3)), circuit_sql(C.of(N, [("SX", (3,), {})]), encoded_sql()))
add("two_qubit_matrix", lambda s, d: out(A.apply_two_qubit(encoded(s, d), _U4, 4, 2)), circuit_sql(C.of(N, [("C2", (4, 2), {"U": _U4})]), encoded_sql()))

_TEXT = """
OPENQASM 2.0; include "qelib1.inc";
gate pair(t) a, b { h a; cx a, b; u1(3*t/4) b; }
qreg q[3]; qreg r[2]; creg c[3];
h q; pair(pi/2) q[0], r[1]; cu1(-pi/8) q[1], r[0]; barrier q; ccx q[0], q[1], r[0];
u3(0.3, pi, 2*pi/3) r[0]; swap q[2], r[1];
"""
add("qasm_program", lambda s, d: out(Session(s).run(qasm.read(_TEXT).circuit).state), circuit_sql(qasm.read(_TEXT).circuit, ZERO_SQL))

_PERM = [2, 0, 1, 5, 3, 4]
add(
    "permute_bits",
    lambda s, d: out(A.permute_state(encoded(s, d), _PERM)),
    f"WITH s0 AS {encoded_sql()}, p AS (SELECT {' | '.join(f'(((idx >> {p}) & 1) << {q})' for q, p in enumerate(_PERM))} AS idx, real, imag FROM s0) {out_sql('p')}",
)

# --- measurement ------------------------------------------------------------

_ROT = C.of(N, [("H", (0,), {}), ("RY", (3,), {"theta": 0.4}), ("CX", (0, 5), {})])


def rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.apply_gates(encoded(spark, sf_dir), _ROT.gates)


_P = "real * real + imag * imag"


def rotated_sql(select: str) -> str:
    return circuit_sql(_ROT, encoded_sql(), lambda last: select.replace("STATE", last))


add("norm", lambda s, d: M.norm(rotated(s, d)).select(r9("norm").alias("norm")), rotated_sql(f"SELECT round(sum({_P}), 9) + 0.0 AS norm FROM STATE"))
add("marginal_prob", lambda s, d: M.marginal(rotated(s, d), [4, 0]).select("outcome", r9("probability").alias("probability")), rotated_sql(f"SELECT ((idx >> 4) & 1) | ((idx & 1) << 1) AS outcome, round(sum({_P}), 9) + 0.0 AS probability FROM STATE GROUP BY 1"))
add("qubit_prob", lambda s, d: M.qubit_probability(rotated(s, d), 3).select(r9("probability").alias("probability")), rotated_sql(f"SELECT round(sum(CASE WHEN (idx >> 3) & 1 = 1 THEN {_P} ELSE 0 END), 9) + 0.0 AS probability FROM STATE"))
add(
    "project_renorm",
    lambda s, d: out(M.project(rotated(s, d), [1, 4], [0, 1], N)),
    rotated_sql(f"SELECT ((idx & 1) | (((idx >> 2) & 3) << 1) | (((idx >> 5) & 1) << 3))::BIGINT AS idx, round(real / w, 9) + 0.0 AS real, round(imag / w, 9) + 0.0 AS imag FROM (SELECT *, sqrt(sum({_P}) OVER ()) AS w FROM STATE WHERE (idx >> 1) & 1 = 0 AND (idx >> 4) & 1 = 1) WHERE abs(real / w) > {EPS} OR abs(imag / w) > {EPS}"),
)
add(
    "reset_qubit",
    lambda s, d: out(M.reset(encoded(s, d), 2)),
    f"WITH s0 AS {encoded_sql()}, z AS (SELECT idx, real / w AS real, imag / w AS imag FROM (SELECT *, sqrt(sum({_P}) OVER ()) AS w FROM s0 WHERE (idx >> 2) & 1 = 0)) {out_sql('z')}",
)
_TELEPORT = "qreg q[3]; creg a[1]; creg b[1]; ry(0.8) q[0]; h q[1]; cx q[1],q[2]; cx q[0],q[1]; h q[0]; measure q[0] -> a[0]; measure q[1] -> b[0]; if(b==1) x q[2]; if(a==1) z q[2]; reset q[0]; reset q[1];"
add("measured_program", lambda s, d: out(Session(s).run_program(qasm.read(_TELEPORT, classical=True), 5)[0].state), "SELECT 0::BIGINT AS idx, round(cos(0.4), 9) + 0.0 AS real, 0.0::DOUBLE AS imag UNION ALL SELECT 4::BIGINT, round(sin(0.4), 9) + 0.0, 0.0::DOUBLE")
add("merged_parts", lambda s, d: out(M.merge([encoded(s, d), rotated(s, d), encoded(s, d, "orders")])), circuit_sql(_ROT, encoded_sql(), lambda last: f", o AS {encoded_sql('orders')}, m AS (SELECT idx, sum(real) AS real, sum(imag) AS imag FROM (SELECT idx, real, imag FROM s0 UNION ALL SELECT idx, real, imag FROM {last} UNION ALL SELECT idx, real, imag FROM o) GROUP BY idx) {out_sql('m')}"))
add("sparsity", lambda s, d: M.sparsity(rotated(s, d), N).select("nonzero", r9("density").alias("density"), "bytes_saved"), rotated_sql(f"SELECT count(*)::BIGINT AS nonzero, round(count(*) / {2.0**N}, 9) + 0.0 AS density, {16.0 * 2**N} - 24.0 * count(*)::DOUBLE AS bytes_saved FROM STATE WHERE sqrt({_P}) > 1e-10"))
add("topk_amplitudes", lambda s, d: M.top_amplitudes(encoded(s, d), 5).select("idx", r9("probability").alias("probability")), f"WITH s0 AS {encoded_sql()} SELECT idx, round({_P}, 9) + 0.0 AS probability FROM s0 ORDER BY {_P} DESC, idx LIMIT 5")
add("overlap", lambda s, d: M.overlap(encoded(s, d), encoded(s, d, "orders")).select(*[r9(c).alias(c) for c in ("real", "imag", "magnitude")]), f"WITH a AS {encoded_sql()}, b AS {encoded_sql('orders')} SELECT round(sum(a.real * b.real), 9) + 0.0 AS real, 0.0::DOUBLE AS imag, round(abs(sum(a.real * b.real)), 9) + 0.0 AS magnitude FROM a JOIN b USING (idx)")
add("max_diff", lambda s, d: M.max_diff(encoded(s, d), rotated(s, d)).select(r9("max_diff").alias("max_diff")), circuit_sql(_ROT, encoded_sql(), lambda last: f"SELECT round(max(sqrt((coalesce(a.real, 0) - coalesce(b.real, 0)) ** 2 + (coalesce(a.imag, 0) - coalesce(b.imag, 0)) ** 2)), 9) + 0.0 AS max_diff FROM s0 a FULL JOIN {last} b USING (idx)"))
add("measure_cdf", lambda s, d: M.cumulative(rotated(s, d), 16).select("idx", r9("cumulative").alias("cumulative")), rotated_sql(f"SELECT idx, round(sum({_P}) OVER (ORDER BY idx), 9) + 0.0 AS cumulative FROM STATE"))


def _draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("draw_id"), (F.pmod(F.col("s_suppkey") * 7919, F.lit(100003)) / 100003.0).alias("u"))


add(
    "measure_sample",
    lambda s, d: M.pick(rotated(s, d), _draws(s, d), 16),
    rotated_sql(f"SELECT draw_id, coalesce(min(idx) FILTER (WHERE c > u), max(idx))::BIGINT AS idx FROM (SELECT s_suppkey::BIGINT AS draw_id, (s_suppkey * 7919 % 100003) / 100003.0 AS u FROM supplier), (SELECT idx, sum({_P}) OVER (ORDER BY idx) AS c FROM STATE) GROUP BY draw_id, u"),
)
add("dense_rows", lambda s, d: M.to_dense(encoded(s, d, "orders"), N + 1).select("idx", r9("real").alias("real"), r9("imag").alias("imag")), f"WITH s0 AS {encoded_sql('orders')} SELECT r.idx::BIGINT AS idx, round(coalesce(real, 0), 9) + 0.0 AS real, round(coalesce(imag, 0), 9) + 0.0 AS imag FROM (SELECT unnest(range({2 << N})) AS idx) r LEFT JOIN s0 USING (idx)")
add(
    "dense_blocks",
    lambda s, d: chunks.from_blocks(chunks.to_blocks(encoded(s, d), N, 16), 16).select("idx", (F.round("real", 5) + 0.0).alias("real"), (F.round("imag", 5) + 0.0).alias("imag")),
    f"WITH s0 AS {encoded_sql()} SELECT idx, round(real::FLOAT::DOUBLE, 5) + 0.0 AS real, round(imag::FLOAT::DOUBLE, 5) + 0.0 AS imag FROM s0 WHERE real::FLOAT <> 0 OR imag::FLOAT <> 0",
)

# --- circuits in tables, logs, versions -------------------------------------


def gate_rows(spark: SparkSession, sf_dir: str, name: str = "orders", key: str = "o_orderkey", other: str = "o_custkey") -> DataFrame:
    """Rows of a table as two-qubit gates on 8 qubits, in key order."""
    a = F.pmod(F.col(other), F.lit(8)).cast("int")
    return table(spark, sf_dir, name).select(F.col(key).cast("long").alias("seq"), F.array(a, F.pmod(a + 1 + F.pmod(F.col(key), F.lit(7)).cast("int"), F.lit(8)).cast("int")).alias("qubits"))


def gate_rows_sql(name: str = "orders", key: str = "o_orderkey", other: str = "o_custkey") -> str:
    return f"(SELECT {key}::BIGINT AS seq, unnest([({other} % 8)::INT, (({other} % 8 + 1 + {key} % 7) % 8)::INT]) AS qubit FROM {name})"


add("dag_edges", lambda s, d: Q.direct_edges(gate_rows(s, d)), f"SELECT * FROM (SELECT lag(seq) OVER (PARTITION BY qubit ORDER BY seq) AS src, seq AS dst, qubit FROM {gate_rows_sql()}) WHERE src IS NOT NULL")
_SUPP = ("supplier", "s_suppkey", "s_nationkey")
add("partition_spread", lambda s, d: M.spread(gate_rows(s, d).withColumn("qubit", F.col("qubits")[0]).groupBy("qubit").agg(F.count("*").alias("rows"))).select("least", "greatest", r9("mean").alias("mean")), "SELECT min(n)::BIGINT AS least, max(n)::BIGINT AS greatest, round(avg(n), 9) + 0.0 AS mean FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey % 8)")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of a table matched to a listing of them in falling order of customers."""
    gates = gate_rows(spark, sf_dir).withColumn("gate", F.lit("CX"))
    listing = table(spark, sf_dir, "orders").select((-F.col("o_orderkey")).alias("order_id"), F.col("o_orderkey").cast("long").alias("seq"), F.pmod("o_custkey", F.lit(9)).alias("part")).join(gates, "seq")
    return Q.match_gates(gates, listing.select("order_id", "gate", "qubits", "part")).groupBy("part").agg(F.count("*").alias("gates"), F.sum("seq").alias("seqs"))


_GATE_LIST = "(SELECT o_orderkey::BIGINT AS seq, [(o_custkey % 8)::INT, ((o_custkey % 8 + 1 + o_orderkey % 7) % 8)::INT] AS q, (o_custkey % 9)::BIGINT AS part FROM orders)"
add("matched_gates", _matched, f"WITH g AS {_GATE_LIST}, a AS (SELECT seq, q, row_number() OVER (PARTITION BY q ORDER BY seq) AS k FROM g), b AS (SELECT part, q, row_number() OVER (PARTITION BY q ORDER BY seq DESC) AS k FROM g) SELECT b.part, count(*)::BIGINT AS gates, sum(a.seq)::BIGINT AS seqs FROM a JOIN b ON a.q = b.q AND a.k = b.k GROUP BY 1")
add("dag_all_edges", lambda s, d: Q.all_edges(gate_rows(s, d, *_SUPP)), f"WITH u AS {gate_rows_sql(*_SUPP)} SELECT DISTINCT a.seq AS src, b.seq AS dst FROM u a JOIN u b ON a.qubit = b.qubit AND a.seq < b.seq")
add("gate_batches", lambda s, d: Q.batch_ids(gate_rows(s, d), 10).groupBy("batch").agg(F.count("*").alias("gates"), F.min("seq").alias("gate_start"), F.max("seq").alias("gate_end")), "SELECT (o_orderkey // 10)::BIGINT AS batch, count(*)::BIGINT AS gates, min(o_orderkey)::BIGINT AS gate_start, max(o_orderkey)::BIGINT AS gate_end FROM orders GROUP BY 1")
add("qubit_frequency", lambda s, d: Q.qubit_frequency(gate_rows(s, d)), f"SELECT qubit, count(*)::BIGINT AS uses FROM {gate_rows_sql()} GROUP BY 1")
add("partition_overlap", lambda s, d: Q.partition_overlap(gate_rows(s, d, *_SUPP).select(F.pmod("seq", F.lit(9)).alias("part"), "qubits")), f"WITH u AS (SELECT DISTINCT seq % 9 AS part, qubit FROM {gate_rows_sql(*_SUPP)}) SELECT a.part AS a, b.part AS b, count(*)::BIGINT AS shared FROM u a JOIN u b ON a.qubit = b.qubit AND a.part <> b.part GROUP BY 1, 2")
add("parts_grouped", lambda s, d: Q.orders_by_part(table(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("order_id"), F.pmod("o_custkey", F.lit(50)).cast("long").alias("part"))).select("part", F.concat_ws(",", "orders").alias("orders")), "SELECT (o_custkey % 50)::BIGINT AS part, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as log records: a run per 20 customers, status by order status."""
    status = F.when(F.col("o_orderstatus") == "F", "COMMITTED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("FAILED")
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).cast("string").alias("run_id"), F.col("o_orderkey").cast("long").alias("step_start"), status.alias("status"), (F.col("o_custkey") % 500).alias("wal_id"))


_LOG = "(SELECT (o_custkey % 20)::VARCHAR AS run_id, o_orderkey::BIGINT AS step_start, CASE o_orderstatus WHEN 'F' THEN 'COMMITTED' WHEN 'O' THEN 'PENDING' ELSE 'FAILED' END AS status, o_custkey % 500 AS wal_id FROM orders)"
add("wal_latest", lambda s, d: Q.latest(log_rows(s, d), ["run_id", "wal_id"], "step_start"), f"SELECT run_id, wal_id, max(step_start) AS step_start, arg_max(status, step_start) AS status FROM {_LOG} GROUP BY 1, 2")


def _points(log: DataFrame) -> DataFrame:
    return log.filter("status = 'COMMITTED'").groupBy("run_id").agg(F.max("step_start").alias("last_step"))


add("wal_pending_after_checkpoint", lambda s, d: Q.pending_after(log_rows(s, d), _points(log_rows(s, d))).select("run_id", "step_start"), f"WITH l AS {_LOG}, c AS (SELECT run_id, max(step_start) AS last_step FROM l WHERE status = 'COMMITTED' GROUP BY 1) SELECT run_id, step_start FROM l LEFT JOIN c USING (run_id) WHERE status = 'PENDING' AND step_start > coalesce(last_step, -1)")
add("resume_point", lambda s, d: _points(log_rows(s, d)).select("run_id", (F.col("last_step") + 1).alias("next_step")), f"SELECT run_id, max(step_start) + 1 AS next_step FROM {_LOG} WHERE status = 'COMMITTED' GROUP BY 1")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state of event values for each event type, as versions."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("version"), F.pmod("user_id", F.lit(32)).alias("idx"), F.col("value").alias("w"))
    return e.groupBy("version", "idx").agg(F.sum("w").alias("w"))


add("state_versions", lambda s, d: _versions(s, d).groupBy("version").agg(F.count("*").alias("amplitudes"), (F.round(F.sum("w"), 4) + 0.0).alias("weight")), "SELECT event_type AS version, count(DISTINCT user_id % 32)::BIGINT AS amplitudes, round(sum(value), 4) + 0.0 AS weight FROM events GROUP BY 1")


# --- stores, logs and recovery, through the classes that durable runs use ----


def _base(spark: SparkSession) -> str:
    """A folder of its own for one query's files."""
    return f"{shared_folder(spark).rstrip('/')}/ketflow-catalog-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, sf_dir: str) -> S.StateStore:
    """Two versions of a state."""
    store = S.StateStore(spark, _base(spark), "catalog")
    store.save(encoded(spark, sf_dir), 0)
    store.save(encoded(spark, sf_dir, "orders"), 1)
    return store


def _through_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored(spark, sf_dir)
    path = f"{store.base}/csv"
    store.export_csv(store.load(1), path)
    return out(store.import_csv(path))


def _versions_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored(spark, sf_dir)
    listed = spark.createDataFrame([(v,) for v in store.versions()], "state_version int")
    sums = store.all_versions().groupBy("state_version").agg(F.count("*").alias("amplitudes"), r9(F.sum(F.col("real") * F.col("real"))).alias("norm"))
    return listed.join(sums, "state_version")


def _through_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks written with a manifest, read back as the manifest says."""
    base = _base(spark)
    chunks.to_blocks(encoded(spark, sf_dir), N, 16).write.parquet(f"{base}/blocks")
    chunks.write_manifest(spark, f"{base}/manifest.json", chunks.manifest(N, 16, [f"blocks/chunk={k}" for k in range((1 << N) // 16)]))
    m = chunks.read_manifest(spark, f"{base}/manifest.json")
    back = chunks.from_blocks(spark.read.parquet(f"{base}/blocks"), m["chunk_size"])
    return back.select("idx", (F.round("real", 5) + 0.0).alias("real"), (F.round("imag", 5) + 0.0).alias("imag"))


def _crashed(spark: SparkSession, sf_dir: str, resumed: bool) -> tuple[Config, DataFrame | None]:
    """A durable run that stops after its second step, and its state if it is resumed."""
    base = _base(spark)
    config = Config(base_path=base, run_id="catalog", fusion=False, local_qubits=3, cut_every=3, crash_after=2, checksums=True)
    try:
        Session(spark, config).run(_MIXED, encoded(spark, sf_dir), durable=True)
    except InjectedCrash:
        pass
    if not resumed:
        return config, None
    again = Config(base_path=base, run_id="catalog", fusion=False, local_qubits=3, cut_every=3, checksums=True)
    return again, Session(spark, again).run(_MIXED, encoded(spark, sf_dir), durable=True).state


def _recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    config, _ = _crashed(spark, sf_dir, False)
    plan = Session(spark, config).plan(_MIXED)
    point = S.recover(spark, config.base_path, "catalog", plan.hash, len(plan.cuts))
    return spark.createDataFrame([(point.version, point.next_step, point.complete)], "version int, next_step int, complete boolean")


_STEPS = len(R.plan(_MIXED, fusion=False, k=3, cut_every=3).cuts)
add("store_parquet", lambda s, d: out(_stored(s, d).load(0)), f"WITH s0 AS {encoded_sql()} {out_sql('s0')}")
add("store_csv", _through_csv, f"WITH s0 AS {encoded_sql('orders')} {out_sql('s0')}")
add("store_versions", _versions_listed, f"WITH a AS {encoded_sql()}, b AS {encoded_sql('orders')} SELECT 0::INT AS state_version, count(*)::BIGINT AS amplitudes, round(sum(real * real), 9) + 0.0 AS norm FROM a UNION ALL SELECT 1::INT, count(*)::BIGINT, round(sum(real * real), 9) + 0.0 FROM b")
add("store_chunks", _through_chunks, ORACLES["dense_blocks"])
add("store_zero_chunks", lambda s, d: out(chunks.from_blocks(chunks.zero_blocks(s, N, 16), 16)), f"WITH s0 AS {ZERO_SQL} {out_sql('s0')}")
add("durable_resumed", lambda s, d: out(_crashed(s, d, True)[1]), circuit_sql(_MIXED, encoded_sql()))
add("durable_log", lambda s, d: S.Log(s, _crashed(s, d, True)[0].base_path).status().select("step_start", "step_end", "status"), f"SELECT i::INT AS step_start, (i + 1)::INT AS step_end, 'COMMITTED' AS status FROM range({_STEPS}) t(i)")
add("durable_pending", lambda s, d: S.Log(s, _crashed(s, d, False)[0].base_path).pending("catalog").select("step_start", "status"), "SELECT 1::INT AS step_start, 'PENDING' AS status")
add("durable_checkpoints", lambda s, d: S.Checkpoints(s, _crashed(s, d, True)[0].base_path).all().select("state_version", "last_step", F.col("checksum").isNotNull().alias("checked")), f"SELECT (i + 1)::INT AS state_version, i::INT AS last_step, true AS checked FROM range({_STEPS}) t(i)")
add("durable_recovered", _recovered, "SELECT 1::INT AS version, 1::INT AS next_step, false AS complete")

add("dense_kernels", lambda s, d: out(D.to_rows(D.run(D.from_rows(encoded(s, d), N, 3), _MIXED))), circuit_sql(_MIXED, encoded_sql()))
add("dense_kernels_unfused", lambda s, d: out(D.to_rows(D.run(D.from_rows(encoded(s, d, "orders"), N, 4), gen.qft(N), 1))), circuit_sql(gen.qft(N), encoded_sql("orders")))

_SQL_LONG = C.of(3, [g for k in range(5) for g in (("H", (k % 3,), {}), ("CX", (k % 3, (k + 1) % 3), {}), ("T", ((k + 2) % 3,), {}), ("RY", ((k + 1) % 3,), {"theta": 0.3 + k}))])
add("sql_path_20", lambda s, d: out(run_sql(s, _SQL_LONG, "state_20").filter(f"version = {len(_SQL_LONG.gates)}").select("idx", "real", "imag")), circuit_sql(_SQL_LONG, ZERO_SQL))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplitude-encode lineitem, then the Fourier transform on six qubits."""
    return out(Session(spark).run(gen.qft(N), encoded(spark, sf_dir)).state)


add("enc_qft", flagship, circuit_sql(gen.qft(N), encoded_sql()))
