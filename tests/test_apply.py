import numpy as np
import pytest

from ketflow.functions import gates as G
from ketflow.operators import apply as A
from ketflow.operators import measure as M
from ketflow.plans import circuit as C
from ketflow.plans import generators as gen
from ketflow.plans import rewrite as R
from ketflow.session import Config, Session, run_sql
from tests.oracle import dense, simulate


@pytest.mark.parametrize("make", [lambda: gen.ghz(5), lambda: gen.qft(4), lambda: gen.qpe(3), lambda: gen.w(5), lambda: gen.cluster(4, True), lambda: gen.deutsch_jozsa(5)])
def test_generated_circuits(spark, make):
    c = make()
    assert np.abs(dense(Session(spark).run(c).state, c.n) - simulate(c)).max() < 1e-10


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("knobs", [{}, {"fusion": False}, {"local_qubits": 3, "cut_every": 2}, {"fusion": False, "staging": False}])
def test_random_circuits_under_all_plans(spark, seed, knobs):
    c = gen.random_circuit(5, 12, seed + 100)
    got = dense(Session(spark, Config(**knobs)).run(c).state, 5)
    assert np.abs(got - simulate(c)).max() < 1e-10 and abs(np.linalg.norm(got) - 1) < 1e-10


def test_wide_sparse_state(spark):
    got = Session(spark).run(gen.ghz(62)).to_dict()
    assert set(got) == {0, 2**62 - 1} and all(abs(a - 2**-0.5) < 1e-12 for a in got.values())


def test_endianness_and_interference(spark):
    assert Session(spark).run(gen.x_on_first()).to_dict() == {1: 1}
    assert set(Session(spark, Config(fusion=False)).run(C.of(1, [("H", (0,), {}), ("H", (0,), {})])).to_dict()) == {0}


def test_forms_agree(spark):
    state = Session(spark).run(gen.load("ry", 4)).state
    for name, params, q in (("RY", {"theta": 0.7}, (2,)), ("SWAP", {}, (0, 3)), ("CCX", {}, (3, 0, 1)), ("CU3", {"theta": 0.3, "phi": 1, "lam": 2}, (1, 2))):
        m = spark.createDataFrame(G.rows_of(name, params), "row int, col int, real double, imag double")
        a = A.apply_gate(state, C.of(4, [(name, q, params)]).gates[0])
        assert M.states_equal(a, A.apply_matrix_join(state, m, q))
        assert M.states_equal(a, A.apply_op(state, R.Op((), q, G.matrix(name, params))))
    versions = run_sql(spark, gen.qft(3))
    assert np.abs(dense(versions.filter("version = 6").select("idx", "real", "imag"), 3) - simulate(gen.qft(3))).max() < 1e-12
    assert versions.filter("version = 0").count() == 1


def test_matrix_relation_keeps_parameters_apart(spark):
    c = C.of(2, [("RY", (0,), {"theta": 0.3}), ("RY", (1,), {"theta": 1.1}), ("RY", (0,), {"theta": 0.3})])
    m = A.matrix_relation(spark, c.gates).cache()
    assert m.select("gate_name").distinct().count() == 2
    state = A.initial_state(spark)
    for g in c.gates:
        state = A.apply_matrix_join(state, m.filter(m.gate_name == A.matrix_key(g)), g.qubits)
    assert np.abs(dense(state, 2) - simulate(c)).max() < 1e-12


def test_controlled_general_gate_keeps_other_rows(spark):
    c = C.of(3, [("H", (0,), {}), ("H", (1,), {}), ("CU", (0, 2), {"U": G.matrix("RY", {"theta": 0.9}), "exponent": 3})])
    assert np.abs(dense(Session(spark, Config(fusion=False)).run(c).state, 3) - simulate(c)).max() < 1e-12


def exchanges(df) -> int:
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("Exchange hashpartitioning")


def test_shuffles_of_the_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        start = A.initial_state(spark)
        ops = lambda *g: tuple(R.lower(x) for x in C.of(6, g).gates)
        local = frozenset(range(3))
        diagonal = R.Stage(local, ops(("T", (5,), {}), ("CZ", (0, 5), {}), ("X", (1,), {}), ("CX", (5, 2), {})))
        assert exchanges(A.run_stages(start, [diagonal])) == 0
        general = R.Stage(local, ops(("H", (0,), {}), ("H", (1,), {}), ("T", (5,), {}), ("RY", (2,), {"theta": 0.2}), ("CX", (4, 1), {})))
        assert exchanges(A.run_stages(start, [general])) == 1  # one for three general gates
        assert exchanges(A.apply_gates(start, C.of(3, [("H", (0,), {})]).gates)) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_permutation_of_bits(spark):
    state = Session(spark).run(gen.load("g", 4)).state
    perm = [2, 0, 3, 1]
    want = np.zeros(16, complex)
    v = dense(state, 4)
    for i in range(16):
        want[sum((i >> perm[q] & 1) << q for q in range(4))] = v[i]
    assert np.allclose(dense(A.permute_state(state, perm), 4), want)


def test_circuit_relation(spark):
    c = gen.w(4)
    back = C.from_frame(C.to_frame(spark, c), 4)
    assert np.allclose(simulate(back), simulate(c)) and len(back.gates) == len(c.gates)


def test_filters_do_not_blow_up_long_chains_of_projections(spark):
    c = gen.adder(3, 5, 6)
    c = C.of(c.n, [(g.name, g.qubits, g.params) for g in c.gates] + [("CY", (0, 1), {}), ("CZ", (0, 1), {})] * 6)
    got = A.prune(A.apply_gates(A.initial_state(spark), c.gates))
    staged = A.prune(Session(spark).run(c).state)
    want = simulate(c)
    assert np.abs(dense(got, c.n) - want).max() < 1e-12 and np.abs(dense(staged, c.n) - want).max() < 1e-12
