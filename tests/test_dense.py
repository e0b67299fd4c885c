import numpy as np
import pytest

from ketflow.operators import dense as D
from ketflow.plans import circuit as C
from ketflow.plans import generators as gen
from ketflow.plans import rewrite as R
from ketflow.session import Config, Session, cut_lineage
from tests.oracle import dense, simulate


@pytest.mark.parametrize("n,k,depth", [(3, 3, 30), (6, 3, 40), (7, 4, 60)])
def test_random_circuits(spark, n, k, depth):
    c = gen.random_circuit(n, depth, n + k)
    got = D.run(D.zero(spark, n, k), c, cut=cut_lineage)
    assert np.allclose(dense(D.to_rows(got), n), simulate(c))
    assert abs(D.norm(got).first()[0] - 1) < 1e-12


def test_controls_and_diagonals_outside_the_block(spark):
    c = C.of(6, [("H", (q,), {}) for q in range(6)] + [("CR", (5, 0), {"k": 3}), ("CX", (5, 1), {}), ("CZ", (4, 5), {}), ("T", (5,), {}), ("CCX", (4, 5, 0), {}), ("RZZ", (1, 5), {"theta": 0.7}), ("SWAP", (0, 5), {}), ("CU3", (5, 2), {"theta": 0.4, "phi": 0.1, "lam": -0.9})])
    got = D.run(D.zero(spark, 6, 3), c, width=1)
    assert np.allclose(dense(D.to_rows(got), 6), simulate(c))


def test_rows_there_and_back(spark):
    v = np.random.default_rng(1).normal(size=32) + 1j
    rows = spark.createDataFrame([(i, float(z.real), float(z.imag)) for i, z in enumerate(v)], "idx long, real double, imag double")
    state = D.from_rows(rows, 5, 2)
    assert np.allclose(dense(D.to_rows(state), 5), v)
    assert np.allclose(dense(D.to_rows(D.exchange(state, frozenset({1, 4}))), 5), v)
    assert D.to_rows(D.from_rows(rows.limit(0), 5, 2)).count() == 0
    with pytest.raises(ValueError, match="local"):
        D.exchange(state, frozenset({0, 1, 2}))
    with pytest.raises(ValueError, match="not local"):
        D.run_stage(state, R.Stage(frozenset({4}), (R.lower(C.of(5, [("H", (4,), {})]).gates[0]),)))


def test_zero_blocks_have_no_row(spark):
    got = D.run(D.zero(spark, 10, 4), gen.ghz(10))
    assert got.blocks.count() <= 2
    assert np.allclose(dense(D.to_rows(got), 10), simulate(gen.ghz(10)))


def test_single_precision_and_session(spark):
    c = gen.qft(7)
    got = D.run(D.zero(spark, 7, 4, "<c8"), c)
    assert np.allclose(dense(D.to_rows(got), 7), simulate(c), atol=1e-6)
    assert np.allclose(dense(Session(spark, Config(local_qubits=4)).run_dense(c).state, 7), simulate(c))
