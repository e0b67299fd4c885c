import numpy as np
import pytest

from ketflow.operators import encode as E
from ketflow.operators import measure as M
from ketflow.plans import generators as gen
from ketflow.session import Session
from pyspark.sql import functions as F
from tests.oracle import dense, simulate

C = gen.random_circuit(4, 14, 7)


def test_probabilities(spark):
    state, v = Session(spark).run(C).state, simulate(C)
    p = np.abs(v) ** 2
    assert M.is_normalized(state)
    got = {r.outcome: r.probability for r in M.marginal(state, [3, 1]).collect()}
    for o in range(4):
        assert abs(got.get(o, 0) - sum(p[i] for i in range(16) if (i >> 3 & 1) | (i >> 1 & 1) << 1 == o)) < 1e-10
    assert abs(M.qubit_probability(state, 2, 0).first()[0] - sum(p[i] for i in range(16) if not i >> 2 & 1)) < 1e-10


def test_projection_divides_by_the_root(spark):
    state = Session(spark).run(gen.hadamard_wall(3)).state
    assert abs(M.norm(M.project(state, [1], [1], 3)).first()[0] - 1) < 1e-12
    assert sorted(M.project(state, [1], [1], 3).toPandas().idx) == [0, 1, 2, 3]
    assert M.project(state, [0, 1, 2], None, 3).first().idx == 0


def test_sampling(spark):
    state, p = Session(spark).run(C).state, np.abs(simulate(C)) ** 2
    cdf = M.cumulative(state, 4).orderBy("idx").toPandas()
    assert np.allclose(cdf.cumulative, np.cumsum(p[cdf.idx]))
    n = 4000
    got = {r.outcome: r["count"] for r in M.sample(state, n, seed=3).collect()}
    assert sum(got.values()) == n
    assert max(abs(got.get(i, 0) / n - p[i]) for i in range(16)) < 0.04
    assert got == {r.outcome: r["count"] for r in M.sample(state, n, seed=3).collect()}


def test_draw_beyond_the_total_gets_the_last_index(spark):
    state = Session(spark).run(gen.ghz(3)).state
    draws = spark.createDataFrame([(0, 0.0), (1, 0.499), (2, 0.51), (3, 1.5)], "draw_id long, u double")
    assert {r.draw_id: r.idx for r in M.pick(state, draws).collect()} == {0: 0, 1: 0, 2: 7, 3: 7}


def test_comparison(spark):
    a, b = Session(spark).run(gen.ghz(3)).state, Session(spark).run(gen.hadamard_wall(3)).state
    va, vb = simulate(gen.ghz(3)), simulate(gen.hadamard_wall(3))
    assert abs(M.overlap(a, b).first().magnitude - abs(np.vdot(va, vb))) < 1e-12
    assert abs(M.max_diff(a, b).first()[0] - np.abs(va - vb).max()) < 1e-12
    assert M.states_equal(a, a) and not M.states_equal(a, b)
    assert M.sparsity(a, 3).first().nonzero == 2
    assert M.to_dense(a, 3).count() == 8 and M.count_above(b).first()[0] == 8
    assert M.allocate(a, 3)[1] == 4


def test_encodings_skip_nulls(spark):
    df = spark.createDataFrame([(1, 3.0), (5, 1.0), (1, 1.0), (None, 2.0), (2, None), (3, 0.0)], "k long, w double")
    v = dense(E.amplitude_encode(df, F.col("k"), 2, F.col("w")), 2)
    assert np.allclose(v, [0, 1, 0, 0])
    assert np.allclose(dense(E.basis_encode(df, F.col("k"), 3), 3)[[1, 2, 3, 5]], 0.5)
    assert E.amplitude_encode(df.limit(0), F.col("k"), 2, F.col("w")).count() == 0


def test_reset_of_an_entangled_qubit_follows_the_draw(spark):
    bell = Session(spark).run(gen.ghz(2)).state
    assert np.allclose(dense(M.reset(bell, 0, 0.3), 2), [1, 0, 0, 0])
    assert np.allclose(dense(M.reset(bell, 0, 0.7), 2), [0, 0, 1, 0])
    assert [M.collapse(bell, 1, u)[1] for u in (0.0, 0.49, 0.51, 0.99)] == [0, 0, 1, 1]


def test_collapse_without_weight(spark):
    with pytest.raises(ValueError, match="weight"):
        M.collapse(Session(spark).run(gen.ghz(2)).state.limit(0), 0, 0.5)


def test_merge_and_workers(spark):
    a, b = Session(spark).run(gen.ghz(3)).state, Session(spark).run(gen.hadamard_wall(3)).state
    assert np.allclose(dense(M.merge([a, b, b]), 3), simulate(gen.ghz(3)) + 2 * simulate(gen.hadamard_wall(3)))
    assert sum(r.rows for r in M.rows_per_worker(b).collect()) == 8
    assert M.spread(spark.createDataFrame([(1,), (5,)], "rows long")).first() == (1, 5, 3.0)
