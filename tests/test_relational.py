import random

import pytest

from ketflow.operators import relational as Q


@pytest.mark.parametrize("block", [2048, 3])
def test_all_edges_equal_brute_force(spark, block):
    r = random.Random(5)
    data = [(r.choice([k, k // 2]), r.choice([[a := r.randrange(9), r.randrange(9)], [a, a], [a], [a, None], [], None])) for k in range(-40, 60)] + [(None, [1, 2])]
    rows = [(s, q) for s, qs in data for q in qs or [] if s is not None and q is not None]
    want = {(s, t) for s, q in rows for t, p in rows if q == p and s < t}
    got = [tuple(x) for x in Q.all_edges(spark.createDataFrame(data, "seq bigint, qubits array<int>"), block).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert Q.all_edges(spark.createDataFrame([], "seq bigint, qubits array<int>")).count() == 0


def test_all_edges_shuffle_no_pairs(spark):
    gates = spark.range(600).selectExpr("id AS seq", "array(int(id % 3), int(id % 3 + 1)) AS qubits")
    found = Q.all_edges(gates)
    plan = found._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("Exchange")]  # what follows the last exchange
    assert top.count("Generate explode") == 2 and "HashAggregate" not in top
    assert found.count() == sum(1 for a in range(600) for b in range(a) if abs(a % 3 - b % 3) < 2)
