import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ketflow.functions import gates as G
from ketflow.plans import circuit as C
from ketflow.plans import generators as gen
from ketflow.plans import rewrite as R
from tests.oracle import simulate


def doc(*gates, n=3):
    return {"number_of_qubits": n, "gates": [{"qubits": q, "gate": g, "params": p} for g, q, p in gates]}


@pytest.mark.parametrize(
    "bad",
    [
        {"gates": []},
        {"number_of_qubits": 2, "gates": [], "more": 1},
        {"number_of_qubits": 0, "gates": []},
        {"number_of_qubits": 63, "gates": []},
        doc(("NOPE", [0], {})),
        doc(("H", [0, 1], {})),
        doc(("H", [3], {})),
        doc(("RY", [0], {})),
        doc(("RY", [0], {"theta": "x"})),
        doc(("CX", [1, 1], {})),
        doc(("CU", [0, 1], {"U": [[1, 1], [0, 1]]})),
        {"number_of_qubits": 2, "gates": [{"qubits": [0], "gate": "H", "extra": 1}]},
    ],
)
def test_broken_documents_are_refused(bad):
    with pytest.raises(C.CircuitError):
        C.parse(bad)


def test_encoded_names_and_explicit_parameters():
    c = C.parse(doc(("CR3", [0, 1], {}), ("CR3", [0, 1], {"k": 5}), ("R2", [0], {})))
    assert [g.params["k"] for g in c.gates] == [3, 5, 2]


def test_round_trip_of_the_document():
    for c in (gen.qft(4), gen.qpe(3), gen.w(4)):
        assert C.parse(c.document()).hash() == c.hash()


def test_layers_and_dependencies():
    c = C.parse(doc(("H", [0], {}), ("H", [1], {}), ("CX", [0, 1], {}), ("H", [2], {}), ("CX", [1, 2], {})))
    assert [[g.seq for g in layer] for layer in C.levelize(c)] == [[0, 1, 3], [2], [4]]
    dag = C.Dag.build(c)
    assert dag.before[4] == {2, 3} and dag.after(0) == {2} and dag.all_before(4) == {0, 1, 2, 3}
    assert [g.seq for g in dag.ready({0, 1})] == [2, 3]
    assert dag.is_acyclic_partition([0, 0, 0, 1, 1])
    assert not C.Dag.build(C.parse(doc(("H", [0], {}), ("H", [0], {}), ("H", [0], {})))).is_acyclic_partition([0, 1, 0])
    assert C.independent(c.gates[:2]) and not C.independent(c.gates[:3])
    assert [len(r) for r in C.independent_runs(c.gates)] == [2, 2, 1]


def test_batches_and_partitions():
    c = gen.qft(5)
    b = C.batches(c, 4, 3)
    assert (b[0].start, b[-1].end) == (3, 15) and sum(len(x.gates) for x in b) == 12
    for s in C.STRATEGIES:
        part = C.partition(c, 3, s)
        assert len(part) == 15 and set(part) <= {0, 1, 2}
        stats = C.partition_stats(c, part)
        assert sum(stats["sizes"]) == 15
        assert sum(len(d["gates"]) for d in C.sub_circuits(c, part)) == 15
    sub = C.sub_circuits(C.of(2, [("RY", (0,), {"theta": 0.3})]), [0])
    assert sub[0]["gates"][0]["params"] == {"theta": 0.3}
    assert C.qubit_frequency(c.gates, 5)[0] == (0, 5)


def test_generators():
    assert np.allclose(np.abs(simulate(gen.w(5)))[[1, 2, 4, 8, 16]], 1 / np.sqrt(5))
    assert np.allclose(simulate(gen.ghz(4))[[0, 15]], 1 / np.sqrt(2))
    assert np.allclose(simulate(gen.qft(4)), 0.25)
    assert len(gen.ghz_alternating(4, 10).gates) == 10
    assert abs(simulate(gen.grover(3, 5, 2))[5]) ** 2 > 0.9 and abs(simulate(gen.grover(4, 9, 3))[9]) ** 2 > 0.9
    assert np.isclose(np.linalg.norm(simulate(gen.qaoa_ring(4, [(0.3, 0.2), (0.1, 0.5)]))), 1)
    for a in range(4):
        for b in range(4):
            at = int(np.argmax(np.abs(simulate(gen.adder(2, a, b)))))
            assert sum((at >> 1 + 2 * i & 1) << i for i in range(2)) + 4 * (at >> 5 & 1) == a + b
    v = np.abs(simulate(gen.bernstein_vazirani("1011"))) ** 2
    assert np.isclose(v[0b1011] + v[0b11011], 1)


def run_ops(ops, n):
    v = np.zeros(1 << n, complex)
    v[0] = 1
    for op in ops:
        v = G.embed(op.u, op.targets, op.controls, n) @ v
    return v


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 4), st.integers(2, 5))
def test_rewrites_keep_the_state(seed, width, k):
    c = gen.random_circuit(5, 16, seed)
    ops = [R.lower(g) for g in c.gates]
    want = simulate(c)
    fused = R.fuse(ops, width)
    assert np.allclose(run_ops(fused, 5), want)
    staged = R.stages(fused, 5, max(k, max((len(o.moving) for o in fused), default=0)))
    assert np.allclose(run_ops([o for s in staged for o in s.ops], 5), want)
    for s in staged:
        assert all(o.moving <= s.local for o in s.ops)
    plan = R.plan(c, width=width, cut_every=2)
    assert np.allclose(run_ops([o for cut in plan.cuts for s in cut.stages for o in s.ops], 5), want)


def test_order_is_kept_between_global_phases_and_local_gates():
    c = C.parse(doc(("H", [2], {}), ("H", [1], {}), ("X", [1], {}), ("H", [1], {}), ("H", [0], {}), ("CZ", [0, 2], {}), ("H", [0], {}), ("CX", [0, 1], {})))
    staged = R.stages([R.lower(g) for g in c.gates], 3, 2)
    assert np.allclose(run_ops([o for s in staged for o in s.ops], 3), simulate(c))


def test_diagonal_gates_need_no_local_qubit():
    c = C.of(6, [("CZ", (0, 5), {}), ("T", (4,), {}), ("R", (3,), {"k": 3}), ("RZZ", (1, 2), {"theta": 0.3})])
    assert R.staging_stats(c, 1)["stages"] == 1


def test_too_few_local_qubits_are_refused():
    with pytest.raises(C.CircuitError):
        R.stages([R.lower(C.of(2, [("SWAP", (0, 1), {})]).gates[0])], 2, 1)


def test_wall_of_hadamards_is_fused_in_capped_blocks():
    stats = R.fusion_stats(gen.hadamard_wall(12))
    assert stats["operators"] == 4 and R.plan(gen.hadamard_wall(12)).general == 4


def test_plan_hash_covers_the_options():
    c = gen.qft(4)
    assert len({R.plan(c).hash, R.plan(c, fusion=False).hash, R.plan(c, k=3).hash, R.plan(gen.qft(5)).hash}) == 4


def test_stages_tell_their_bits_and_what_crosses():
    todo = R.stages([R.lower(g) for g in gen.hadamard_wall(6).gates], 6, 3)
    assert all(sorted(R.layout(st, 6)) == list(range(6)) and set(R.layout(st, 6)[:3]) == st.local for st in todo)
    assert all(len(come) == len(go) and come.isdisjoint(go) for come, go in R.crossings(todo)) and len(R.crossings(todo)) == len(todo) - 1


def test_partitions_follow_the_rows_moved():
    c = C.of(4, [("H", (0,), {}), ("T", (0,), {}), ("CX", (0, 1), {}), ("H", (2,), {}), ("RXX", (1, 2), {"theta": 0.1}), ("X", (3,), {})])
    assert [C.rows_moved(g) for g in c.gates] == [4, 1, 1, 4, 8, 1]
    assert [C.moving_qubits(g) for g in c.gates] == [{0}, set(), {1}, {2}, {1, 2}, {3}]
    seq = C.partition(c, 2, "sequence")
    assert seq == sorted(seq) and C.Dag.build(c).is_acyclic_partition(seq)
    loads = C.partition_stats(c, C.partition(c, 2, "rows"))["rows_moved"]
    assert sorted(loads) == [9, 10]
    two = C.of(4, [("H", (0,), {}), ("H", (2,), {}), ("CX", (0, 1), {}), ("CX", (2, 3), {})])
    part = C.partition(two, 2, "qubits")
    assert part[0] == part[2] and part[1] == part[3] and part[0] != part[1]


@pytest.mark.parametrize("seed", range(6))
def test_fewest_stages(seed):
    c = gen.random_circuit(5, 16, seed)
    ops = [R.lower(g) for g in c.gates]
    k = max(2, max(len(op.moving) for op in ops))
    plan = R.fewest_stages(ops, 5, k)
    assert len(plan) <= len(R.stages(ops, 5, k))
    assert sorted(s for st in plan for op in st.ops for s in op.seqs) == list(range(len(ops)))
    assert all(op.moving <= st.local and len(st.local) <= k for st in plan for op in st.ops)
    ran = C.Circuit(5, tuple(c.gates[s] for st in plan for op in st.ops for s in op.seqs))
    assert np.allclose(simulate(ran), simulate(c))


def test_fewest_stages_has_an_end():
    ops = [R.lower(g) for g in gen.random_circuit(10, 200, 1).gates]
    with pytest.raises(C.CircuitError, match="fewest"):
        R.fewest_stages(ops, 10, 4, most=50)
