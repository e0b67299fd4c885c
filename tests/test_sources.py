import math

import numpy as np
import pytest

from ketflow.operators import measure as M
from ketflow.plans import circuit as C
from ketflow.plans.circuit import CircuitError
from ketflow.plans import generators as gen
from ketflow.session import Config, InjectedCrash, Session
from ketflow.sources import chunks, qasm
from ketflow.sources import store as S
from tests.oracle import dense, simulate

CIRCUIT = gen.random_circuit(4, 12, 21)


def config(path, **more):
    return Config(base_path=f"file://{path}", run_id="r", fusion=False, cut_every=1, **more)


def test_durable_run_and_resume_after_a_crash(spark, tmp_path):
    with pytest.raises(InjectedCrash):
        Session(spark, config(tmp_path, crash_after=3)).run(CIRCUIT, durable=True)
    log = S.Log(spark, f"file://{tmp_path}")
    assert log.pending("r").count() == 1
    again = Session(spark, config(tmp_path, checksums=True)).run(CIRCUIT, durable=True)
    assert again.resumed_from == 2 and np.abs(dense(again.state, 4) - simulate(CIRCUIT)).max() < 1e-10
    assert {r.status for r in log.records().filter("wal_id = 2").collect()} == {"PENDING", "FAILED", "COMMITTED"}
    done = Session(spark, config(tmp_path)).run(CIRCUIT, durable=True)
    assert done.resumed_from == done.steps and np.abs(dense(done.state, 4) - simulate(CIRCUIT)).max() < 1e-10
    assert log.last_committed("r").step_end == done.steps
    store = S.StateStore(spark, f"file://{tmp_path}", "r")
    assert store.versions() == [done.version - 2, done.version - 1, done.version]
    points = S.Checkpoints(spark, f"file://{tmp_path}")
    assert points.verify(points.last("r"))
    assert S.cleanup(store, {done.version}) == [done.version - 2, done.version - 1]


def test_another_plan_under_the_same_run_is_refused(spark, tmp_path):
    Session(spark, config(tmp_path)).run(gen.ghz(2), durable=True)
    with pytest.raises(ValueError, match="another plan"):
        Session(spark, config(tmp_path)).run(gen.ghz(3), durable=True)


def test_fence(spark, tmp_path):
    a = S.Fence(spark, f"file://{tmp_path}", "x")
    a.acquire()
    with pytest.raises(RuntimeError):
        S.Fence(spark, f"file://{tmp_path}", "x").acquire()
    S.Fence(spark, f"file://{tmp_path}", "x").acquire(force=True)
    S.Fence(spark, f"file://{tmp_path}", "x", stale_s=0).acquire()


def test_versions_csv_and_checksum(spark, tmp_path):
    store = S.StateStore(spark, f"file://{tmp_path}", "v")
    a, b = Session(spark).run(gen.ghz(3)).state, Session(spark).run(gen.w(3)).state
    store.save(a, 0)
    store.save(b, 1)
    assert store.versions() == [0, 1] and M.states_equal(store.load(1), b)
    assert store.all_versions().filter("state_version = 1").count() == 3
    path = f"file://{tmp_path}/out.csv"
    assert store.export_csv(b, path) == S.checksum(store.import_csv(path))
    assert S.checksum(a) != S.checksum(b) and S.checksum(b) == S.checksum(b.repartition(3))


def test_checkpoint_policy():
    p = S.Policy(every_versions=5, every_steps=10, every_seconds=60)
    assert p.due(1, 1, 0) and p.due(10, 1, 0) and p.due(3, 10, 0) and p.due(3, 1, 61) and not p.due(3, 1, 1)


def test_chunks(spark, tmp_path):
    state, v = Session(spark).run(CIRCUIT).state, simulate(CIRCUIT)
    blocks = chunks.to_blocks(state, 4, 4)
    assert blocks.count() == 4
    assert np.abs(dense(chunks.from_blocks(blocks, 4), 4) - v).max() < 1e-6
    assert chunks.from_blocks(chunks.zero_blocks(spark, 5, 8), 8).collect()[0].idx == 0
    for k in range(4):
        v[4 * k : 4 * k + 4].astype("<c8").tofile(tmp_path / f"chunk_{k}.bin")
    assert np.abs(dense(chunks.read_raw(spark, f"file://{tmp_path}", 4), 4) - v).max() < 1e-6
    m = chunks.manifest(4, 4, [f"chunk_{k}.bin" for k in range(4)])
    chunks.write_manifest(spark, f"file://{tmp_path}/m.json", m)
    assert chunks.read_manifest(spark, f"file://{tmp_path}/m.json") == m
    for bad in ({"n_chunks": 3}, {"dtype": "complex128"}, {"chunks": []}):
        with pytest.raises(ValueError):
            chunks.check_manifest(m | bad)


TEXT = """OPENQASM 2.0; // comment
include "qelib1.inc";
gate half(t) a, b { cx a, b; u1(3*t/4) b; }
qreg q[2]; qreg r[2]; creg c[2];
h q; half(pi/2) q, r; u3(0.3, -pi, 2e-1*pi) r[0]; barrier q; measure q -> c;
"""


def test_qasm(spark):
    p = qasm.read(TEXT)
    assert [g.name for g in p.circuit.gates] == ["H", "H", "CX", "U1", "CX", "U1", "U3"]
    assert p.circuit.gates[3].params == {"lam": pytest.approx(3 * np.pi / 8)} and p.circuit.gates[4].qubits == (1, 3)
    assert p.measures == [(0, "c", 0), (1, "c", 1)]
    for c in (gen.qft(4), gen.load("g", 3), gen.random_circuit(4, 10, 3)):
        if all(g.name != "CU" for g in c.gates):
            assert np.allclose(simulate(qasm.read(qasm.write(c)).circuit), simulate(c))
    for bad in ("qreg q[1]; nope q[0];", "qreg q[1]; x q[1];", "qreg q[1]; rx q[0];", "qreg q[1]; rx(import) q[0];", "x q;", "qreg q[2]; creg c[1]; if(c==1) x q[0];"):
        with pytest.raises(C.CircuitError):
            qasm.read(bad)


def test_other_texts():
    c = C.of(3, [("H", (0,), {}), ("RX", (1,), {"theta": 0.5}), ("CX", (0, 1), {}), ("T", (2,), {}), ("CR", (0, 2), {"k": 2})])
    text = qasm.write_calls(c)
    assert "psi.ApplyHadamard(0);" in text and "psi.ApplyRotationX(1,0.5);" in text and "psi.ApplyControlled1QubitGate(0,2,G4);" in text
    assert len(qasm.listing(c).splitlines()) == 6
    with pytest.raises(C.CircuitError):
        qasm.write_calls(C.of(3, [("RXX", (0, 1), {"theta": 1})]))


def test_parts_and_dot(spark, tmp_path):
    c = gen.qft(3)
    part = C.partition(c, 2)
    (tmp_path / "parts.txt").write_text("".join(f"{a} {b} {k}\n" for a, b, k in qasm.parts_rows(c, part)))
    assert [r.part for r in qasm.read_parts(spark, f"file://{tmp_path}/parts.txt").orderBy("order_id").collect()] == part
    assert qasm.write_parts(c, part).count("// part") >= 2
    assert qasm.dot(c).count("->") == sum(len(g.qubits) for g in c.gates) + 3
    assert len(qasm.from_calls(2, [("h", [], [0]), ("barrier", [], [0, 1]), ("cx", [], [0, 1]), ("cp", [0.3], [0, 1])]).gates) == 3


def test_measured_programs_follow_their_registers(spark):
    text = "qreg q[3]; creg a[1]; creg b[1]; ry(0.8) q[0]; h q[1]; cx q[1],q[2]; cx q[0],q[1]; h q[0]; measure q[0] -> a[0]; measure q[1] -> b[0]; if(b==1) x q[2]; if(a==1) z q[2];"
    program = qasm.read(text, classical=True)
    seen = set()
    for seed in range(4):
        done, bits = Session(spark).run_program(program, seed)
        at = bits["a"] | bits["b"] << 1
        got = {r.idx: complex(r.real, r.imag) for r in done.state.collect() if abs(r.real) > 1e-12}
        assert set(got) == {at, at | 4}
        assert abs(got[at] - math.cos(0.4)) < 1e-12 and abs(got[at | 4] - math.sin(0.4)) < 1e-12
        seen.add(at)
    assert len(seen) > 1
    again = qasm.read("qreg q[1]; creg c[2]; x q[0]; measure q[0] -> c[1]; if(c==2) reset q[0]; if(c==1) x q[0];", classical=True)
    done, bits = Session(spark).run_program(again)
    assert bits == {"c": 2} and done.to_dict() == {0: 1}
    assert again.circuit.gates[0].name == "X" and len(again.circuit.gates) == 1
    for bad in ("qreg q[1]; creg c[1]; if(c==1) x q[0];", "qreg q[1]; measure q[0] -> c[0];"):
        with pytest.raises(CircuitError):
            qasm.read(bad)
    with pytest.raises(CircuitError):
        qasm.read("qreg q[1]; if(d==1) x q[0];", classical=True)
