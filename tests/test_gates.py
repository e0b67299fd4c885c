import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from ketflow.functions import gates as G

PARAMS = {"theta": 0.7, "phi": 0.4, "lam": 1.1, "k": 3, "p": 3, "num": 3, "pow": 2}


@pytest.mark.parametrize("name", sorted(G.SPECS))
def test_all_gates_are_unitary(name):
    assert G.is_unitary(G.matrix(name, PARAMS))


def test_values_and_identities():
    m = G.matrix
    assert np.allclose(m("T") @ m("T"), m("S"))
    assert np.allclose(m("SX") @ m("SX"), m("X"))
    assert np.allclose(m("S") @ m("SDG"), np.eye(2))
    assert np.allclose(m("R", {"k": 2}), m("S"))
    assert np.allclose(m("RXX", {"theta": math.pi}), -1j * np.kron(m("X"), m("X")))
    assert np.allclose(m("G", {"p": 2}), m("RY", {"theta": math.pi / 2}))
    assert np.allclose(m("U3", {"theta": 0.3, "phi": 0.0, "lam": 0.0}), m("RY", {"theta": 0.3}))
    assert m("CNOT")[3, 1] == 1 and m("CNOT")[1, 3] == 1  # control is qubit 0
    assert np.allclose(m("CU", {"U": m("T"), "exponent": 2}), m("CR", {"k": 2}))


def test_classes():
    kinds = {n: G.class_of(G.matrix(n, PARAMS)) for n in ("H", "X", "Y", "Z", "T", "CX", "CZ", "SWAP", "RZZ", "CCX", "RY")}
    assert kinds == {"H": "G", "X": "P", "Y": "P", "Z": "D", "T": "D", "CX": "P", "CZ": "D", "SWAP": "P", "RZZ": "D", "CCX": "P", "RY": "G"}


def test_same_name_other_parameters_are_other_matrices():
    assert not np.allclose(G.matrix("RY", {"theta": 0.3}), G.matrix("RY", {"theta": 1.1}))


@given(st.floats(-6, 6), st.floats(-6, 6))
def test_rotations_add(a, b):
    for name in ("RX", "RY", "RZ"):
        assert np.allclose(G.matrix(name, {"theta": a}) @ G.matrix(name, {"theta": b}), G.matrix(name, {"theta": a + b}))


def test_relative_phase_toffolis_permute_like_toffolis():
    assert np.allclose(np.abs(G.matrix("RCCX")), np.abs(G.matrix("CCX")))
    assert np.allclose(np.abs(G.matrix("RC3X")), np.abs(G.matrix("C3X")))


#: Literal matrices of the gates without parameters and of some with (theta = 0.7, phi = 0.4, lam = 1.1).
_R = 2**-0.5
LITERAL = {
    "I": [[1, 0], [0, 1]],
    "X": [[0, 1], [1, 0]],
    "Y": [[0, -1j], [1j, 0]],
    "Z": [[1, 0], [0, -1]],
    "H": [[_R, _R], [_R, -_R]],
    "S": [[1, 0], [0, 1j]],
    "SDG": [[1, 0], [0, -1j]],
    "T": [[1, 0], [0, _R + _R * 1j]],
    "TDG": [[1, 0], [0, _R - _R * 1j]],
    "SX": [[0.5 + 0.5j, 0.5 - 0.5j], [0.5 - 0.5j, 0.5 + 0.5j]],
    "RX": [[0.9393727128473789, -0.34289780745545134j], [-0.34289780745545134j, 0.9393727128473789]],
    "RY": [[0.9393727128473789, -0.34289780745545134], [0.34289780745545134, 0.9393727128473789]],
    "RZ": [[0.9393727128473789 - 0.34289780745545134j, 0], [0, 0.9393727128473789 + 0.34289780745545134j]],
    "U1": [[1, 0], [0, 0.4535961214255773 + 0.8912073600614354j]],
    "R1": [[1, 0], [0, 0.7648421872844885 + 0.644217687237691j]],
    "R": [[1, 0], [0, _R + _R * 1j]],
    "U2": [[_R, -_R * (0.4535961214255773 + 0.8912073600614354j)], [_R * (0.9210609940028851 + 0.3894183423086505j), _R * (0.0707372016677029 + 0.9974949866040544j)]],
    "SWAP": [[1, 0, 0, 0], [0, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 1]],
}


@pytest.mark.parametrize("name", sorted(LITERAL))
def test_literal_matrices(name):
    assert np.allclose(G.matrix(name, PARAMS), LITERAL[name], atol=1e-12)


@pytest.mark.parametrize("name", [n for n, s in G.SPECS.items() if s.controls])
def test_controlled_gates_by_index(name):
    """The lowest bits are the controls; where all are 1 the rest is moved by the literal matrix, else nothing is."""
    k = G.SPECS[name].controls
    base = {"CU1": "U1", "CU3": "U3", "CR": "R", "CSWAP": "SWAP", "C3SQRTX": "SX"}.get(name, name.lstrip("C0123456789"))
    u = np.array(LITERAL[base] if base in LITERAL else G.matrix(base, PARAMS))
    m = G.matrix(name, PARAMS)
    for r in range(len(m)):
        for c in range(len(m)):
            on = (1 << k) - 1
            want = (u[r >> k, c >> k] if r & on == on else float(r == c)) if r & on == c & on else 0
            assert abs(m[r, c] - want) < 1e-12
