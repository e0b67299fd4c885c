"""The gate library: matrices, controls and the physical class of an operator.

Sub-index convention: ``qubits[0]`` of a gate is bit 0 of a row or column of its matrix,
so an operator on qubits (q0, q1) maps column b0 | b1 << 1.  Controlled gates are kept as
a base matrix plus control qubits; ``dense`` expands them.
"""

from __future__ import annotations

import cmath
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Entries at most this large count as zero.
ZERO = 1e-15
_R2 = 1 / math.sqrt(2)


def _m(*rows) -> np.ndarray:
    return np.array(rows, dtype=complex)


def _phase(theta: float) -> np.ndarray:
    return np.diag([1, cmath.exp(1j * theta)])


def _rx(t: float) -> np.ndarray:
    c, s = math.cos(t / 2), math.sin(t / 2)
    return _m([c, -1j * s], [-1j * s, c])


def _ry(t: float) -> np.ndarray:
    c, s = math.cos(t / 2), math.sin(t / 2)
    return _m([c, -s], [s, c])


def _rz(t: float) -> np.ndarray:
    return np.diag([cmath.exp(-0.5j * t), cmath.exp(0.5j * t)])


def _u3(theta: float, phi: float, lam: float) -> np.ndarray:
    c, s = math.cos(theta / 2), math.sin(theta / 2)
    return _m([c, -cmath.exp(1j * lam) * s], [cmath.exp(1j * phi) * s, cmath.exp(1j * (phi + lam)) * c])


def _g(p: float) -> np.ndarray:
    if p < 1:
        raise ValueError("G needs p >= 1")
    a, b = math.sqrt(1 / p), math.sqrt(1 - 1 / p)
    return _m([a, -b], [b, a])


def _pauli_pair(pauli: np.ndarray, theta: float) -> np.ndarray:
    """exp(-i theta/2 P (x) P)."""
    return math.cos(theta / 2) * np.eye(4) - 1j * math.sin(theta / 2) * np.kron(pauli, pauli)


def _frac(num: float, power: float) -> float:
    return -math.pi * num / 2 ** (power - 1)


X, Y, Z = _m([0, 1], [1, 0]), _m([0, -1j], [1j, 0]), _m([1, 0], [0, -1])
H = _R2 * _m([1, 1], [1, -1])
S, T = _phase(math.pi / 2), _phase(math.pi / 4)
SX = 0.5 * _m([1 + 1j, 1 - 1j], [1 - 1j, 1 + 1j])
SWAP = _m([1, 0, 0, 0], [0, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 1])


@dataclass(frozen=True)
class Spec:
    """A named gate: number of controls before the targets, of targets, and the base matrix from parameters."""

    controls: int
    targets: int
    params: tuple[str, ...]
    base: Callable[..., np.ndarray]

    @property
    def arity(self) -> int:
        return self.controls + self.targets


def _spec(controls: int, targets: int, params: str, base) -> Spec:
    return Spec(controls, targets, tuple(params.split()), base if callable(base) else lambda: base)


_BASES: dict[str, tuple[str, object]] = {
    "X": ("", X),
    "Y": ("", Y),
    "Z": ("", Z),
    "H": ("", H),
    "SX": ("", SX),
    "RX": ("theta", _rx),
    "RY": ("theta", _ry),
    "RZ": ("theta", _rz),
    "U1": ("lam", _phase),
    "U3": ("theta phi lam", _u3),
}

SPECS: dict[str, Spec] = {
    **{n: _spec(0, 1, p, b) for n, (p, b) in _BASES.items()},
    **{f"C{n}": _spec(1, 1, p, b) for n, (p, b) in _BASES.items()},
    "I": _spec(0, 1, "", np.eye(2, dtype=complex)),
    "S": _spec(0, 1, "", S),
    "T": _spec(0, 1, "", T),
    "SDG": _spec(0, 1, "", S.conj()),
    "TDG": _spec(0, 1, "", T.conj()),
    "R": _spec(0, 1, "k", lambda k: _phase(2 * math.pi / 2**k)),
    "G": _spec(0, 1, "p", _g),
    "RI": _spec(0, 1, "theta", lambda theta: cmath.exp(-0.5j * theta) * np.eye(2, dtype=complex)),
    "R1": _spec(0, 1, "theta", _phase),
    "U2": _spec(0, 1, "phi lam", lambda phi, lam: _u3(math.pi / 2, phi, lam)),
    "RXFRAC": _spec(0, 1, "num pow", lambda num, pow: _rx(_frac(num, pow))),
    "RYFRAC": _spec(0, 1, "num pow", lambda num, pow: _ry(_frac(num, pow))),
    "RZFRAC": _spec(0, 1, "num pow", lambda num, pow: _rz(_frac(num, pow))),
    "RIFRAC": _spec(0, 1, "num pow", lambda num, pow: cmath.exp(-0.5j * _frac(num, pow)) * np.eye(2, dtype=complex)),
    "R1FRAC": _spec(0, 1, "num pow", lambda num, pow: _phase(_frac(num, pow))),
    "CR": _spec(1, 1, "k", lambda k: _phase(2 * math.pi / 2**k)),
    "SWAP": _spec(0, 2, "", SWAP),
    "RXX": _spec(0, 2, "theta", lambda theta: _pauli_pair(X, theta)),
    "RYY": _spec(0, 2, "theta", lambda theta: _pauli_pair(Y, theta)),
    "RZZ": _spec(0, 2, "theta", lambda theta: _pauli_pair(Z, theta)),
    "CCX": _spec(2, 1, "", X),
    "CCZ": _spec(2, 1, "", Z),
    "C3X": _spec(3, 1, "", X),
    "C4X": _spec(4, 1, "", X),
    "C3SQRTX": _spec(3, 1, "", SX),
    "CSWAP": _spec(1, 2, "", SWAP),
    # relative-phase Toffolis: the textbook Margolus forms, as dense matrices
    "RCCX": _spec(0, 3, "", lambda: _relative_phase(2)),
    "RC3X": _spec(0, 4, "", lambda: _relative_phase(3)),
}

ALIASES = {
    "CNOT": "CX",
    "ID": "I",
    "P": "U1",
    "PHASE": "U1",
    "CP": "CU1",
    "TOFFOLI": "CCX",
    "FREDKIN": "CSWAP",
    "C3SX": "C3SQRTX",
    "C3XSQRTX": "C3SQRTX",
    "U": "U3",
}

#: Gates whose matrix comes with the call: any unitary under one control, and bare 1- and 2-qubit ones.
CUSTOM = {"CU": (1, 1), "C1": (0, 1), "C2": (0, 2)}


def _relative_phase(controls: int) -> np.ndarray:
    """RCCX and RC3X as products of their standard decompositions (qubits: controls, then target)."""
    n = controls + 1
    t = controls
    u2 = lambda phi, lam: _u3(math.pi / 2, phi, lam)
    hh, tt, td = u2(0, math.pi), T, T.conj()
    cx = lambda c: embed(X, (t,), (c,), n)
    one = lambda m: embed(m, (t,), (), n)
    if controls == 2:
        ops = [one(hh), one(tt), cx(1), one(td), cx(0), one(tt), cx(1), one(td), one(hh)]
    else:
        mid = [cx(0), one(tt), cx(1), one(td), cx(0), one(tt), cx(1), one(td)]
        ops = [one(hh), one(tt), cx(2), one(td), one(hh), *mid, one(hh), one(tt), cx(2), one(td), one(hh)]
    out = np.eye(1 << n, dtype=complex)
    for m in ops:
        out = m @ out
    return out


def embed(u: np.ndarray, targets, controls, n: int) -> np.ndarray:
    """Dense 2^n matrix of a controlled operator; its qubits are numbers below n."""
    out = np.zeros((1 << n, 1 << n), dtype=complex)
    for col in range(1 << n):
        if all(col >> c & 1 for c in controls):
            p = sum((col >> q & 1) << i for i, q in enumerate(targets))
            base = col & ~sum(1 << q for q in targets)
            for r in range(1 << len(targets)):
                out[base | sum(1 << q for i, q in enumerate(targets) if r >> i & 1), col] += u[r, p]
        else:
            out[col, col] = 1
    return out


def canonical(name: str) -> str:
    up = name.upper()
    return ALIASES.get(up, up)


def spec_of(name: str) -> Spec | None:
    return SPECS.get(canonical(name))


def matrix(name: str, params: dict | None = None) -> np.ndarray:
    """Dense matrix of a named gate over all of its qubits, controls first."""
    up, params = canonical(name), dict(params or {})
    if up in CUSTOM:
        controls, targets = CUSTOM[up]
        base = np.linalg.matrix_power(np.array(params["U"], dtype=complex), int(params.get("exponent", 1)))
    else:
        spec = SPECS[up]
        controls, targets = spec.controls, spec.targets
        base = spec.base(*[params[p] for p in spec.params])
    n = controls + targets
    return embed(base, tuple(range(controls, n)), tuple(range(controls)), n)


def rows_of(name: str, params: dict | None = None, keep_zero: bool = False) -> list[tuple[int, int, float, float]]:
    """The matrix as relation rows (row, col, real, imag), zeros left out."""
    m = matrix(name, params)
    return [(r, c, float(m[r, c].real), float(m[r, c].imag)) for c in range(m.shape[1]) for r in range(m.shape[0]) if keep_zero or abs(m[r, c]) > ZERO]


def class_of(u: np.ndarray) -> str:
    """D diagonal, P one non-zero an column (and row), G general."""
    big = np.abs(u) > ZERO
    if not (big & ~np.eye(len(u), dtype=bool)).any():
        return "D"
    return "P" if (big.sum(axis=0) == 1).all() and (big.sum(axis=1) == 1).all() else "G"


def is_unitary(u: np.ndarray, tolerance: float = 1e-10) -> bool:
    return np.allclose(u.conj().T @ u, np.eye(len(u)), atol=tolerance)
