"""Dense NumPy oracle of the tests."""

import numpy as np

from ketflow.functions import gates as G


def simulate(circuit) -> np.ndarray:
    v = np.zeros(1 << circuit.n, complex)
    v[0] = 1
    for g in circuit.gates:
        controls, targets, u = g.parts()
        v = G.embed(u, targets, controls, circuit.n) @ v
    return v


def dense(state, n: int) -> np.ndarray:
    v = np.zeros(1 << n, complex)
    for r in state.collect():
        v[r.idx] = complex(r.real, r.imag)
    return v
