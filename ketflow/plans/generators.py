"""Circuit generators."""

from __future__ import annotations

import math
import random

import numpy as np

from ketflow.plans.circuit import Circuit, Gate, of


def _reversed(c: Circuit) -> Circuit:
    """The gate list backwards (not the inverse circuit)."""
    return of(c.n, [(g.name, g.qubits, g.params) for g in reversed(c.gates)])


def ghz(n: int, reverse: bool = False) -> Circuit:
    c = of(n, [("H", (0,), {}), *(("CX", (q - 1, q), {}) for q in range(1, n))])
    return _reversed(c) if reverse else c


def qft(n: int, reverse: bool = False) -> Circuit:
    """Hadamards and controlled phases, without the final swaps."""
    gates = []
    for j in range(n):
        gates.append(("H", (j,), {}))
        gates += [("CR", (k, j), {"k": k - j + 1}) for k in range(j + 1, n)]
    c = of(n, gates)
    return _reversed(c) if reverse else c


def qpe(n: int) -> Circuit:
    """Phase estimation of Z on qubit n with n counting qubits: n + 1 qubits in all."""
    z = [[1, 0], [0, -1]]
    gates = [("H", (j,), {}) for j in range(n)]
    gates += [("CU", (j, n), {"U": z, "exponent": 2**j}) for j in range(n)]
    for j in range(n):
        gates += [("CR", (k, j), {"k": j - k + 1}) for k in range(j)]
        gates.append(("H", (j,), {}))
    return of(n + 1, gates)


def w(n: int, reverse: bool = False) -> Circuit:
    """n equal amplitudes on the one-hot indices."""
    gates = [("X", (0,), {})]
    if n > 1:
        gates += [("G", (1,), {"p": n}), ("CX", (1, 0), {})]
    for i in range(1, n - 1):
        p = n - i
        a, b = math.sqrt(1 / p), math.sqrt(1 - 1 / p)
        gates += [("CU", (i, i + 1), {"U": [[a, -b], [b, a]], "exponent": 1, "name": f"CG{p}"}), ("CX", (i + 1, i), {})]
    c = of(n, gates)
    return _reversed(c) if reverse else c


def hadamard_wall(n: int) -> Circuit:
    return of(n, [("H", (q,), {}) for q in range(n)])


def w_qft(n: int) -> Circuit:
    return w(n) + qft(n)


def ghz_qft(n: int) -> Circuit:
    return ghz(n) + qft(n)


def ghz_alternating(n: int, depth: int) -> Circuit:
    """GHZ and its reversed gate list in turn, cut to ``depth`` gates."""
    gates: list[Gate] = []
    while len(gates) < depth:
        gates += ghz(n, reverse=len(gates) // n % 2 == 1).gates
    return of(n, [(g.name, g.qubits, g.params) for g in gates[:depth]])


def bell() -> Circuit:
    return ghz(2)


def x_on_first(n: int = 3) -> Circuit:
    return of(n, [("X", (0,), {})])


def ry_third(n: int = 2) -> Circuit:
    return of(n, [("RY", (0,), {"theta": math.pi / 3})])


def cr3(n: int = 2) -> Circuit:
    return of(n, [("H", (0,), {}), ("H", (1,), {}), ("CR", (0, 1), {"k": 3})])


def load(kind: str, n: int) -> Circuit:
    """Loads outside the Clifford group: ry, h_t, h_t_cr, g, r or cu on every qubit."""
    each = {
        "ry": lambda q: [("RY", (q,), {"theta": math.pi / (q + 2)})],
        "h_t": lambda q: [("H", (q,), {}), ("T", (q,), {})],
        "h_t_cr": lambda q: [("H", (q,), {}), ("T", (q,), {}), *([("CR", (q - 1, q), {"k": 3})] if q else [])],
        "g": lambda q: [("G", (q,), {"p": q + 2})],
        "r": lambda q: [("H", (q,), {}), ("R", (q,), {"k": q % 4 + 1})],
        "cu": lambda q: [("H", (q,), {}), *([("CU", (q - 1, q), {"U": [[math.cos(0.4), -math.sin(0.4)], [math.sin(0.4), math.cos(0.4)]], "exponent": 1})] if q else [])],
    }[kind]
    return of(n, [g for q in range(n) for g in each(q)])


def sparse(amplitudes: int, n: int) -> Circuit:
    """A state of 2^h amplitudes spread by CNOTs: h = log2(amplitudes)."""
    h = amplitudes.bit_length() - 1
    return of(n, [*(("H", (q,), {}) for q in range(h)), *(("CX", (q % h if h else 0, q), {}) for q in range(h, n) if h)])


def partial(n: int, h: int) -> Circuit:
    """Superposition of the first h qubits only."""
    return of(n, [("H", (q,), {}) for q in range(h)])


def cluster(n: int, ring: bool = False) -> Circuit:
    """Hadamard wall and a chain (or ring) of CZ gates."""
    pairs = [(q, q + 1) for q in range(n - 1)] + ([(n - 1, 0)] if ring and n > 2 else [])
    return of(n, [*(("H", (q,), {}) for q in range(n)), *(("CZ", p, {}) for p in pairs)])


def deutsch_jozsa(n: int, balanced: bool = True) -> Circuit:
    """n - 1 inputs and one ancilla; the balanced oracle is the parity of the inputs."""
    last = n - 1
    gates = [("X", (last,), {}), *(("H", (q,), {}) for q in range(n))]
    gates += [("CX", (q, last), {}) for q in range(last)] if balanced else [("X", (last,), {})]
    return of(n, gates + [("H", (q,), {}) for q in range(last)])


def bernstein_vazirani(secret: str) -> Circuit:
    """Hidden bit string (its last sign is qubit 0) and one ancilla."""
    n = len(secret)
    gates = [("X", (n,), {}), *(("H", (q,), {}) for q in range(n + 1))]
    gates += [("CX", (q, n), {}) for q, b in enumerate(reversed(secret)) if b == "1"]
    return of(n + 1, gates + [("H", (q,), {}) for q in range(n)])


def grover(n: int, marked: int, rounds: int = 1) -> Circuit:
    """Search for one index among 2^n, n from 2 to 5."""
    flip = {2: "CZ", 3: "CCZ"}.get(n)

    def phase() -> list:
        if flip:
            return [(flip, tuple(range(n)), {})]
        return [("H", (n - 1,), {}), (f"C{n - 1}X", tuple(range(n)), {}), ("H", (n - 1,), {})]

    gates = [("H", (q,), {}) for q in range(n)]
    for _ in range(rounds):
        zeros = [("X", (q,), {}) for q in range(n) if not marked >> q & 1]
        gates += [*zeros, *phase(), *zeros]
        around = [(g, (q,), {}) for g in ("H", "X") for q in range(n)]
        gates += [*around, *phase(), *around[::-1]]
    return of(n, gates)


def qaoa_ring(n: int, angles: list[tuple[float, float]]) -> Circuit:
    """Cost (RZZ on a ring) and mixer (RX) layers, one a pair of angles."""
    gates = [("H", (q,), {}) for q in range(n)]
    for gamma, beta in angles:
        gates += [("RZZ", (q, (q + 1) % n), {"theta": 2 * gamma}) for q in range(n)]
        gates += [("RX", (q,), {"theta": 2 * beta}) for q in range(n)]
    return of(n, gates)


def real_amplitudes(n: int, layers: int, seed: int = 0) -> Circuit:
    """RY layers with CX chains between, as variational circuits use."""
    rng = random.Random(seed)
    turn = lambda: [("RY", (q,), {"theta": rng.uniform(-3, 3)}) for q in range(n)]
    gates = turn()
    for _ in range(layers):
        gates += [("CX", (q, q + 1), {}) for q in range(n - 1)] + turn()
    return of(n, gates)


def ising(n: int, steps: int, dt: float = 0.2) -> Circuit:
    """Trotter steps of the transverse-field chain."""
    gates = []
    for _ in range(steps):
        gates += [("RZZ", (q, q + 1), {"theta": 2 * dt}) for q in range(n - 1)] + [("RX", (q,), {"theta": 2 * dt}) for q in range(n)]
    return of(n, gates)


def adder(n: int, a: int, b: int) -> Circuit:
    """Ripple-carry sum of two n-bit numbers: carry, then b and a bit by bit, then the last carry; b holds the sum."""
    bq = lambda i: 1 + 2 * i
    aq = lambda i: 2 + 2 * i
    gates = [("X", (aq(i),), {}) for i in range(n) if a >> i & 1] + [("X", (bq(i),), {}) for i in range(n) if b >> i & 1]
    carry = [0, *(aq(i) for i in range(n))]
    for i in range(n):
        gates += [("CX", (aq(i), bq(i)), {}), ("CX", (aq(i), carry[i]), {}), ("CCX", (carry[i], bq(i), aq(i)), {})]
    gates.append(("CX", (aq(n - 1), 2 * n + 1), {}))
    for i in reversed(range(n)):
        gates += [("CCX", (carry[i], bq(i), aq(i)), {}), ("CX", (aq(i), carry[i]), {}), ("CX", (carry[i], bq(i)), {})]
    return of(2 * n + 2, gates)


def graph_state(n: int) -> Circuit:
    return cluster(n, ring=True)


def random_circuit(n: int, depth: int, seed: int = 0) -> Circuit:
    """Random gates of all classes, diagonal ones often on shared qubits."""
    rng = random.Random(seed)
    gates = []
    for _ in range(depth):
        kind = rng.choice(["H", "X", "Y", "Z", "S", "T", "RX", "RY", "RZ", "R", "SX", "G", "U3", "CX", "CZ", "CY", "CR", "SWAP", "CU", "RXX", "RZZ", "CCX", "CSWAP"])
        arity = {"CCX": 3, "CSWAP": 3}.get(kind, 2 if kind in ("CX", "CZ", "CY", "CR", "SWAP", "CU", "RXX", "RZZ") else 1)
        if arity > n:
            continue
        params: dict = {}
        if kind in ("RX", "RY", "RZ", "RXX", "RZZ"):
            params = {"theta": rng.uniform(-3, 3)}
        elif kind in ("R", "CR"):
            params = {"k": rng.randint(1, 5)}
        elif kind == "G":
            params = {"p": rng.randint(1, 5)}
        elif kind == "U3":
            params = {"theta": rng.uniform(0, 3), "phi": rng.uniform(0, 3), "lam": rng.uniform(0, 3)}
        elif kind == "CU":
            t = rng.uniform(0, 3)
            params = {"U": np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]]).tolist(), "exponent": rng.randint(1, 3)}
        gates.append((kind, tuple(rng.sample(range(n), arity)), params))
    return of(n, gates)
