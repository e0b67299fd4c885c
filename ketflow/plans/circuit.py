"""Circuits: the query language.  Validation, normalisation, layering and grouping passes.

A circuit is a document ``{"number_of_qubits": n, "gates": [{"qubits", "gate", "params"}]}``;
``parse`` checks it and gives a ``Circuit`` of immutable gates in program order.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ketflow.functions import gates as G
from ketflow.schema import CIRCUIT, MAX_QUBITS


class CircuitError(ValueError):
    """A circuit document that breaks the contract."""


@dataclass(frozen=True)
class Gate:
    seq: int
    name: str
    qubits: tuple[int, ...]
    params: dict = field(default_factory=dict, hash=False)

    @property
    def spec(self) -> G.Spec | None:
        return G.spec_of(self.name)

    @property
    def matrix(self) -> np.ndarray:
        return G.matrix(self.name, self.params)

    def parts(self) -> tuple[tuple[int, ...], tuple[int, ...], np.ndarray]:
        """(control qubits, target qubits, base matrix)."""
        up = G.canonical(self.name)
        if up in G.CUSTOM:
            k = G.CUSTOM[up][0]
            base = np.linalg.matrix_power(np.array(self.params["U"], dtype=complex), int(self.params.get("exponent", 1)))
        else:
            k = self.spec.controls
            base = self.spec.base(*[self.params[p] for p in self.spec.params])
        return self.qubits[:k], self.qubits[k:], base


@dataclass(frozen=True)
class Circuit:
    n: int
    gates: tuple[Gate, ...]

    def document(self) -> dict:
        """The circuit as a plain document again."""
        return {"number_of_qubits": self.n, "gates": [{"qubits": list(g.qubits), "gate": g.name, "params": dict(g.params)} for g in self.gates]}

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(self.document(), sort_keys=True, default=_plain).encode()).hexdigest()

    def __add__(self, other: Circuit) -> Circuit:
        return of(max(self.n, other.n), [(g.name, g.qubits, g.params) for g in (*self.gates, *other.gates)])


def _plain(x):
    if isinstance(x, np.ndarray):
        return x.tolist()
    if isinstance(x, complex):
        return [x.real, x.imag]
    if isinstance(x, np.generic):
        return x.item()
    raise TypeError(type(x))


def of(n: int, gates) -> Circuit:
    """Circuit of (name, qubits, params) triples, unchecked."""
    return Circuit(n, tuple(Gate(i, name, tuple(q), dict(p)) for i, (name, q, p) in enumerate(gates)))


_ENCODED = re.compile(r"(CR|R)(\d+)")


def decode_name(name: str) -> tuple[str, dict]:
    """``CR3`` is CR with k = 3 and ``R2`` is R with k = 2; other names stand for themselves."""
    m = _ENCODED.fullmatch(name.upper())
    return (m[1], {"k": int(m[2])}) if m else (name, {})


def _number(value, what: str) -> float | int:
    if isinstance(value, bool) or not isinstance(value, (int, float, np.integer, np.floating)):
        raise CircuitError(f"{what} must be a number")
    return value


def _unitary(params: dict, targets: int, name: str) -> None:
    try:
        u = np.array(params["U"], dtype=complex)
    except (TypeError, ValueError) as e:
        raise CircuitError(f"{name}: U must be a matrix of complex numbers") from e
    if u.shape != (1 << targets,) * 2 or not G.is_unitary(u, 1e-8):
        raise CircuitError(f"{name}: U must be a unitary {1 << targets} x {1 << targets} matrix")


def parse(doc: dict) -> Circuit:
    """Strictly check a circuit document.  Explicit parameters win over those encoded in a name."""
    if not isinstance(doc, dict) or set(doc) != {"number_of_qubits", "gates"}:
        raise CircuitError("a circuit has exactly the keys number_of_qubits and gates")
    n = doc["number_of_qubits"]
    if isinstance(n, bool) or not isinstance(n, int) or not 1 <= n <= MAX_QUBITS:
        raise CircuitError(f"number_of_qubits must be an integer from 1 to {MAX_QUBITS}")
    if not isinstance(doc["gates"], (list, tuple)):
        raise CircuitError("gates must be a list")
    out = []
    for i, g in enumerate(doc["gates"]):
        at = f"gate {i}"
        if not isinstance(g, dict) or not {"qubits", "gate"} <= set(g) <= {"qubits", "gate", "params"}:
            raise CircuitError(f"{at}: keys must be qubits, gate and at most params")
        name, encoded = decode_name(str(g["gate"]))
        params = encoded | dict(g.get("params") or {})
        up = G.canonical(name)
        qubits = g["qubits"]
        if not isinstance(qubits, (list, tuple)) or any(isinstance(q, bool) or not isinstance(q, (int, np.integer)) for q in qubits):
            raise CircuitError(f"{at}: qubits must be integers")
        qubits = tuple(int(q) for q in qubits)
        if up in G.CUSTOM:
            arity, needed = sum(G.CUSTOM[up]), ("U",)
        elif up in G.SPECS:
            arity, needed = G.SPECS[up].arity, G.SPECS[up].params
        else:
            raise CircuitError(f"{at}: unknown gate {g['gate']}")
        if len(qubits) != arity:
            raise CircuitError(f"{at}: {up} acts on {arity} qubits")
        if len(set(qubits)) != arity:
            raise CircuitError(f"{at}: a qubit occurs twice")
        if any(not 0 <= q < n for q in qubits):
            raise CircuitError(f"{at}: qubit out of range")
        for p in needed:
            if p not in params:
                raise CircuitError(f"{at}: {up} needs {p}")
            if p != "U":
                _number(params[p], f"{at}: {p}")
        if "exponent" in params and int(_number(params["exponent"], f"{at}: exponent")) != params["exponent"]:
            raise CircuitError(f"{at}: exponent must be whole")
        if up in G.CUSTOM:
            _unitary(params, G.CUSTOM[up][1], up)
        if up == "G" and params["p"] < 1:
            raise CircuitError(f"{at}: G needs p >= 1")
        out.append((up, qubits, params))
    return of(n, out)


# --- relational form --------------------------------------------------------


def to_frame(spark: SparkSession, circuit: Circuit) -> DataFrame:
    """The circuit as a relation, one row a gate."""
    rows = []
    for g in circuit.gates:
        u = [(float(x.real), float(x.imag)) for x in np.array(g.params["U"], dtype=complex).ravel()] if "U" in g.params else None
        rows.append((g.seq, g.name, list(g.qubits), {k: float(v) for k, v in g.params.items() if k != "U" and not isinstance(v, str)}, u))
    return spark.createDataFrame(rows, CIRCUIT)


def from_frame(df: DataFrame, n: int) -> Circuit:
    """Back from the relation; a circuit is a plan and small, unlike a state."""
    out = []
    for r in df.orderBy("seq").collect():
        params = {k: int(v) if k in ("k", "exponent") else v for k, v in (r.params or {}).items()}
        if r.u is not None:
            side = round(len(r.u) ** 0.5)
            params["U"] = [[complex(*r.u[i * side + j]) for j in range(side)] for i in range(side)]
        out.append({"gate": r.gate, "qubits": list(r.qubits), "params": params})
    return parse({"number_of_qubits": n, "gates": out})


# --- layering and dependencies ----------------------------------------------


def levelize(circuit: Circuit) -> list[list[Gate]]:
    """As-soon-as-possible layers: a gate comes right after the last earlier gate on any of its qubits."""
    free = Counter()
    layers: list[list[Gate]] = []
    for g in circuit.gates:
        at = max(free[q] for q in g.qubits)
        if at == len(layers):
            layers.append([])
        layers[at].append(g)
        for q in g.qubits:
            free[q] = at + 1
    return layers


@dataclass(frozen=True)
class Dag:
    """Direct dependencies: for each gate the last earlier gate on each of its qubits."""

    circuit: Circuit
    before: tuple[frozenset[int], ...]

    @classmethod
    def build(cls, circuit: Circuit) -> Dag:
        last: dict[int, int] = {}
        before = []
        for g in circuit.gates:
            before.append(frozenset(last[q] for q in g.qubits if q in last))
            last.update(dict.fromkeys(g.qubits, g.seq))
        return cls(circuit, tuple(before))

    def after(self, seq: int) -> set[int]:
        return {g.seq for g in self.circuit.gates if seq in self.before[g.seq]}

    def all_before(self, seq: int) -> set[int]:
        """Every earlier gate that must come first, directly or not."""
        out: set[int] = set()
        todo = [seq]
        while todo:
            for p in self.before[todo.pop()]:
                if p not in out:
                    out.add(p)
                    todo.append(p)
        return out

    def ready(self, executed: set[int]) -> list[Gate]:
        """Gates not executed whose dependencies all are."""
        return [g for g in self.circuit.gates if g.seq not in executed and self.before[g.seq] <= executed]

    def levels(self) -> list[list[Gate]]:
        return levelize(self.circuit)

    def is_acyclic_partition(self, part_of: list[int]) -> bool:
        """True if the parts can run one after the other: no cycle among them."""
        edges = {(part_of[p], part_of[g.seq]) for g in self.circuit.gates for p in self.before[g.seq] if part_of[p] != part_of[g.seq]}
        nodes = set(part_of)
        while nodes:
            free = {x for x in nodes if not any(b == x and a in nodes for a, b in edges)}
            if not free:
                return False
            nodes -= free
        return True


def qubits_used(gates) -> set[int]:
    return {q for g in gates for q in g.qubits}


def independent(gates) -> bool:
    """No two of the gates share a qubit."""
    seen: set[int] = set()
    for g in gates:
        if not seen.isdisjoint(g.qubits):
            return False
        seen.update(g.qubits)
    return True


def independent_runs(gates) -> list[list[Gate]]:
    """Consecutive gates cut into runs without a shared qubit."""
    out: list[list[Gate]] = []
    used: set[int] = set()
    for g in gates:
        if not out or not used.isdisjoint(g.qubits):
            out.append([])
            used = set()
        out[-1].append(g)
        used.update(g.qubits)
    return out


@dataclass(frozen=True)
class Batch:
    start: int
    end: int
    gates: tuple[Gate, ...]


def batches(circuit: Circuit, size: int, start: int = 0) -> list[Batch]:
    """Runs [start, end) of at most ``size`` gates, from gate ``start`` on."""
    if size < 1:
        raise ValueError("size must be at least 1")
    return [Batch(a, min(a + size, len(circuit.gates)), circuit.gates[a : a + size]) for a in range(start, len(circuit.gates), size)]


# --- partitioning into sub-circuits -----------------------------------------

STRATEGIES = ("sequence", "rows", "qubits", "exchanges")


def rows_moved(g: Gate) -> int:
    """Rows that a gate writes for each row it reads: one if it only rewrites it; a general gate writes 2^targets and sends them through an exchange, twice as dear."""
    _, targets, u = g.parts()
    return 1 if G.class_of(u) in "DP" else 2 << len(targets)


def moving_qubits(g: Gate) -> set[int]:
    """Qubits whose bits must be local for the gate to run without an exchange."""
    _, targets, u = g.parts()
    return set() if G.class_of(u) == "D" else set(targets)


def partition(circuit: Circuit, parts: int, strategy: str = "sequence") -> list[int]:
    """Part of each gate, by the rows that the parts move.

    sequence: consecutive gates, cut where the rows moved so far pass the next part's
    share (parts run one after the other); rows: the gates that move most first, each to
    the part that moves least; qubits: in program order, to the part that has to touch the
    fewest further qubits among those that are not above their share; exchanges: to the
    part where rows moved, counted again for every qubit that becomes moving there, stay least.
    """
    if parts < 1 or strategy not in STRATEGIES:
        raise ValueError(f"parts must be at least 1 and the strategy one of {STRATEGIES}")
    moved = [rows_moved(g) for g in circuit.gates]
    share = max(1.0, sum(moved) / parts)
    out, load = [0] * len(moved), [0.0] * parts
    if strategy == "sequence":
        done = 0
        for g, m in zip(circuit.gates, moved, strict=True):
            out[g.seq] = min(parts - 1, int((done + m / 2) / share))
            done += m
        return out
    touched: list[set[int]] = [set() for _ in range(parts)]
    order = sorted(circuit.gates, key=lambda g: (-moved[g.seq], g.seq)) if strategy == "rows" else circuit.gates
    for g in order:
        own = moving_qubits(g) if strategy == "exchanges" else set(g.qubits)
        further = [len(own - t) for t in touched]
        if strategy == "rows":
            k = min(range(parts), key=lambda i: load[i])
        elif strategy == "qubits":
            k = min((i for i in range(parts) if load[i] <= share), key=lambda i: (further[i], load[i]), default=0)
        else:
            k = min(range(parts), key=lambda i: load[i] + moved[g.seq] * (1 + further[i]))
        out[g.seq] = k
        load[k] += moved[g.seq] * (1 + further[k] if strategy == "exchanges" else 1)
        touched[k] |= own
    return out


def sub_circuits(circuit: Circuit, part_of: list[int]) -> list[dict]:
    """A circuit document for each part, with all parameters, over the original qubit numbers."""
    return [of(circuit.n, [(g.name, g.qubits, g.params) for g in circuit.gates if part_of[g.seq] == k]).document() for k in range(max(part_of, default=-1) + 1)]


def partition_stats(circuit: Circuit, part_of: list[int]) -> dict:
    """Sizes, loads and qubits of the parts and the number of qubits each pair shares."""
    n = max(part_of, default=-1) + 1
    own = [[g for g in circuit.gates if part_of[g.seq] == k] for k in range(n)]
    used = [qubits_used(x) for x in own]
    return {
        "sizes": [len(x) for x in own],
        "rows_moved": [sum(map(rows_moved, x)) for x in own],
        "qubits": [sorted(x) for x in used],
        "overlap": {(a, b): len(used[a] & used[b]) for a in range(n) for b in range(n) if a != b},
    }


def qubit_frequency(gates, window: int | None = None) -> list[tuple[int, int]]:
    """(qubit, uses) in the next ``window`` gates, most used first."""
    c = Counter(q for g in list(gates)[:window] for q in g.qubits)
    return sorted(c.items(), key=lambda x: (-x[1], x[0]))
