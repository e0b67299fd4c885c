"""Plan-time rewriting: gates -> fused operators -> stages -> cuts.

Everything here is plain Python over a circuit, before any DataFrame exists.  Rewrites
only commute operators that share no qubit or are both diagonal, so program order is
kept on every qubit.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from dataclasses import dataclass, field

import numpy as np

from ketflow.functions import gates as G
from ketflow.plans.circuit import Circuit, CircuitError, Gate
from ketflow.schema import MAX_QUBITS

#: Widest block that fusion builds (rows fan out up to 2^width at a general block).
MAX_BLOCK = 3
#: General operators between two writes of the state.
CUT_EVERY = 12


@dataclass(frozen=True)
class Op:
    """A controlled operator: the base matrix acts on ``targets`` where all ``controls`` are 1."""

    controls: tuple[int, ...]
    targets: tuple[int, ...]
    u: np.ndarray = field(hash=False, compare=False)
    seqs: tuple[int, ...] = ()

    @property
    def kind(self) -> str:
        return G.class_of(self.u)

    @property
    def qubits(self) -> frozenset[int]:
        return frozenset(self.controls) | frozenset(self.targets)

    @property
    def moving(self) -> frozenset[int]:
        """Qubits whose bits the operator can change; controls and diagonals change none."""
        return frozenset() if self.kind == "D" else frozenset(self.targets)

    def dense(self, qubits: tuple[int, ...]) -> np.ndarray:
        at = {q: i for i, q in enumerate(qubits)}
        return G.embed(self.u, tuple(at[q] for q in self.targets), tuple(at[q] for q in self.controls), len(qubits))


def lower(gate: Gate) -> Op:
    controls, targets, u = gate.parts()
    return Op(tuple(controls), tuple(targets), u, (gate.seq,))


def non_insular(op: Op) -> frozenset[int]:
    """Qubits that must be local for the operator to run without an exchange."""
    return op.moving


# --- fusion -----------------------------------------------------------------


def _commutes(a: Op, b: Op) -> bool:
    return a.qubits.isdisjoint(b.qubits) or a.kind == b.kind == "D"


def _merge(a: Op, b: Op) -> Op:
    qubits = tuple(sorted(a.qubits | b.qubits))
    return Op((), qubits, b.dense(qubits) @ a.dense(qubits), a.seqs + b.seqs)


def _simplify(op: Op) -> Op:
    """Split off qubits on which a fused operator is a plain control or the identity."""
    controls, targets, u = set(op.controls), list(op.targets), op.u
    changed = True
    while changed and targets:
        changed = False
        for i, q in enumerate(targets):
            low = np.array([r for r in range(len(u)) if not r >> i & 1])
            high = low | (1 << i)
            if np.abs(u[np.ix_(low, high)]).max() > G.ZERO or np.abs(u[np.ix_(high, low)]).max() > G.ZERO:
                continue
            zero, one = u[np.ix_(low, low)], u[np.ix_(high, high)]
            if np.abs(zero - one).max() <= G.ZERO and len(targets) > 1:
                u = zero
            elif len(targets) > 1 and np.abs(zero - np.eye(len(zero))).max() <= G.ZERO:
                controls.add(q)
                u = one
            else:
                continue
            targets.pop(i)
            changed = True
            break
    return Op(tuple(sorted(controls)), tuple(targets), u, op.seqs)


def _is_identity(op: Op) -> bool:
    return np.abs(op.u - np.eye(len(op.u))).max() <= G.ZERO


def fuse_single(ops: list[Op]) -> list[Op]:
    """Runs of one-qubit operators on a qubit become one; a product that is the identity goes."""
    out: list[Op | None] = []
    open_at: dict[int, int] = {}
    for op in ops:
        q = op.targets[0]
        if not op.controls and len(op.targets) == 1:
            if q in open_at:
                old = out[open_at[q]]
                out[open_at[q]] = Op((), (q,), op.u @ old.u, old.seqs + op.seqs)
            else:
                open_at[q] = len(out)
                out.append(op)
        else:
            for x in op.qubits:
                open_at.pop(x, None)
            out.append(op)
    return [op for op in out if not _is_identity(op)]


def fuse_blocks(ops: list[Op], width: int = MAX_BLOCK) -> list[Op]:
    """Gather operators into blocks of at most ``width`` qubits where that saves a general step.

    An operator joins an earlier general block if every operator in between commutes with
    it and the union stays narrow; diagonal and permutation operators, free as they are,
    join only blocks that hold all of their qubits already.
    """
    out: list[Op] = []
    for op in ops:
        spot = None
        for i in range(len(out) - 1, -1, -1):
            b = out[i]
            union = b.qubits | op.qubits
            if len(union) <= width and b.kind == "G" and (op.kind == "G" or op.qubits <= b.qubits):
                spot = i
                break
            if not _commutes(b, op):
                break
        if spot is None:
            out.append(op)
        else:
            out[spot] = _merge(out[spot], op)
    return [s for op in out if not _is_identity(s := _simplify(op))]


def fuse(ops: list[Op], width: int = MAX_BLOCK) -> list[Op]:
    return fuse_blocks(fuse_single(ops), width)


def fusion_stats(circuit: Circuit, width: int = MAX_BLOCK) -> dict:
    before = [lower(g) for g in circuit.gates]
    after = fuse(before, width)
    count = lambda ops: {k: sum(op.kind == k for op in ops) for k in "DPG"}
    return {"gates": len(before), "operators": len(after), "before": count(before), "after": count(after)}


def combined(gates: list[Gate]) -> Op:
    """Tensor product of gates without a common qubit, as one operator."""
    ops = [lower(g) for g in gates]
    seen: set[int] = set()
    for op in ops:
        if not seen.isdisjoint(op.qubits):
            raise CircuitError("gates of a tensor product share a qubit")
        seen |= op.qubits
    out = ops[0]
    for op in ops[1:]:
        out = _merge(out, op)
    return out


# --- staging ----------------------------------------------------------------


@dataclass(frozen=True)
class Stage:
    """Operators that run on one distribution of the state: rows meet by the bits outside ``local``."""

    local: frozenset[int]
    ops: tuple[Op, ...]

    @property
    def general(self) -> int:
        return sum(op.kind == "G" for op in self.ops)


def local_width(n: int) -> int:
    """Local qubits by default: all of a small state, and 2^10 parts and more of a large one."""
    return n if n <= 14 else max(14, min(n - 10, 20))


def stages(ops: list[Op], n: int, k: int | None = None) -> list[Stage]:
    """Cut the operators, in order, into stages whose general operators move at most ``k`` qubits.

    Diagonal operators never need a local qubit and join any stage.  Within a window that
    ends where an operator no longer fits, later operators may be pulled in if they commute
    with all that is left behind.  Every qubit not needed is filled up by those used next.
    """
    k = local_width(n) if k is None else min(k, n)
    widest = max((len(op.moving) for op in ops), default=0)
    if k < widest:
        raise CircuitError(f"{k} local qubits are too few for an operator on {widest}")
    left = list(ops)
    out: list[Stage] = []
    while left:
        local: set[int] = set()
        taken: list[Op] = []
        behind: list[Op] = []
        for op in left:
            fits = len(local | op.moving) <= k
            if fits and all(_commutes(b, op) for b in behind):
                local |= op.moving
                taken.append(op)
            else:
                behind.append(op)
        for op in behind:
            for q in sorted(op.moving):
                if len(local) < k:
                    local.add(q)
        for q in range(n):
            if len(local) < k:
                local.add(q)
        out.append(Stage(frozenset(local), tuple(taken)))
        left = behind
    return out


def fewest_stages(ops: list[Op], n: int, k: int, most: int = 200_000) -> list[Stage]:
    """As few stages as can be, by breadth-first search over what has run; program order holds but for commuting operators.

    For a set of local qubits it is never worse to run all that can run, so a step of the
    search is a set of ``k`` qubits out of those that operators still move.  Sets of run
    operators that another contains are dropped.  ``CircuitError`` after ``most`` steps: the
    search grows with the number of such sets; ``stages`` does not.
    """
    k = min(k, n)
    if any(len(op.moving) > k for op in ops):
        raise CircuitError(f"{k} local qubits are too few for an operator")
    needs = [sum(1 << i for i in range(j) if not _commutes(ops[i], op)) for j, op in enumerate(ops)]

    def closure(done: int, local: frozenset[int]) -> tuple[int, list[int]]:
        new = []
        for j, op in enumerate(ops):
            if not done >> j & 1 and needs[j] & ~done == 0 and op.moving <= local:
                done |= 1 << j
                new.append(j)
        return done, new

    everything, steps = (1 << len(ops)) - 1, 0
    level: dict[int, tuple[tuple[frozenset[int], list[int]], ...]] = {0: ()}
    while everything not in level:
        reached: dict[int, tuple] = {}
        for done, path in level.items():
            moved = sorted(frozenset().union(*(op.moving for j, op in enumerate(ops) if not done >> j & 1)))
            for chosen in itertools.combinations(moved, min(k, len(moved))):
                steps += 1
                if steps > most:
                    raise CircuitError(f"no plan of fewest stages within {most} steps")
                local = frozenset(chosen)
                after, new = closure(done, local)
                if new and after not in reached:
                    reached[after] = (*path, (local, new))
        level = {}
        for done in sorted(reached, key=int.bit_count, reverse=True):
            if not any(done & ~kept == 0 for kept in level):
                level[done] = reached[done]
    out = []
    for local, new in level[everything]:
        rest = [q for q in range(n) if q not in local][: k - len(local)]
        out.append(Stage(local | frozenset(rest), tuple(ops[j] for j in new)))
    return out


def staging_stats(circuit: Circuit, k: int | None = None, exact: bool = False) -> dict:
    ops = [lower(g) for g in circuit.gates]
    plan = fewest_stages(ops, circuit.n, local_width(circuit.n) if k is None else k) if exact else stages(ops, circuit.n, k)
    return {"stages": len(plan), "exchanges": max(0, len(plan) - 1), "local": [sorted(s.local) for s in plan], "general": [s.general for s in plan]}


def layout(stage: Stage, n: int) -> tuple[int, ...]:
    """Qubits in the order of a stage's bits: its local ones, which make up ``lo``, then those of ``hi``."""
    return (*sorted(stage.local), *(q for q in range(n) if q not in stage.local))


def crossings(plan_stages: list[Stage]) -> list[tuple[frozenset[int], frozenset[int]]]:
    """For each exchange between two stages, the qubits that become local and those that cease to be."""
    return [(b.local - a.local, a.local - b.local) for a, b in zip(plan_stages, plan_stages[1:], strict=False)]


# --- the physical plan ------------------------------------------------------


@dataclass(frozen=True)
class Cut:
    """Stages that run as one job, between two writes of the state."""

    stages: tuple[Stage, ...]

    @property
    def seqs(self) -> tuple[int, ...]:
        return tuple(sorted(s for st in self.stages for op in st.ops for s in op.seqs))


@dataclass(frozen=True)
class Plan:
    n: int
    cuts: tuple[Cut, ...]
    hash: str

    @property
    def general(self) -> int:
        return sum(st.general for c in self.cuts for st in c.stages)


def plan(circuit: Circuit, fusion: bool = True, staging: bool | str = True, k: int | None = None, width: int = MAX_BLOCK, cut_every: int = CUT_EVERY) -> Plan:
    """Physical plan of a circuit; its hash covers the circuit and every option that shapes it.

    ``staging`` is "exact" for as few stages as can be, which small circuits can afford.
    """
    if circuit.n > MAX_QUBITS:
        raise CircuitError(f"at most {MAX_QUBITS} qubits fit the index")
    ops = [lower(g) for g in circuit.gates]
    if fusion:
        ops = fuse(ops, width)
    if staging == "exact":
        todo = fewest_stages(ops, circuit.n, local_width(circuit.n) if k is None else k)
    else:
        todo = stages(ops, circuit.n, k) if staging else [Stage(frozenset(), (op,)) for op in ops]
    cuts: list[Cut] = []
    held: list[Stage] = []
    used = 0
    for st in todo:
        part: list[Op] = []
        for op in st.ops:
            if op.kind == "G" and used == cut_every:
                if part:
                    held.append(Stage(st.local, tuple(part)))
                cuts.append(Cut(tuple(held)))
                held, part, used = [], [], 0
            part.append(op)
            used += op.kind == "G"
        if part:
            held.append(Stage(st.local, tuple(part)))
    if held:
        cuts.append(Cut(tuple(held)))
    told = json.dumps([circuit.hash(), fusion, staging, k, width, cut_every])
    return Plan(circuit.n, tuple(cuts), hashlib.sha256(told.encode()).hexdigest())


def angle_of(value: complex) -> float:
    return math.atan2(value.imag, value.real)
