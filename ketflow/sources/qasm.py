"""OpenQASM 2 text: reader (registers, macros, register-wide calls, parameter expressions) and writers."""

from __future__ import annotations

import ast
import math
import operator
import re
from dataclasses import dataclass, field

from ketflow.functions import gates as G
from ketflow.plans.circuit import Circuit, CircuitError, Dag, parse

#: OpenQASM name -> library name and parameter names, where they differ from the upper-case name.
_NAMES = {
    "u1": ("U1", ("lam",)), "p": ("U1", ("lam",)), "u2": ("U2", ("phi", "lam")), "u3": ("U3", ("theta", "phi", "lam")), "u": ("U3", ("theta", "phi", "lam")),
    "cu1": ("CU1", ("lam",)), "cp": ("CU1", ("lam",)), "cu3": ("CU3", ("theta", "phi", "lam")), "id": ("I", ()), "cx": ("CX", ()), "U": ("U3", ("theta", "phi", "lam")), "CX": ("CX", ()),
    "c3sqrtx": ("C3SQRTX", ()), "c3sx": ("C3SQRTX", ()),
}
_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos}
_FUNCS = {"sin": math.sin, "cos": math.cos, "tan": math.tan, "exp": math.exp, "ln": math.log, "sqrt": math.sqrt}


def evaluate(text: str, names: dict[str, float] | None = None) -> float:
    """Value of a parameter expression: numbers, pi, + - * / ^, the functions of the language, and given names."""
    names = {"pi": math.pi} | (names or {})

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Expression):
            return value(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return float(node.value)
        if isinstance(node, ast.Name) and node.id in names:
            return names[node.id]
        if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](value(node.operand))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _FUNCS and len(node.args) == 1:
            return _FUNCS[node.func.id](value(node.args[0]))
        raise CircuitError(f"bad parameter expression {text!r}")

    try:
        return value(ast.parse(text.strip().replace("^", "**"), mode="eval"))
    except SyntaxError as e:
        raise CircuitError(f"bad parameter expression {text!r}") from e


@dataclass
class Macro:
    params: list[str]
    qubits: list[str]
    body: list[tuple[str, list[str], list[str]]]


@dataclass(frozen=True)
class Event:
    """A step of a program, in order: a run of gates, a measurement or a reset, perhaps only if a register has a value."""

    kind: str
    gates: tuple[dict, ...] = ()
    qubit: int = -1
    bit: tuple[str, int] | None = None
    condition: tuple[str, int] | None = None


@dataclass
class Program:
    """A parsed file: the circuit, the measured bits (qubit, classical register, place), reset qubits, and all of it in order.

    ``circuit`` holds the unconditional gates; ``session.Session.run_program`` runs ``events``.
    """

    circuit: Circuit
    measures: list[tuple[int, str, int]] = field(default_factory=list)
    resets: list[int] = field(default_factory=list)
    events: list[Event] = field(default_factory=list)
    registers: dict[str, int] = field(default_factory=dict)


_CALL = re.compile(r"([A-Za-z_]\w*)\s*(?:\((.*)\))?\s+(.+)", re.S)


def _split(text: str) -> list[str]:
    """Split at commas outside parentheses."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[at:i].strip())
            at = i + 1
    return [x for x in [*out, text[at:].strip()] if x]


def _call(text: str) -> tuple[str, list[str], list[str]]:
    """(name, parameters, operands) of a gate call; the parameter list ends at its own parenthesis."""
    m = re.match(r"([A-Za-z_]\w*)\s*", text)
    if not m:
        raise CircuitError(f"cannot read {text!r}")
    name, rest = m[1], text[m.end() :]
    params: list[str] = []
    if rest.startswith("("):
        depth = 0
        for i, c in enumerate(rest):
            depth += (c == "(") - (c == ")")
            if depth == 0:
                params, rest = _split(rest[1:i]), rest[i + 1 :]
                break
    return name, params, _split(rest)


def read(text: str, classical: bool = False) -> Program:
    """Parse a program.  Barriers are dropped, measures and resets listed, unknown gates refused.

    ``if`` is refused unless ``classical``: a program with it is more than its circuit.
    """
    text = re.sub(r"//[^\n]*", "", text)
    macros: dict[str, Macro] = {}

    def take(m: re.Match) -> str:
        head, body = m[1].strip(), m[2]
        name, params, qubits = _call(head)
        macros[name] = Macro(params, qubits, [_call(x.strip()) for x in body.split(";") if x.strip() and not x.strip().startswith("barrier")])
        return ""

    text = re.sub(r"\bgate\s+([^{]*)\{([^}]*)\}", take, text)
    start: dict[str, tuple[int, int]] = {}
    total = 0
    gates: list[dict] = []
    program = Program(Circuit(1, ()))

    def bits(ref: str) -> list[int]:
        m = re.fullmatch(r"(\w+)(?:\s*\[\s*(\d+)\s*\])?", ref.strip())
        if not m or m[1] not in start:
            raise CircuitError(f"unknown register in {ref!r}")
        first, size = start[m[1]]
        if m[2] is None:
            return list(range(first, first + size))
        if int(m[2]) >= size:
            raise CircuitError(f"{ref} is out of range")
        return [first + int(m[2])]

    def emit(name: str, params: list[float], qubits: list[int], depth: int = 0) -> None:
        if name in macros:
            if depth > 64:
                raise CircuitError("gate definitions call one another without end")
            macro = macros[name]
            if len(params) != len(macro.params) or len(qubits) != len(macro.qubits):
                raise CircuitError(f"{name} is called with the wrong number of parameters or qubits")
            env, place = dict(zip(macro.params, params, strict=True)), dict(zip(macro.qubits, qubits, strict=True))
            for inner, inner_params, inner_qubits in macro.body:
                emit(inner, [evaluate(p, env) for p in inner_params], [place[q] for q in inner_qubits], depth + 1)
            return
        lib, names = _NAMES.get(name, (name.upper(), None))
        spec = G.spec_of(lib)
        if spec is None:
            raise CircuitError(f"unknown gate {name}")
        names = spec.params if names is None else names
        if len(names) != len(params):
            raise CircuitError(f"{name} takes {len(names)} parameters")
        gates.append({"gate": lib, "qubits": qubits, "params": dict(zip(names, params, strict=True))})

    for raw in text.split(";"):
        st = raw.strip()
        if not st or st.startswith(("OPENQASM", "include", "barrier", "opaque")):
            continue
        if m := re.fullmatch(r"(q|c)reg\s+(\w+)\s*\[\s*(\d+)\s*\]", st):
            if m[1] == "q":
                start[m[2]] = (total, int(m[3]))
                total += int(m[3])
            else:
                program.registers[m[2]] = int(m[3])
            continue
        condition = None
        if re.match(r"if\b", st):
            m = re.fullmatch(r"if\s*\(\s*(\w+)\s*==\s*(\d+)\s*\)\s*(.+)", st, re.S)
            if not classical or m is None:
                raise CircuitError(f"{st!r}: classically controlled statements need classical=True")
            if m[1] not in program.registers:
                raise CircuitError(f"unknown register in {st!r}")
            condition, st = (m[1], int(m[2])), m[3]
        if m := re.fullmatch(r"measure\s+(.+?)\s*->\s*(\w+)(?:\s*\[\s*(\d+)\s*\])?", st):
            for i, q in enumerate(bits(m[1])):
                place = int(m[3]) if m[3] else i
                if place >= program.registers.get(m[2], 0):
                    raise CircuitError(f"{st!r}: no such classical bit")
                program.measures.append((q, m[2], place))
                program.events.append(Event("measure", (), q, (m[2], place), condition))
            continue
        if re.match(r"reset\b", st):
            program.resets += bits(st[5:])
            program.events += [Event("reset", (), q, None, condition) for q in bits(st[5:])]
            continue
        name, params, operands = _call(st)
        refs = [bits(x) for x in operands]
        size = max(map(len, refs))
        if any(len(r) not in (1, size) for r in refs):
            raise CircuitError(f"registers of different sizes in {st!r}")
        before = len(gates)
        for i in range(size):
            emit(name, [evaluate(p) for p in params], [r[i] if len(r) > 1 else r[0] for r in refs])
        program.events.append(Event("gates", tuple(gates[before:]), condition=condition))
        if condition:
            del gates[before:]
    if not total:
        raise CircuitError("no qreg")
    program.circuit = parse({"number_of_qubits": total, "gates": gates})
    return program


_OUT = {"U1": "u1", "I": "id", "CU1": "cu1", "C3SQRTX": "c3sqrtx"}


def write(circuit: Circuit, register: str = "q") -> str:
    """OpenQASM 2 text of a circuit whose gates all have a name there (R, CR as phases, RY and the like by angle)."""
    lines = ["OPENQASM 2.0;", 'include "qelib1.inc";', f"qreg {register}[{circuit.n}];"]
    for g in circuit.gates:
        name, params = G.canonical(g.name), g.params
        if name in ("R", "CR"):
            word, values = ("u1" if name == "R" else "cu1"), [2 * math.pi / 2 ** params["k"]]
        elif name == "G":
            word, values = "ry", [2 * math.acos(math.sqrt(1 / params["p"]))]
        elif name == "R1":
            word, values = "u1", [params["theta"]]
        elif name in G.SPECS and not name.endswith("FRAC") and name != "RI":
            word, values = _OUT.get(name, name.lower()), [params[p] for p in G.SPECS[name].params]
        else:
            raise CircuitError(f"{name} has no OpenQASM name")
        args = f"({','.join(repr(float(v)) for v in values)})" if values else ""
        lines.append(f"{word}{args} {','.join(f'{register}[{q}]' for q in g.qubits)};")
    return "\n".join(lines) + "\n"


def write_parts(circuit: Circuit, part_of: list[int]) -> str:
    """The circuit with its parts one after the other, each under a comment."""
    order = sorted(circuit.gates, key=lambda g: (part_of[g.seq], g.seq))
    head, body = write(circuit).split("\n", 3)[:3], write(circuit).split("\n")[3:]
    out, last = list(head), None
    for g in order:
        if part_of[g.seq] != last:
            last = part_of[g.seq]
            out.append(f"// part {last}")
        out.append(body[g.seq])
    return "\n".join(out) + "\n"


# fixed values: method names of a public C++ simulator's interface
_CALLS = {
    "X": "ApplyPauliX", "Y": "ApplyPauliY", "Z": "ApplyPauliZ", "H": "ApplyHadamard", "RX": "ApplyRotationX", "RY": "ApplyRotationY", "RZ": "ApplyRotationZ",
    "CX": "ApplyCPauliX", "CY": "ApplyCPauliY", "CZ": "ApplyCPauliZ", "SWAP": "ApplySwap", "CCX": "ApplyToffoli",
}


def write_calls(circuit: Circuit, target: str = "psi") -> str:
    """The circuit as C++ calls on a register object; gates without a method of their own become 2x2 matrices (custom or controlled custom)."""
    lines = []
    for g in circuit.gates:
        name = G.canonical(g.name)
        if name in _CALLS:
            args = [*map(str, g.qubits), *(repr(float(g.params[p])) for p in G.SPECS[name].params)]
            lines.append(f"{target}.{_CALLS[name]}({','.join(args)});")
            continue
        controls, targets, u = g.parts()
        if len(targets) != 1 or len(controls) > 1:
            raise CircuitError(f"{name} has no call")
        lines.append(f"TM2x2<ComplexDP> G{g.seq};")
        lines += [f"G{g.seq}({r},{c}) = {{{float(u[r, c].real)!r}, {float(u[r, c].imag)!r}}};" for r in range(2) for c in range(2)]
        lines.append(f"{target}.Apply1QubitGate({targets[0]},G{g.seq});" if not controls else f"{target}.ApplyControlled1QubitGate({controls[0]},{targets[0]},G{g.seq});")
    return "\n".join(lines) + "\n"


def listing(circuit: Circuit) -> str:
    """A plain listing: qubit count, then gate, parameters and qubits."""
    lines = [f"qubits {circuit.n}"]
    for g in circuit.gates:
        shown = " ".join(f"{k}={v}" for k, v in sorted(g.params.items()) if k != "U")
        lines.append(f"{g.seq} {g.name} [{shown}] {' '.join(map(str, g.qubits))}")
    return "\n".join(lines) + "\n"


def parts_rows(circuit: Circuit, part_of: list[int]) -> list[tuple[int, str, int]]:
    """Rows (order_id, gate_name, part) of a parts file."""
    return [(g.seq, g.name.lower(), part_of[g.seq]) for g in circuit.gates]


def read_parts(spark, path: str):
    """A parts file (lines ``order_id gate_name part``) as a DataFrame."""
    return spark.read.schema("order_id INT, gate_name STRING, part INT").option("sep", " ").csv(path)


def dot(circuit: Circuit) -> str:
    """The dependency graph in DOT, with an entry and an exit node for every qubit."""
    dag = Dag.build(circuit)
    last = {q: f"in{q}" for q in range(circuit.n)}
    lines = ["digraph circuit {"] + [f'  in{q} [label="q{q}"];' for q in range(circuit.n)]
    for g in circuit.gates:
        lines.append(f'  g{g.seq} [label="{g.name} {",".join(map(str, g.qubits))}"];')
        for q in g.qubits:
            lines.append(f'  {last[q]} -> g{g.seq} [label="q{q}"];')
            last[q] = f"g{g.seq}"
    for q in range(circuit.n):
        lines += [f'  out{q} [label="q{q}"];', f"  {last[q]} -> out{q};"]
    assert len(dag.before) == len(circuit.gates)
    return "\n".join([*lines, "}"]) + "\n"


def from_calls(n: int, calls) -> Circuit:
    """Circuit of (name, parameters, qubits) calls as other toolkits list them; barrier, measure, reset, delay and id are skipped."""
    gates = []
    for name, params, qubits in calls:
        low = name.lower()
        if low in ("barrier", "measure", "reset", "delay", "id"):
            continue
        lib, names = _NAMES.get(low, (low.upper(), None))
        spec = G.spec_of(lib)
        if spec is None:
            raise CircuitError(f"unknown gate {name}")
        names = spec.params if names is None else names
        gates.append({"gate": lib, "qubits": list(qubits), "params": dict(zip(names, params, strict=True))})
    return parse({"number_of_qubits": n, "gates": gates})
