"""Gates as SQL text over a versioned state table: the same relational algebra, for spark.sql and for cross-checks.

Each statement reads ``state(version, idx, real, imag)`` and gives version + 1; the gate's
matrix is inlined as VALUES.  The dialect works in Spark and DuckDB.
"""

from __future__ import annotations

import numpy as np

from ketflow.functions import gates as G
from ketflow.plans.circuit import Circuit, Gate


def values_of(u: np.ndarray) -> str:
    """(m_row, m_col, m_re, m_im) as a VALUES list, zeros left out."""
    rows = [f"({r}, {c}, CAST({float(u[r, c].real)!r} AS DOUBLE), CAST({float(u[r, c].imag)!r} AS DOUBLE))" for c in range(u.shape[1]) for r in range(u.shape[0]) if abs(u[r, c]) > G.ZERO]
    return "(VALUES " + ", ".join(rows) + ") AS m(m_row, m_col, m_re, m_im)"


def select_sql(u: np.ndarray, qubits: tuple[int, ...], source: str) -> str:
    """SELECT idx, real, imag of a dense operator applied to relation ``source``."""
    sub = " | ".join(f"(((idx >> {q}) & 1) << {i})" for i, q in enumerate(qubits))
    clear = f"(idx & {~sum(1 << q for q in qubits)})"
    put = " | ".join(f"CAST(((m_row >> {i}) & 1) AS BIGINT) * {1 << q}" for i, q in enumerate(qubits))
    return (
        f"SELECT idx2 AS idx, sum(re) AS real, sum(im) AS imag FROM ("
        f"SELECT {clear} | ({put.replace(' | ', ' + ')}) AS idx2, real * m_re - imag * m_im AS re, real * m_im + imag * m_re AS im "
        f"FROM {source} AS s JOIN {values_of(u)} ON m_col = {sub}) AS t GROUP BY idx2"
    )


def gate_sql(gate: Gate, source: str) -> str:
    return select_sql(gate.matrix, gate.qubits, source)


def apply_sql(gate: Gate, version: int, table: str = "state") -> str:
    """SELECT version + 1, idx, real, imag for one gate over the versioned table."""
    return f"SELECT {version + 1} AS version, idx, real, imag FROM ({gate_sql(gate, f'(SELECT idx, real, imag FROM {table} WHERE version = {version})')}) AS g"


def circuit_ctes(circuit: Circuit, start: str, prefix: str = "q") -> tuple[str, str]:
    """(WITH items, name of the last relation): one CTE a gate, from relation ``start``."""
    items, at = [], start
    for g in circuit.gates:
        name = f"{prefix}{g.seq}"
        items.append(f"{name} AS ({gate_sql(g, at)})")
        at = name
    return ", ".join(items), at
