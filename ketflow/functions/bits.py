"""Bit expressions over long columns; everything is 64-bit and stays in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def long_lit(value: int) -> Column:
    return F.lit(value).cast("long")


def shift_right(col: Column, by: int) -> Column:
    return F.shiftright(col.cast("long"), by)


def shift_left(col: Column, by: int) -> Column:
    return F.shiftleft(col.cast("long"), by)


def bit(col: Column, q: int) -> Column:
    """Bit ``q`` of the column, 0 or 1."""
    return shift_right(col, q).bitwiseAND(long_lit(1))


def bit_or(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), cols) if cols else long_lit(0)


def mask_of(qubits) -> int:
    return sum(1 << q for q in qubits)


def pattern(col: Column, qubits) -> Column:
    """The bits at ``qubits`` gathered into a small number; qubits[0] is its bit 0."""
    qubits = list(qubits)
    if qubits == list(range(qubits[0], qubits[0] + len(qubits))):
        return shift_right(col, qubits[0]).bitwiseAND(long_lit((1 << len(qubits)) - 1))
    return bit_or([shift_left(bit(col, q), i) if i else bit(col, q) for i, q in enumerate(qubits)])


def scatter(value: int, qubits) -> int:
    """Inverse of ``pattern`` at plan time: the bits of ``value`` put at ``qubits``."""
    return sum(1 << q for i, q in enumerate(qubits) if value >> i & 1)


def clear(col: Column, qubits) -> Column:
    return col.bitwiseAND(long_lit(~mask_of(qubits)))


def all_set(col: Column, qubits) -> Column:
    """True where every bit at ``qubits`` is 1."""
    m = mask_of(qubits)
    return col.bitwiseAND(long_lit(m)) == long_lit(m)


def permute(col: Column, log_to_phys: list[int]) -> Column:
    """Index with bit ``log_to_phys[q]`` moved to bit ``q``; runs that move together take one shift."""
    parts, q = [], 0
    while q < len(log_to_phys):
        end = q + 1
        while end < len(log_to_phys) and log_to_phys[end] == log_to_phys[end - 1] + 1:
            end += 1
        run = shift_right(col, log_to_phys[q]).bitwiseAND(long_lit((1 << (end - q)) - 1))
        parts.append(shift_left(run, q) if q else run)
        q = end
    return bit_or(parts)
