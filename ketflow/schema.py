"""Schemas of the relations: states, gate matrices, circuits, logs and checkpoints."""

from __future__ import annotations

from pyspark.sql import types as T

#: A sparse state: basis index (qubit 0 is bit 0) and complex amplitude.
STATE = T.StructType(
    [
        T.StructField("idx", T.LongType(), False),
        T.StructField("real", T.DoubleType(), False),
        T.StructField("imag", T.DoubleType(), False),
    ]
)

GATE_MATRIX = T.StructType(
    [
        T.StructField("gate_name", T.StringType(), False),
        T.StructField("arity", T.IntegerType(), False),
        T.StructField("row", T.IntegerType(), False),
        T.StructField("col", T.IntegerType(), False),
        T.StructField("real", T.DoubleType(), False),
        T.StructField("imag", T.DoubleType(), False),
    ]
)

_COMPLEX = T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])

CIRCUIT = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("gate", T.StringType(), False),
        T.StructField("qubits", T.ArrayType(T.IntegerType()), False),
        T.StructField("params", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("u", T.ArrayType(_COMPLEX)),
    ]
)

#: Append-only log of steps; the latest record of a wal_id is its state.
WAL = T.StructType(
    [
        T.StructField("wal_id", T.LongType(), False),
        T.StructField("run_id", T.StringType(), False),
        T.StructField("plan_hash", T.StringType(), False),
        T.StructField("step_start", T.IntegerType(), False),
        T.StructField("step_end", T.IntegerType(), False),
        T.StructField("state_version_in", T.IntegerType(), False),
        T.StructField("state_version_out", T.IntegerType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("logged_at", T.TimestampType(), False),
    ]
)

CHECKPOINT = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("plan_hash", T.StringType(), False),
        T.StructField("state_version", T.IntegerType(), False),
        T.StructField("last_step", T.IntegerType(), False),
        T.StructField("state_path", T.StringType(), False),
        T.StructField("checksum", T.StringType()),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

#: Largest width: indices and 2^n both fit a signed 64-bit long.
MAX_QUBITS = 62

#: Amplitudes whose parts are both at most this small are dropped.
EPSILON = 1e-15
