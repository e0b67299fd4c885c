"""Dense states in equal chunks: block rows, a validated manifest, and import of raw complex64 files."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ketflow.schema import MAX_QUBITS
from ketflow.sources.store import Files


def manifest(n_qubits: int, chunk_size: int, chunks: list[str], dtype: str = "complex64") -> dict:
    return check_manifest({"n_qubits": n_qubits, "chunk_size": chunk_size, "n_chunks": len(chunks), "dtype": dtype, "chunks": chunks, "created": time.time()})


def check_manifest(m: dict) -> dict:
    """``ValueError`` unless chunk_size x n_chunks is 2^n, the chunks are as many and complex64."""
    for key in ("n_qubits", "chunk_size", "n_chunks", "dtype", "chunks"):
        if key not in m:
            raise ValueError(f"the manifest lacks {key}")
    if not 1 <= m["n_qubits"] <= MAX_QUBITS or m["chunk_size"] * m["n_chunks"] != 1 << m["n_qubits"]:
        raise ValueError("chunk_size times n_chunks must be 2^n_qubits")
    if len(m["chunks"]) != m["n_chunks"]:
        raise ValueError("the number of chunks differs from n_chunks")
    if m["dtype"] != "complex64":
        raise ValueError("dtype must be complex64")
    return m


def write_manifest(spark: SparkSession, path: str, m: dict) -> None:
    files = Files(spark)
    files.delete(path)
    files.create(path, json.dumps(check_manifest(m)))


def read_manifest(spark: SparkSession, path: str) -> dict:
    return check_manifest(json.loads(Files(spark).text(path)))


def zero_blocks(spark: SparkSession, n: int, chunk_size: int) -> DataFrame:
    """(chunk, real, imag): the dense |0...0> as one row of arrays a chunk."""
    if (1 << n) % chunk_size:
        raise ValueError("chunk_size must divide 2^n")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), chunk_size)
    one = F.concat(F.array(F.lit(1.0).cast("float")), F.array_repeat(F.lit(0.0).cast("float"), chunk_size - 1))
    return spark.range((1 << n) // chunk_size).select(F.col("id").alias("chunk"), F.when(F.col("id") == 0, one).otherwise(zeros).alias("real"), zeros.alias("imag"))


def to_blocks(state: DataFrame, n: int, chunk_size: int) -> DataFrame:
    """Sparse rows -> dense block rows; each chunk is built from its own rows only."""
    if (1 << n) % chunk_size or chunk_size & (chunk_size - 1):
        raise ValueError("chunk_size must be a power of two that divides 2^n")
    rows = state.filter(F.col("idx") < (1 << n)).select(F.floor(F.col("idx") / chunk_size).cast("long").alias("chunk"), F.struct((F.col("idx") % chunk_size).cast("int").alias("at"), "real", "imag").alias("e"))
    held = rows.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("e.at", "e"))).alias("m"))
    every = state.sparkSession.range((1 << n) // chunk_size).withColumnRenamed("id", "chunk")
    fill = lambda part: F.transform(F.sequence(F.lit(0), F.lit(chunk_size - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i)[part], F.lit(0.0)).cast("float"))
    return every.join(held, "chunk", "left").select("chunk", fill("real").alias("real"), fill("imag").alias("imag"))


def from_blocks(blocks: DataFrame, chunk_size: int) -> DataFrame:
    """Dense block rows -> sparse rows, zeros left out."""
    entries = blocks.select("chunk", F.posexplode(F.arrays_zip("real", "imag")).alias("at", "e"))
    rows = entries.select((F.col("chunk") * chunk_size + F.col("at")).alias("idx"), F.col("e.real").cast("double").alias("real"), F.col("e.imag").cast("double").alias("imag"))
    return rows.filter("real <> 0 OR imag <> 0")


def read_raw(spark: SparkSession, folder: str, chunk_size: int) -> DataFrame:
    """Import raw little-endian complex64 files named ``chunk_<number>.bin`` as a sparse state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                number = int("".join(c for c in path.rsplit("/", 1)[-1] if c.isdigit()))
                z = np.frombuffer(content, "<c8")
                at = np.flatnonzero(z)
                yield pa.RecordBatch.from_arrays([pa.array(number * chunk_size + at, pa.int64()), pa.array(z.real[at].astype(float)), pa.array(z.imag[at].astype(float))], names=["idx", "real", "imag"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "content").mapInArrow(run, "idx bigint, real double, imag double")
