"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: U+0020 and U+0009..U+000D.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Whether a query's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, a local session, as in tests, gets a local folder; on a cluster that
    would lose data, so there it is an error.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not jdir.isDefined() and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        got = jdir.get() if jdir.isDefined() else f"file:///tmp/ketflow-checkpoints-{os.getuid()}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(got)
    return got


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that the result survives a lost executor and is not
    computed again; columnar and compressed, unlike an RDD checkpoint.  The shuffle files
    of the job are deleted when it has ended: nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/ketflow-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._ketflow_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and that nothing reads any more."""
    jvm, sc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(df._ketflow_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def crc32_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def split_words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of ``text``; null gives an empty array."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS[1:], " " * (len(SPACE_CHARS) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code once per context: they need not share the driver's folders."""
    sc = spark.sparkContext
    if getattr(sc, "_ketflow_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="ketflow-")) / "ketflow_code.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in [root / "__init__.py", *sorted((root / "llm").glob("*.py"))]:
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(at))
    sc._ketflow_shipped = True


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with this package's code at hand on the executors.

    Columns are passed by place under plain names, as ``mapInArrow`` cannot take names with dots.
    """
    ship(df.sparkSession)
    owner = fn.__module__

    def run(batches):
        take_over(owner)
        yield from fn(batches)
        give_back()

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)


#: The module whose tasks this Python worker runs, and what empties the caches that modules keep between tasks.
_owner: str | None = None
CACHES: list = []


def take_over(owner: str) -> None:
    """Workers outlive tasks: the first task of another operator drops the caches of the one before."""
    global _owner
    if _owner not in (None, owner):
        for clear in CACHES:
            clear()
        gc.collect()
        give_back()
    _owner = owner


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns by quoted name, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def extended(df: DataFrame, **new: str) -> tuple[DataFrame, object]:
    """(df without columns of the new names, its schema with the new columns, types as DDL, at the end).

    A column that has the name of an operator's output is replaced by it.
    """
    base = df.drop(*new)
    return base, base.select(*columns_of(base), *[F.lit(None).cast(t).alias(n) for n, t in new.items()]).schema


def salted_join(many: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join with rows of ``one`` that are unique by ``key``; rows of ``many`` that share a key are spread over ``salts`` tasks by column ``by``."""
    if salts == 1:
        return many.join(one, key, how)
    left = many.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "__salt"], how).drop("__salt")
