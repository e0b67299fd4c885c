import pytest
from pyspark.sql import functions as F

from ketflow.operators import encode as E
from ketflow.plans import circuit as C
from ketflow.streaming import encode as SE


def test_stream_of_rows_gives_the_batch_state(spark, tmp_path):
    df = spark.range(40).select((F.col("id") % 7).alias("k"), (F.col("id") * 0.5 + 1).alias("w"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = SE.stream_weights(stream, F.col("k"), 3, F.col("w")).writeStream.outputMode("complete").format("memory").queryName("weights").start()
    q.processAllAvailable()
    q.stop()
    got = {r.idx: r.real for r in spark.table("weights").collect()}
    norm = sum(x * x for x in got.values()) ** 0.5
    want = {r.idx: r.real for r in E.amplitude_encode(df, F.col("k"), 3, F.col("w")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] / norm - want[k]) < 1e-12 for k in got)


def test_projection_gates_run_on_streams_and_general_ones_are_refused(spark):
    rows = spark.createDataFrame([(1, 1.0, 0.0), (3, 2.0, 0.0)], "idx long, real double, imag double")
    got = SE.stream_gates(rows, C.of(2, [("X", (0,), {}), ("Z", (1,), {})]).gates)
    assert {r.idx: r.real for r in got.collect()} == {0: 1.0, 2: -2.0}
    with pytest.raises(ValueError):
        SE.stream_gates(rows, C.of(2, [("H", (0,), {})]).gates)
