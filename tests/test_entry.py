import duckdb
import pytest

import __spark_entry__ as entry
from ketflow import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.ORACLES) == set(catalog.QUERIES)


@pytest.mark.parametrize("name", ["enc_events", "enc_vector", "gate_h", "gate_cu", "gate_rc3x", "gate_rxx", "circ_qpe", "circ_w", "staged_mixed", "staged_exact", "nonlocal_2q", "qasm_program", "project_renorm", "reset_qubit", "measured_program", "merged_parts", "partition_spread", "matched_gates", "dag_edges", "dense_kernels", "dense_kernels_unfused", "measure_sample", "measure_cdf", "max_diff", "dense_blocks", "dag_all_edges", "partition_overlap", "wal_latest", "wal_pending_after_checkpoint", "store_parquet", "store_csv", "store_versions", "store_chunks", "store_zero_chunks", "durable_resumed", "durable_log", "durable_pending", "durable_checkpoints", "durable_recovered", "sql_path", "sql_path_20"])
def test_against_duckdb(spark, duck, name):
    want = duck.execute(catalog.ORACLES[name]).fetch_df()
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(want)
