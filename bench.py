"""Headline queries, one JSON line: seconds of each on BENCH_SF_DIR with local[BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from ketflow import catalog
from ketflow.operators import dense as D
from ketflow.operators import measure as M
from ketflow.plans import circuit as C
from ketflow.plans import generators as gen
from ketflow.session import Session, cut_lineage, spark_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def circuits() -> dict:
    """The published circuits of the baseline, and dense states beyond it."""
    named = {f"ghz_{n}": gen.ghz(n) for n in (3, 10, 12)} | {f"qft_{n}": gen.qft(n) for n in (6, 8)}
    named |= {"dj_10": gen.deutsch_jozsa(10), "graphstate_10": gen.graph_state(10)}
    return named | {f"hwall_{n}": gen.hadamard_wall(n) for n in (4, 8, 12, 16, 20)} | {"ghz_62": gen.ghz(62), "qft_16": gen.qft(16)}


def layers(n: int) -> C.Circuit:
    """The layers of the published dense runs: H on all qubits, T on all, a chain of CNOTs."""
    every = [(g, (q,), {}) for g in "HT" for q in range(n)]
    return C.of(n, every + [("CX", (q, q + 1), {}) for q in range(n - 1)])


def main() -> None:
    spark = spark_session("bench", f"local[{CPUS}]", int(CPUS), **{"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    work = {f"circ_{k}": lambda c=c: M.norm(Session(spark).run(c).state).collect() for k, c in circuits().items()}
    tables = ("enc_lineitem", "enc_qft", "staged_qft", "fused_blocks", "marginal_prob", "overlap", "measure_cdf", "dag_edges", "wal_latest")
    work |= {k: lambda k=k: catalog.QUERIES[k](spark, SF_DIR).agg(F.count("*")).collect() for k in tables}
    work["enc_lineitem_hwall_16"] = lambda: M.norm(Session(spark).run(gen.hadamard_wall(16), catalog.encoded(spark, SF_DIR, "lineitem", 16)).state).collect()
    work |= {f"dense_layers_{n}": lambda n=n: D.norm(D.run(D.zero(spark, n), layers(n), cut=cut_lineage)).collect() for n in (24, 26)}
    work["circ_ghz_3"]()  # starts the JVM's compilers, as the baseline's own runs did
    seconds = {}
    for name, run in work.items():
        began = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
