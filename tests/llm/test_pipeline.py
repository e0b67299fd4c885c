import duckdb

import __spark_entry__ as entry
import corpus_pipeline as P
from ketflow.llm import decontam
from tests.llm import messy

SF = "/root/testdata/sf0.001"


def test_stages_filter_rows_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id: r.text for r in docs.collect()}
    sizes = []
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == before.columns
        kept = [r.doc_id for r in docs.collect()]
        assert set(kept) <= {r.doc_id for r in before.collect()} and len(set(kept)) == len(kept), name
        sizes.append(len(kept))
    assert sizes[-1] > 0.5 * len(ids)
    texts = [ids[i] for i in kept]
    assert len(set(texts)) == len(texts)  # exact copies are gone
    index = decontam.Index([(str(i), decontam.words_of(t.encode())) for i, t in duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()])
    index.choose_prefixes(index.counts)
    assert not any(index.match(t.encode())[2] for t in texts)
    last = P.STAGES[-1][1](spark, docs, SF)
    assert last.filter("round_trip").count() == len(kept)


def test_run_equals_the_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(str, P.run(spark, SF).collect())) == sorted(map(str, docs.collect()))


def test_empty_and_odd_tables_pass(spark):
    for docs in (messy.empty(spark), messy.documents(spark)):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.collect()


def test_registered():
    assert 4 <= len(P.STAGES) <= 5
    names = [n for n in entry.queries() if n.startswith("op")]
    assert len(names) == 10 and "pipeline" in entry.queries()
