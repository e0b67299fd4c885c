import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ketflow.llm import lm
from tests.llm import messy


def brute(data, order, min_count=2, alpha=0.4):
    texts = [[w.decode() for w in lm.tokens_of(None if t is None else t.encode())] for _, t in data]
    counts = Counter(tuple(t[i : i + k]) for t in texts for k in range(1, order + 1) for i in range(len(t) - k + 1))
    total = sum(map(len, texts))

    def score(gram):
        if len(gram) == 1:
            return math.log(counts[gram] / total), 0
        if counts[gram] >= min_count:
            return math.log(counts[gram] / counts[gram[:-1]]), 0
        s, b = score(gram[1:])
        return s + math.log(alpha), b + 1

    out = []
    for (i, _), t in zip(data, texts, strict=True):
        got = [score(tuple(t[max(0, k - order + 1) : k + 1])) for k in range(len(t))]
        out.append((str(i), len(t), sum(b for _, b in got), round(sum(s for s, _ in got), 4)))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(lm, "RANGE_NGRAMS", 5000)  # several hash ranges
    data = messy.rows()
    got = sorted((str(r.doc_id), r.n_tokens, r.n_backoff, round(r.log_score, 4)) for r in lm.score(messy.documents(spark), order).collect())
    for a, b in zip(got, brute(data, order), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-3
    assert lm.score(messy.empty(spark), order).count() == 0


def test_blocks_do_not_change_the_scores(spark, monkeypatch):
    docs = messy.documents(spark)
    want = sorted((str(r.doc_id), round(r.log_score, 6)) for r in lm.score(docs).collect())
    table = lm.blocks(docs, block_tokens=50)
    assert table.count() > 10
    real = lm.blocks
    monkeypatch.setattr(lm, "blocks", lambda d, **k: real(d, 50, **k))
    assert sorted((str(r.doc_id), round(r.log_score, 6)) for r in lm.score(docs).collect()) == want


def test_packing():
    rng = np.random.default_rng(0)
    for values in (np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64)), rng.integers(0, 2**64, 50, dtype=np.uint64), np.empty(0, np.uint64), rng.integers(-5, 10**6, 99).astype(np.int32), np.array([7], np.int64)):
        assert (lm.unpack(lm.pack(values), values.dtype) == values).all()


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = lm.score(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "n_tokens", "n_backoff", F.round("log_score", 4) + 0.0, F.round("mean_log_score", 6) + 0.0)
    assert {tuple(map(str, r)) for r in got.collect()} == {tuple(map(str, r)) for r in con.execute(lm.oracle()).fetchall()}
