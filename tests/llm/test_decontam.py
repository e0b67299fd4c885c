import hashlib
import random
import re

import duckdb
import numpy as np

from ketflow.llm import decontam as D
from tests.llm import messy

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w = words(text)
    hit, ids = set(), set()
    for item, t in items:
        v = words(t)
        if not v:
            continue
        n = min(10, len(v))
        for s in range(len(v) - n + 1):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == v[s : s + n]:
                    hit.update(range(at, at + n))
                    ids.add("" if item is None else str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_against_brute_force(spark):
    passage = messy.prose(21, 40)
    items = [(1, passage), (10, messy.prose(22, 12)), (2, "short one"), (3, "single"), (4, None), (5, "..."), (1, messy.prose(23, 15)), (None, messy.prose(24, 11)), (6, "la " * 15), (7, passage.upper())]
    docs = [
        *[x for x in messy.rows() if x[1] not in (messy.LONG, messy.ONE_WORD)],
        (50, messy.prose(30, 20) + " " + " ".join(passage.split()[5:22]) + " end"),
        (51, passage + " " + passage), (52, "A Short-ONE; and single?"), (53, " ".join(passage.split()[5:14])), (54, messy.prose(24, 11)),
    ]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted((str(i), *brute(t, items)) for i, t in docs)
    for block in (D.BLOCK_WORDS, 13):
        found = D.matches(messy.documents(spark, docs).drop("found"), bench, block_words=block)
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.digest(found).collect())
        assert got == want
    assert D.matches(messy.documents(spark, docs), bench, out="__f").columns[-1] == "__f"


def test_empty_tables_and_long_texts(spark):
    bench = spark.createDataFrame([(1, messy.LONG[1000:3000])], "item_id bigint, text string")
    assert D.digest(D.matches(messy.empty(spark).drop("found"), bench)).count() == 0
    got = D.digest(D.matches(messy.documents(spark, [(1, messy.LONG), (2, messy.ONE_WORD)]).drop("found"), bench)).collect()
    assert [r.contaminated for r in sorted(got, key=lambda r: r.doc_id)] == [True, False]
    none = D.digest(D.matches(messy.documents(spark).drop("found"), bench.limit(0))).collect()
    assert not any(r.contaminated for r in none) and len(none) == len(messy.rows())


def index_of(items, **k):
    return D.Index(list(D.pieces_of(items, **k)))


def test_prefix_is_the_rarest_shingle():
    index = index_of([("a", b"the of the of the rare of the of the")])
    counts = index.counts.copy()
    for t in [b"the of the of the of the of the of"] * 5 + [b"the rare of"]:
        index.count(t, counts)
    index.choose_prefixes(counts)
    (number,) = np.flatnonzero(np.diff(index.prefix_from))
    assert counts[number] <= counts.min() and index.prefix_window.tolist() == [0]


def test_a_long_item_is_cut_and_its_index_is_bounded():
    words = [f"w{i % 70000}" for i in range(1_600_000)]  # about 10 MB
    item = " ".join(words).encode()
    pieces = list(D.pieces_of([("big", item)]))
    assert len(pieces) == 7 and max(len(w) for _, w in pieces) <= D.BLOCK_WORDS
    assert sum(len(w) - D.WINDOW + 1 for _, w in pieces) == len(words) - D.WINDOW + 1  # every window once
    index = D.Index(pieces[:1])
    assert index.nbytes <= 110 * D.BLOCK_WORDS
    index.choose_prefixes(index.counts)
    n, hit, items = index.match(" ".join(["x", *words[100:150], "y"]).encode())
    assert (n, hit.sum(), items) == (52, 50, ["big"])


def test_an_empty_block():
    index = index_of([("a", None), ("b", b"...")])
    index.choose_prefixes(index.counts)
    assert index.match(b"some words")[0] == 2 and not index.match(b"some words")[1].any()


def test_random_texts(spark):
    r = random.Random(9)
    small = ["a", "b", "c"]
    items = [(k, " ".join(r.choice(small) for _ in range(r.choice([2, 5, 10, 13])))) for k in range(6)]
    docs = [(k, " ".join(r.choice(small) for _ in range(60))) for k in range(20)]
    found = D.digest(D.matches(messy.documents(spark, docs).drop("found"), spark.createDataFrame(items, "item_id bigint, text string"), window=10))
    assert sorted((str(x.doc_id), x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in found.collect()) == sorted((str(i), *brute(t, items)) for i, t in docs)


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = D.digest(D.matches(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")))
    assert {tuple(map(str, r)) for r in got.collect()} == {tuple(map(str, r)) for r in con.execute(D.oracle()).fetchall()}
