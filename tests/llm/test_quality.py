import re
from collections import Counter

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ketflow.llm import quality as Q
from tests.llm import messy

SPACE = re.compile("[\x20\x09-\x0d]+")


def brute(text):
    t = text or ""
    w = [x for x in SPACE.split(t) if x]
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(win)
    covered = {i + k for i, x in enumerate(win) if c[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if SPACE.sub("", x)]
    n = len(w)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(covered), failed


def check(spark, data):
    got = Q.score(messy.documents(spark, data)).collect()
    assert len(got) == len(data)
    have = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert have == sorted((str(i), *brute(t)) for i, t in data)
    assert all(not r.kept for r in got if r.base_failed)
    return got


def test_hard_cases(spark):
    check(spark, messy.rows())
    assert Q.score(messy.empty(spark)).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b", "#", " ", "\n", "é", "\t", "cc"]), max_size=120).map("".join), min_size=1, max_size=20))
def test_against_brute_force(spark, texts):
    check(spark, list(enumerate(texts)))


def test_rules_decide(spark):
    good = messy.prose(5, 200)
    data = [(0, good), (1, " ".join(w + "###" for w in good.split())), (2, " | ".join(good.split())), (3, "\n".join([good] * 4))]
    assert {r.doc_id: r.kept for r in Q.score(messy.documents(spark, data)).collect()} == {0: True, 1: False, 2: False, 3: False}
    strict = (("mean_word_chars", 100.0, None),)
    assert not any(r.kept for r in Q.score(messy.documents(spark, data), strict).collect())


def test_plan_is_one_projection(spark):
    plan = Q.score(messy.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = {tuple(map(str, r)) for r in con.execute(Q.oracle()).fetchall()}
    assert {tuple(map(str, r)) for r in Q.score(spark.read.parquet(f"{sf}/documents.parquet")).collect()} == want
