import random
import re
import zlib

import duckdb
import numpy as np
import zstandard

from ketflow.llm import toxicity as T
from tests.llm import messy

BAD = ["grumblefrotz", "zortwangle", "snorkblat", "quibbermunge"]


def corpus(n=600, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = messy.prose(1000 + i, 80).split()
        y = int(i % 4 == 0)
        if y:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        out.append((i, " ".join(w), y))
    return out


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = messy.documents(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(0, 1, None), (4, 0, 0)], "doc_id bigint, quality int, toxic int")
    from pyspark.sql import functions as F

    model = T.train(docs, labels, T.learns(F.col("doc_id")))
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i] >= T.THRESHOLD) == bool(y) for i, y in held)
    assert right / len(held) > 0.97 and all(0 <= s <= 1 for s in got.values())
    assert T.train(docs, labels, T.learns(F.col("doc_id"))).toxic == model.toxic  # the same rows give the same model


def test_hard_cases(spark):
    rows = corpus(200)
    model = T.fit([t for _, t, _ in rows], [y for *_, y in rows], 50, 150)
    docs = messy.documents(spark)
    scored = T.score(docs, model)
    assert scored.columns == [c for c in docs.columns if c != "score"] + ["score"]
    got = scored.collect()
    assert len(got) == len(messy.rows()) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.text is None or not r.text.strip()}) == 1
    assert T.score(messy.empty(spark), model).count() == 0
    long = messy.LONG + " " + " ".join(BAD)
    assert model.score(long) > model.score(messy.LONG)  # the last words of a long text count


def test_without_labels_of_a_class(spark):
    docs = messy.documents(spark)
    for data in ([], [(1, 1, 0), (2, 1, 0)], [(1, 1, 1)]):
        model = T.train(docs, spark.createDataFrame(data, "doc_id bigint, quality int, toxic int"))
        assert {r.score for r in T.score(docs, model).collect()} == {0.0}


def test_calibration_is_monotone():
    rows = corpus(300)
    model = T.fit([t for _, t, _ in rows], [y for *_, y in rows], 75, 225)
    assert (model.score_of[1:] >= model.score_of[:-1]).all()


def test_distance_and_calibration_are_those_of_the_definition():
    rows = corpus(300)
    model = T.fit([t for _, t, _ in rows], [y for *_, y in rows], 75, 225)

    def length(window, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=T._PARAMS).compress(model.ordinary[-T.CARRIER :] + window))

    for _, t, _ in [*rows[:12], (0, "few words", 0), (0, "", 0), (0, None, 0)]:
        w = [x.encode() for x in re.sub("[^a-z0-9]", " ", (t or "").lower()).split()]
        windows = [b" " + b" ".join(w[k : k + T.WINDOW]) + b" " for k in range(0, len(w), T.WINDOW)]
        savings = sorted((max(0, length(x, model.ordinary) - length(x, model.toxic + model.ordinary)) for x in windows), reverse=True)
        assert model.distance(t) == sum(savings[: T.TOP])
        assert model.score(t) == model.score_of[min(sum(savings[: T.TOP]), T.LEVELS - 1)]
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 9, 200), rng.integers(0, 2, 200)
    got = T._isotonic(x, y, np.ones(200), 9)
    pos, n = np.bincount(x, y, 9), np.bincount(x, minlength=9).astype(float)
    n[0], pos[-1], n[-1] = n[0] + 0.5, pos[-1] + 0.5, n[-1] + 0.5
    mean = lambda a, b: pos[a : b + 1].sum() / n[a : b + 1].sum()
    assert np.allclose(got, [max(min(mean(a, b) for b in range(k, 9)) for a in range(k + 1)) for k in range(9)])


def test_held_out_accuracy_on_the_tables():
    """The figure of the README; half of the toxic labels there stand on texts without a trace of them."""
    docs = duckdb.sql("select l.doc_id, text, toxic from '/root/testdata/sf0.1/labels.parquet' l join '/root/testdata/sf0.1/documents.parquet' using (doc_id) where toxic is not null order by hash(l.doc_id)").fetchall()
    learn = [r for r in docs if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    held = [r for r in docs if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    model = T.fit([r[1] for r in learn], [r[2] for r in learn], sum(r[2] for r in learn), sum(1 - r[2] for r in learn))
    right = sum((model.score(t) >= T.THRESHOLD) == bool(y) for _, t, y in held)
    assert right / len(held) > 0.94 and len(set(model.score_of.tolist())) > 2


def test_one_ordinary_text_does_not_veto_a_gram():
    toxic = [b" some words and a grumblefrotz here "] * 30
    ordinary = [b" some words and others here "] * 299 + [b" he wrote grumblefrotz "]
    assert b"mblef" in T.telling_grams(toxic, ordinary) and b" some" not in T.telling_grams(toxic, ordinary)
