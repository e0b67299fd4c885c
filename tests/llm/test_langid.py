import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ketflow.llm import langid as L
from ketflow.llm import pieces
from tests.llm import messy

SOUND = {"aa": "ka ki ku ma mi mu ta to".split(), "bb": "sch ung ber ge ver ich ein".split(), "cc": "eau oui ais ent ille".split()}


def corpus(n=300):
    r = random.Random(3)
    out = []
    for i in range(n):
        lang = sorted(SOUND)[i % 3]
        out.append((i, " ".join("".join(r.choice(SOUND[lang]) for _ in range(r.randint(1, 4))) for _ in range(40)), lang))
    return out


def brute(word, lattice, probs):
    s = pieces.SPACE + word
    at = {p: i for i, p in enumerate(lattice.words)}
    a = [np.zeros(probs.shape[1]) for _ in range(len(s) + 1)]
    a[0] += 1
    for j in range(1, len(s) + 1):
        for size in range(1, min(j, lattice.longest) + 1):
            i = at.get(s[j - size : j], len(lattice.words) if size == 1 else None)
            if i is not None:
                a[j] = a[j] + a[j - size] * probs[i]
    return np.log(a[-1])


@pytest.fixture(scope="module")
def tools():
    lattice = L.Lattice()
    probs = np.random.default_rng(0).random((lattice.n + 1, 3))
    probs /= probs[:-1].sum(axis=0)
    probs[-1] = L.UNKNOWN
    return lattice, probs


def test_forward_sums_all_segmentations(tools):
    words = ["government", "the", "schaftlich", "éeauoi", "日本語", "x", "", "a" * 40, "ﬀ"]
    assert np.allclose(L._sweep(*tools, words), [brute(w, *tools) for w in words])
    assert np.isfinite(L._sweep(*tools, ["b" * 5000, "the"])).all()  # scaled, not zero


def test_expected_counts_cover_every_sign(tools):
    lattice, probs = tools
    into = np.zeros_like(probs)
    words = ["the", "zuber", "nterti"]
    L._sweep(lattice, probs, words, (np.ones((3, 3)), into))
    sizes = np.array([*map(len, lattice.words), 1])
    assert np.allclose((into * sizes[:, None]).sum(axis=0), sum(len(w) + 1 for w in words))


def test_held_out_accuracy_and_hard_cases(spark):
    rows = corpus()
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 34", "bb"), (902, rows[0][1], None)], "doc_id bigint, text string, lang string")
    model = L.train(docs, L.learns(F.col("doc_id")))
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs, model).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i][0] == lang for i, lang in held) / len(held) > 0.97
    assert got[900] == ("und", 0.0) and got[901] == ("und", 0.0) and got[902][0] == "aa"
    messy_docs = messy.documents(spark)
    out = L.predict(messy_docs, model)
    assert out.columns == [c for c in messy_docs.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    for r in out.collect():
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not r.text or not any(c.isalpha() for c in r.text))
    assert L.predict(messy.empty(spark), model).count() == 0


def test_all_pieces_of_the_vocabulary_take_part(tools):
    lattice, probs = tools
    usable = [p for p in pieces.vocabulary() if pieces.SPACE not in p[1:]]
    assert lattice.n == len(usable) and lattice.longest == max(map(len, usable)) > 10
    long = next(p[1:] for p in usable if len(p) == lattice.longest and p[0] == pieces.SPACE and p[1:].isalpha())
    alone = probs.copy()
    alone[: lattice.n] = 0
    alone[lattice.words.index(pieces.SPACE + long)] = 1
    assert np.allclose(L._sweep(lattice, alone, [long]), 0)  # the whole word as one piece


def test_posterior_is_the_normalised_product_of_word_likelihoods(tools):
    lattice, probs = tools
    m = L.Model(["a", "b", "c"], probs)
    for text in ("the government of the day", "x y", "Größe und 12 Wörter"):
        logs = sum(brute(w, lattice, probs) for w in L.words_of(text))
        name, score, _ = m.predict([text])
        assert name == [m.languages[int(np.argmax(logs))]] and abs(score[0] - 1 / np.exp(logs - logs.max()).sum()) < 1e-9


def test_texts_that_fit_no_language_are_not_known(spark):
    rows = corpus()
    model = L.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    r = random.Random(5)
    junk = " ".join("".join(r.choice("qxzwvjkpyñþœ") for _ in range(8)) for _ in range(30))
    known = model.predict([*(t for _, t, _ in rows), junk, "zz", None])[2]
    assert all(known[: len(rows)]) and known[len(rows) :] == [False, True, False]


def test_nothing_to_learn(spark):
    docs = messy.documents(spark)
    model = L.train(docs)
    assert {r.lang_pred for r in L.predict(docs, model).collect()} == {"und"}


def test_cache_is_bounded(tools, monkeypatch):
    monkeypatch.setattr(L, "CACHE", 10)
    m = L.Model(["a", "b", "c"], tools[1])
    for k in range(5):
        m.predict([messy.prose(k, 100)])
    assert len(m._rows) < 150
