import hashlib
import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ketflow.llm import segment as S
from tests.llm import messy


@pytest.fixture(scope="module")
def codec():
    return S.codec()


def every(codec, chunk):
    form, out = codec.marked(chunk), []

    def back(end, score, ids):
        if end == 0:
            out.append((score, ids))
            return
        for a, s, i in codec._arcs(form, end, chunk):
            back(a, score + s, i + ids)

    back(len(form), 0.0, ())
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("chunk", [" the", " hello", "日本", " thnterti", "é", "▁", "", " a", "  x", " ", "\n"])
def test_nbest_of_a_chunk(codec, chunk):
    want, got = every(codec, chunk)[:6], codec.nbest_chunk(chunk, 6)
    assert np.allclose([s for s, _ in got], [s for s, _ in want]) and len({i for _, i in got}) == len(got)


TEXT = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "▁", "é", "日", "😀", "zu", ",", "", "x"]), max_size=7).map("".join)


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_nbest_of_a_text_and_round_trip(text):
    codec = S.codec()
    n = codec.nbest(text, 5)
    assert all(codec.decode(ids) == text for _, ids in n)
    per = [every(codec, c)[:5] for c in codec.chunks(text)]
    want = sorted((sum(x[0] for x in combo) / S.UNIT for combo in itertools.product(*per)), reverse=True)[:5] if per else [0.0]
    assert np.allclose([s for s, _ in n], want)
    assert len({tuple(i) for _, i in n}) == len(n)
    ids, scores = codec.encode_batch([text], 5)[0]
    assert np.allclose(scores, want) and np.isclose(sum_of(codec, text, np.frombuffer(ids, np.int32).tolist()), want[0])


def sum_of(codec, text, ids):
    by = {i: codec.score[p] for p, i in codec.ids.items()} | dict.fromkeys(codec.byte_ids, codec.byte_score)
    return sum(by[i] for i in ids) / S.UNIT


def test_hard_cases(spark):
    data = messy.rows()
    got = S.round_trip(messy.documents(spark)).collect()
    assert len(got) == len(data) and all(r.round_trip for r in got)
    by = {str(r.doc_id): r for r in got}
    assert by["0"].n_pieces == 0 and by["1"].scores == [0.0]
    assert by["1"].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert S.round_trip(messy.empty(spark)).count() == 0


def test_encode_and_decode_tables(spark):
    docs = messy.documents(spark)
    encoded = S.encode(docs)
    back = S.decode(encoded)
    assert encoded.columns[: len(docs.columns)] == docs.columns
    for r in back.collect():
        assert r.decoded == r.text and (r.ids is None) == (r.text is None)
