import random
import re

import numpy as np
import pytest
import xxhash

from ketflow.llm import graph
from ketflow.llm import simhash as S
from ketflow.llm.graph import components
from tests.llm import messy


def brute_fp(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_classes(spark):
    data = messy.rows()
    got = S.classes(messy.documents(spark)).collect()
    assert len(got) == len(data)
    fps = [brute_fp(t) for _, t in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                parent[find(a)] = find(b)
    want = []
    for k, (i, _) in enumerate(data):
        ids = [data[m][0] for m in range(len(data)) if find(m) == find(k) and data[m][0] is not None]
        want.append((str(i), fps[k], str(min(ids, default=None))))
    assert sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in got) == sorted(want)
    assert S.classes(messy.empty(spark)).count() == 0


@pytest.mark.parametrize("bucket", [S.BUCKET, 40])
def test_no_link_is_lost(spark, bucket, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", bucket)  # 40: buckets in parts
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = list(dict.fromkeys([*base, *(b ^ sum(1 << x for x in r.sample(range(64), r.randint(1, 5))) for b in base for _ in range(6)), 0, 2**64 - 1]))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = S.links(spark.createDataFrame([(x, x) for x in signed], "node bigint, w0 bigint"))
    label = {x.node: x.label for x in components(edges).collect()}
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                assert label[signed[a]] == label[signed[b]]
    for x in edges.collect():
        assert ((x.a ^ x.b) % 2**64).bit_count() <= 64


def test_a_bucket_of_many_is_cut_and_loses_no_link(spark):
    rng = np.random.default_rng(6)  # 50,000 fingerprints that all agree on the lowest 16 bits, in pairs within 3 bits
    base = np.unique(rng.integers(0, 2**48, 25_000).astype(np.uint64)) << np.uint64(16)
    near = base ^ (np.uint64(1) << rng.integers(16, 64, len(base)).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near])).view(np.int64)
    edges = S.links(spark.createDataFrame([(x, x) for x in fps.tolist()], "node bigint, w0 bigint"))
    label = {x.node: x.label for x in components(edges).collect()}
    assert all(label[a] == label[b] for a, b in zip(base.view(np.int64).tolist(), near.view(np.int64).tolist(), strict=True))


def test_hot_keys_are_linked_before_the_shuffle():
    rng = np.random.default_rng(3)
    n = rng.integers(50, 400, 500)
    prefixes = [np.array([7, 1000 + i], np.int64) for i in range(500)]  # key 7 is in all
    rows, edges = S._spread(np.arange(500), n, prefixes, 0.8)
    ends = rows[:, rows[0] == 7]
    assert ends.shape[1] < 20 and (ends[3] == -1).all() and rows.shape[1] == 500 + ends.shape[1]
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in [*edges.tolist(), *S._stars_of_runs(ends[0], ends[1], ends[2], 0.8).tolist()]:
        parent[find(a)] = find(b)
    order = np.argsort(n, kind="stable")
    for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):  # a component ends where sizes are too far apart
        assert (find(a) == find(b)) == (n[a] >= 0.8 * n[b])
    for a in range(500):
        for b in range(a):
            if min(n[a], n[b]) >= 0.8 * max(n[a], n[b]):
                assert find(a) == find(b)


def test_bk_tree_finds_the_brute_force_set():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, (300, 1)).astype(np.uint64)
    items[150:] = items[:150] ^ (np.uint64(1) << rng.integers(0, 60, (150, 1)).astype(np.uint64))
    items = np.unique(items, axis=0)
    got = {(i, j) for i, near in S.BKTree(items).matches(items, 3) for j in near.tolist()}
    d = np.bitwise_count(items ^ items.T)
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(d <= 3)), strict=True))
    assert list(S.BKTree(items[:0]).matches(items, 3)) == []


def test_large_clusters_join_without_all_pairs():
    rng = np.random.default_rng(2)
    one = rng.integers(0, 2**63, 1).astype(np.uint64)
    near = np.unique(one ^ (np.uint64(1) << rng.integers(0, 63, 2000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 2000).astype(np.uint64)))[:, None]
    nodes = np.arange(len(near))
    stars = S._stars(nodes, near, 3)
    assert len(stars) == len(nodes) - 1 and {r for _, r in stars} == {0}


@pytest.mark.parametrize("salt_from", [0, 1 << 20])
def test_components(spark, salt_from, monkeypatch):
    monkeypatch.setattr(graph, "SALT_FROM", salt_from)
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (200, 201), (200, 201)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(51)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and got[201] == 200
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_shingle_sets_differ_as_the_shingles_do():
    texts = [t.encode() if t else None for _, t in messy.rows() if t is None or len(t) < 50_000] + [b"a b c d e f", b"b c d e f", b"a b c d", b"A  B c\nd"]
    sets = list(S.shingle_sets(texts, 5))
    plain = []
    for t in texts:
        w = (t or b"").lower().split()
        plain.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    seen = dict(zip([x for p in plain for x in sorted(p)], [None] * 10**6, strict=False))
    assert [len(x) for x in sets] == [len(p) for p in plain] and len(np.unique(np.concatenate(sets))) == len(seen)
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j])


def test_keep_one(spark):
    base = messy.prose(7, 300).split()
    edited = [*base]
    edited[100] = "different"
    far = messy.prose(8, 300)
    data = [(5, " ".join(base)), (3, " ".join(edited)), (9, " ".join(base)), (9, " ".join(base)), (7, far), (None, far), (8, None), (6, ""), (11, "")]
    kept = S.keep_one(messy.documents(spark, data))
    assert kept.columns == messy.documents(spark, data).columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 6, 7]
    assert S.keep_one(messy.empty(spark)).count() == 0


def test_keep_one_keeps_unlike_texts_that_share_a_repeated_line(spark):
    line = " ".join(f"common{k}" for k in range(10))
    data = [(i, " ".join([*(f"own{i}x{k}" for k in range(1000)), *[line] * 50])) for i in range(6)]
    assert sorted(r.doc_id for r in S.keep_one(messy.documents(spark, data)).collect()) == list(range(6))


def test_a_large_group_of_near_copies_leaves_one(spark):
    r = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    data = []
    for k in range(1500):
        words = [*base]
        for i in r.sample(range(200), r.randint(0, 4)):
            words[i] = f"e{k}x{i}"
        data.append((k, " ".join(words)))
    data += [(5000 + k, messy.prose(500 + k, 60)) for k in range(20)] + [(k, data[0][1]) for k in range(3000, 3400)]
    assert sorted(x.doc_id for x in S.keep_one(messy.documents(spark, data)).collect()) == [0, *range(5000, 5020)]


def test_keep_one_equals_brute_force_near_the_limit_and_in_a_large_group(spark):
    r = random.Random(11)
    data = []
    for k in range(60):  # 96 shingles, of which 10 or 11 are lost: similarity 86/106 = 0.811 or 85/107 = 0.794
        words = [f"w{k}x{i}" for i in range(100)]
        data += [(3 * k, " ".join(words)), (3 * k + 1, " ".join([*words[:90], *(f"y{k}x{i}" for i in range(10))])), (3 * k + 2, " ".join([*(f"z{k}x{i}" for i in range(11)), *words[11:]]))]
    for k in range(300):  # more than a tile, most of its pairs less similar than 0.8
        words = [f"g{i}" for i in range(150)]
        for i in r.sample(range(150), r.randint(1, 8)):
            words[i] = f"e{k}x{i}"
        data.append((1000 + k, " ".join(words)))
    sets = [set(S.shingle_hashes(t.encode(), 5).tolist()) for _, t in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = [data[a][0] for a in range(len(data)) if find(a) == a]
    assert sum(i < 1000 for i in want) == 120 and 1 < sum(i >= 1000 for i in want) < 299
    assert sorted(x.doc_id for x in S.keep_one(messy.documents(spark, data)).collect()) == want


def test_set_fingerprints_and_bucket_stars_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 4, 5, 300, 700)]
    for x in sets:
        for k, word in enumerate(np.frombuffer(S.set_fingerprint(x), ">u8").tolist()):
            h = S._mixed(x, k + 1).tolist()
            assert word == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    fps = rng.integers(0, 2**63, (900, S.WORDS)).astype(np.uint64)
    for i in range(1, 900, 2):  # every other one near to the one before it, some just out of the radius
        flip = rng.permutation(64 * S.WORDS)[: rng.integers(S.RADIUS - 8, S.RADIUS + 8)]
        fps[i] = fps[i - 1] ^ np.packbits(np.isin(np.arange(64 * S.WORDS), flip)).view(np.uint64)
    key = np.sort(rng.integers(0, 150, 450)).repeat(2)  # pairs stay together
    label = {int(x): int(x) for x in range(900)}
    for a, b in S._bucket_stars(key, np.arange(900), fps, S.RADIUS).tolist():
        old, new = label[a], label[b]
        label = {x: new if y == old else y for x, y in label.items()}
    want = list(range(900))
    for a in range(900):
        for b in range(a):
            if key[a] == key[b] and np.bitwise_count(fps[a] ^ fps[b]).sum() <= S.RADIUS and want[a] != want[b]:
                want = [want[b] if x == want[a] else x for x in want]
    groups = lambda of: {frozenset(x for x in range(900) if of[x] == y) for y in set(of[x] for x in range(900))}
    assert groups(label) == groups(want) and len(set(want)) > 500


@pytest.mark.parametrize("bucket", [S.BUCKET, 100])
def test_texts_that_share_a_few_rare_shingles_are_no_candidates(spark, bucket, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", bucket)  # 100: the bucket of the shared line in parts
    seen = []
    plain = S.verified
    monkeypatch.setattr(S, "verified", lambda sets, similarity: seen.append(sorted(r.node for r in sets.select("node").collect())) or plain(sets, similarity))
    line = "a line of six common words"
    data = []
    for k in range(250):  # each shares shingles with the next one and, in its prefix, a line with all
        data.append((k, " ".join([*(f"w{k}x{i}" for i in range(20)), line, *(f"w{k + 1}x{i}" for i in range(8))])))
    data += [(1000, data[0][1] + " more"), (1001, data[0][1] + " or less")]
    assert sorted(r.doc_id for r in S.keep_one(messy.documents(spark, data)).collect()) == list(range(250))
    assert [len(x) for x in seen] == [3]  # the near copies alone, not a component of all


def test_links_by_fingerprints_are_all_links(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ids = lambda by: sorted(r.doc_id for r in S.keep_one(docs, by=by).select("doc_id").collect())
    kept = ids("simhash")
    assert kept == ids("prefix") and 0 < len(kept) < docs.count()
    with pytest.raises(ValueError):
        S.keep_one(docs, similarity=0.5)
