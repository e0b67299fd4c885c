import hashlib
import random
import zlib

from ketflow.llm import shard as S
from tests.llm import messy


def brute(data, k):
    """Smallest capacity and shard of each text, by trying all capacities that matter."""
    size = {}
    for _, t in data:
        g = hashlib.sha256((t or "").encode()).digest()
        size[g] = size.get(g, 0) + len((t or "").encode()) + 1
    order = sorted(size)

    def greedy(cap):
        shard, used, out = 0, 0, {}
        for g in order:
            if size[g] > cap:
                return None
            if used + size[g] > cap:
                shard, used = shard + 1, 0
            used += size[g]
            out[g] = shard
        return out if shard < k else None

    low, high = 1, sum(size.values())
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(mid) else (mid + 1, high)
    return low, greedy(low)


def check(spark, data, k=8):
    df = messy.documents(spark, data)
    rows = S.keyed(df)
    found = S.plan(rows, k)
    cap, want = brute(data, k)
    assert found.capacity == cap
    got = S.shard(df, k).collect()
    assert len(got) == len(data)
    by: dict[int, list[int]] = {}
    text_of: dict[tuple, int] = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert text_of.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    mine = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), want[hashlib.sha256((t or "").encode()).digest()]) for i, t in data)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32, r.shard) for r in got) == mine


def test_hard_cases(spark):
    check(spark, messy.rows())
    assert S.shard(messy.empty(spark)).count() == 0


def test_against_brute_force(spark):
    r = random.Random(5)
    check(spark, [(i, messy.prose(i % 90, r.randint(1, 60) if i % 90 else 30)) for i in range(250)])
    check(spark, [(i, "same text") for i in range(40)])  # one group
    check(spark, [(i, "hot " * 50 if i % 3 == 0 else messy.prose(i, 20)) for i in range(120)], 5)
    check(spark, [(i, str(i)) for i in range(5)], 8)  # fewer groups than shards
