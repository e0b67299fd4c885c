"""SimHash near-duplicates (operator 2) with BK-trees.

Fingerprints are computed in one pass over the text (Arrow batches, numpy votes) and
written once; all else works on distinct fingerprints, so groups of exact copies
collapse to one.  Each distinct fingerprint goes to one bucket shard for every block
of its bits.  A shard keeps its members in a BK-tree, whose children are keyed by
their integer Hamming distance to the parent, and looks members up in it, following
only edges within the radius of their distance.  Where the method speaks of
broadcasting the trees, the trees stay with the bucket's own queries, which the
shuffle has already brought there: the set of all trees grows with the corpus and so
has no bound for a broadcast.  A bucket of more than ``BUCKET`` fingerprints is cut into
parts of about that many, and each two parts meet in a task.

``classes`` links at ``radius`` or fewer of 64 bits.  With ``radius + 1`` blocks two
such fingerprints agree on a block, so no link is lost.

``keep_one`` is the filter for corpora: near-duplicates by fingerprints of ``WORDS`` x 64
bits of their sets of distinct shingles, followed by an exact test of the Jaccard
similarity.  Its bucket shards are not blocks of bits, in which sets near the limit seldom
agree, but rare shingles: of a set's shingles, rarest first, only so many name a shard
that two sets similar enough must meet in one.  The order is by hashed counters of
frequency, so that common lines come last; any order finds all pairs.  A shard's BK-tree
links fingerprints within ``RADIUS`` bits (README has the odds that a pair at the limit
differs in more), so texts that share a few shingles by chance, of which a larger corpus
has ever more, are not linked.  The components of these links are then tested, and only
pairs that are similar enough stay linked.  In large components a few leaders come first:
members similar to one of them are linked to it, and only the rest has to meet all others.
``by="prefix"`` proposes all pairs that share such a shingle instead, without
fingerprints: no link is left to odds, but disk grows with the square of the corpus.

A shard returns the spanning stars of its local components, never all pairs: a few
leaders first gather the members near to them, and only members outside the largest
component are then looked up in the tree, since a link has two ends.
``graph.components`` joins the stars of all shards.

Edge cases: null and blank texts have fingerprint zero and are linked like any other (for
``keep_one`` their empty sets are equal); repeated rows get the same answer each
(``keep_one`` keeps one of them, and the least id of a group; of rows with that id, that
of any one text); a null doc_id never names a component unless it is alone; texts of any
length are read whole, in memory in proportion to them; an empty table gives no rows; extra
columns are not read by ``classes`` and pass through ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ketflow.llm.common import columns_of, discard, extended, map_arrow, materialize, salted_join
from ketflow.llm.graph import components

SEED = 42
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_VOTE_ROWS = 255 * 64
#: Leaders tried in a shard before its tree is asked.
_LEADERS = 16
#: Fingerprints of a bucket in one task, or in each half of one.
BUCKET = 1 << 14
#: 64-bit words of the fingerprints of shingle sets, and the bits in which linked ones may differ.
WORDS, RADIUS = 3, 64
#: Counters of shingle frequencies, and the rows they are summed in.
_COUNTERS, _SLICES = 1 << 20, 64
#: Most rows of a prefix shingle that are compared in pairs before the exact test.
_ALL_PAIRS = 32
#: Prefix shingles of a batch that are grouped before the shuffle.
_BATCH_ROWS = 400_000
#: Most texts of a component in one task, or in each half of one, and the leaders of larger ones.
_TILE, _HEADS = 128, 8
#: Members of a large component that meet its leaders in one task.
_PART = 1 << 10
#: Words of the texts that are hashed together.
_GROUP_WORDS = 200_000
#: Bits of the set of candidates' digests that is broadcast (4 MB).
_BITS = 1 << 25


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of every ``size``-word shingle, repeats included (of all words if there are fewer)."""
    words = (text or b"").translate(_LOWER).split()  # bytes.split: U+0020 and U+0009..U+000D
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    digest = xxhash.xxh64_intdigest
    n = len(words) - size + 1
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, n)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash of hashes (the 0th is the hash itself)."""
    if not k:
        return h
    h = (h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def _votes(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, the highest bit first; byte sums of 255 rows at a time."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), _VOTE_ROWS):
        bits = np.unpackbits(h[at : at + _VOTE_ROWS].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        full = len(bits) // 255 * 255
        if full:
            total += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[full:].sum(axis=0, dtype=np.uint8)
    return total


def fingerprint(text: bytes | None, size: int = 3, words: int = 1) -> tuple[int, ...]:
    """Unsigned 64-bit words of the fingerprint: a bit is 1 if it is set in over half of the hashes."""
    h = shingle_hashes(text, size)
    if not len(h):
        return (0,) * words
    return tuple(int.from_bytes(np.packbits(2 * _votes(_mixed(h, k)) > len(h)).tobytes(), "big") for k in range(words))


def set_fingerprint(shingles: np.ndarray) -> bytes:
    """Fingerprint of a set of shingle hashes, ``WORDS`` words; every shingle has one vote."""
    return b"".join(np.packbits(2 * _votes(_mixed(shingles, k + 1)) > len(shingles)).tobytes() for k in range(WORDS))


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, size)[0] for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_arrow(rows, run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


class BKTree:
    """Burkhard-Keller tree over fingerprints (rows of unsigned 64-bit words), searched for many queries at once."""

    def __init__(self, items: np.ndarray) -> None:
        self.items = items
        self.children: list[dict[int, int]] = [{}] if len(items) else []
        values = [int.from_bytes(row.tobytes(), "little") for row in items]
        for i in range(1, len(values)):
            at, v = 0, values[i]
            while True:
                d = (values[at] ^ v).bit_count()
                step = self.children[at].get(d)
                if step is None:
                    self.children[at][d] = i
                    break
                at = step
            self.children.append({})

    def matches(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(item index, query indices within ``radius`` of it), following edges k with |k - d| <= radius."""
        if not len(self.items):
            return
        stack = [(0, np.arange(len(queries)))]
        while stack:
            at, q = stack.pop()
            d = distances(queries[q], self.items[at])
            near = q[d <= radius]
            if len(near):
                yield at, near
            for k, child in self.children[at].items():
                go = q[np.abs(d - k) <= radius]
                if len(go):
                    stack.append((child, go))


def distances(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints to one fingerprint."""
    return np.bitwise_count(rows ^ one).sum(axis=1, dtype=np.int64)


def _stars(nodes: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning stars (node, root node) of the local components of distinct fingerprints."""
    n = len(nodes)
    if n == 2:
        return [(int(nodes[1]), int(nodes[0]))] if distances(fps[1:], fps[0])[0] <= radius else []
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(i: int, near: np.ndarray) -> None:
        root = find(i)
        for j in near.tolist():
            if (other := find(j)) != root:
                parent[max(other, root)] = root = min(other, root)

    asks = np.arange(n)
    if n > 64:
        alone = np.ones(n, bool)
        for _ in range(_LEADERS):
            if not alone.any():
                break
            i = int(np.argmax(alone))
            near = np.flatnonzero(distances(fps, fps[i]) <= radius)
            join(i, near)
            alone[near] = False
        roots = np.array([find(i) for i in range(n)])
        asks = np.flatnonzero(roots != np.bincount(roots).argmax())
    if len(asks):
        for i, near in BKTree(fps).matches(fps[asks], radius):
            join(i, asks[near])
    return [(int(nodes[i]), int(nodes[r])) for i in range(n) if (r := find(i)) != i]


def _blocks_of(bits: int, blocks: int) -> list[tuple[int, int]]:
    edges = [bits * i // blocks for i in range(blocks + 1)]
    return list(zip(edges, edges[1:], strict=False))


def links(fps: DataFrame, radius: int = 3, words: int = 1, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) of nodes that connect all distinct fingerprints within ``radius`` bits that agree on a block.

    ``fps`` has columns node (long, unique) and w0, w1, ... (long), one for each word.
    """
    each = (radius + 1 if blocks is None else blocks) // words
    names = [f"w{k}" for k in range(words)]
    keys = []
    for k in range(words):
        for i, (lo, hi) in enumerate(_blocks_of(64, each)):
            part = F.shiftrightunsigned(names[k], lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
            keys.append(part * (words * each) + (k * each + i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        held_key = None

        def answer() -> list[tuple[int, int]]:
            if not held or len(held) == 1 and len(held[0][0]) == 1:
                return []
            return _stars(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), radius)

        for b in batches:
            if not b.num_rows:
                continue
            key, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            fp = np.stack([b.column(2 + k).to_numpy().view(np.uint64) for k in range(words)], axis=1)
            cuts = np.flatnonzero(np.diff(key)) + 1
            out: list[tuple[int, int]] = []
            for k, lo, hi in zip(key[np.r_[0, cuts]].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if k != held_key:
                    out += answer()
                    held, held_key = [], k
                held.append((node[lo:hi], fp[lo:hi]))
            yield _pairs(out)
        yield _pairs(answer())

    rows = fps.select(F.explode(F.array(*keys)).alias("key"), "node", *names)
    large = rows.groupBy("key").count().filter(F.col("count") > BUCKET)
    if not large.isEmpty():
        rows = _in_parts(rows, large, names)
    return map_arrow(rows.repartition("key").sortWithinPartitions("key"), run, "a bigint, b bigint").distinct()


def _in_parts(rows: DataFrame, large: DataFrame, names: list[str]) -> DataFrame:
    """Rows (key, node, names...) with the buckets of ``large`` (key, count) cut into parts of about ``BUCKET``, a new key for each two parts."""
    parts = large.select("key", F.ceil(F.col("count") / BUCKET).cast("int").alias("k"))
    cut = salted_join(rows, parts, "key", "node", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    cut = cut.withColumn("c", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return cut.select(F.xxhash64("key", F.least("c", "d"), F.greatest("c", "d")).alias("key"), "node", *names)


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(rows, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0], pa.int64()), pa.array(x[:, 1], pa.int64())], names=["a", "b"])


def classes(docs: DataFrame, size: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id of the rows linked to this one."""
    rows = materialize(fingerprints(docs, size, id_col, text_col))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    label = components(links(distinct.select(F.col("fp").alias("node"), F.col("fp").alias("w0")), radius))
    named = distinct.join(label, distinct["fp"] == label["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    component = salted_join(named, smallest, "label", "fp").select("fp", "component_id")
    return salted_join(rows, component, "fp", "doc_id").select("doc_id", "fp", "component_id")


def _mix(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a run of words from that of the run without its last word, and the last word."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B185EBCA87) + word
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[bytes | None], size: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text (of all words if there are fewer); distinct words are hashed once a group of texts."""
    at = 0
    while at < len(texts):
        local: dict[bytes, int] = {}
        lengths, ids = [], []
        while at < len(texts) and len(ids) < _GROUP_WORDS:
            words = (texts[at] or b"").translate(_LOWER).split()
            ids += [local.setdefault(w, len(local)) for w in words]
            lengths.append(len(words))
            at += 1
        hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in local], np.uint64)
        word = hashes[np.array(ids, np.int64)]
        runs = word[: max(0, len(word) - size + 1)]
        for k in range(1, size):
            runs = _mix(runs, word[k : k + len(runs)])
        start = 0
        for n in lengths:
            if n >= size:
                yield np.unique(runs[start : start + n - size + 1])
            else:
                short = word[start : start + min(n, 1)]
                for k in range(1, n):
                    short = _mix(short, word[start + k : start + k + 1])
                yield short
            start += n


def _least_overlap(n: int, similarity: float) -> int:
    """Fewest shingles that a set of n shares with any set at least so similar."""
    return math.ceil(similarity * n - 1e-9)


def frequencies(docs: DataFrame, size: int = 5, text_col: str = "text") -> np.ndarray:
    """How many rows have a shingle of each of ``_COUNTERS`` hash classes (4 MB, whatever the corpus)."""
    per = _COUNTERS // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_COUNTERS, np.uint32)
        for b in batches:
            for x in shingle_sets(b.column(0).to_pylist(), size):
                total[x & np.uint64(_COUNTERS - 1)] += np.uint32(1)
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([total[k * per : (k + 1) * per].tobytes() for k in range(_SLICES)], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(x, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    out = np.zeros(_COUNTERS, np.uint32)
    parts = map_arrow(docs.select(columns_of(docs)[docs.columns.index(text_col)].cast("binary")), count, schema)
    for r in map_arrow(parts.repartition("slice"), add, schema).collect():
        out[r["slice"] * per : (r["slice"] + 1) * per] = np.frombuffer(r["counts"], np.uint32)
    return out


def prefix(shingles: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest shingles of a set: two sets at least so similar have one of them in common."""
    n = len(shingles)
    if not n:
        return shingles
    order = np.lexsort((shingles, counts[shingles & np.uint64(_COUNTERS - 1)]))
    return shingles[order[: n - _least_overlap(n, similarity) + 1]]


def _bucket_pairs(node: np.ndarray, n: np.ndarray, at: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the rows of one small bucket, of ``n`` shingles each, of which the bucket's is number ``at``, that can still be similar enough."""
    i, j = np.triu_indices(len(node), 1)
    overlap = np.minimum(n[i] - at[i], n[j] - at[j])
    ok = overlap >= similarity / (1 + similarity) * (n[i] + n[j]) - 1e-9
    return node[i][ok], node[j][ok]


def _runs(key: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """Place of the first row of each row's run, in rows sorted by key and size: a run breaks where sizes are too far apart to be similar enough."""
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (n[:-1] < similarity * n[1:] - 1e-9)
    return np.flatnonzero(first)[np.cumsum(first) - 1]


def _stars_of_runs(key: np.ndarray, node: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs of each row with the first of its run: they connect all pairs that can be similar enough."""
    root = _runs(key, n, similarity)
    own = np.flatnonzero(root != np.arange(len(root)))
    return np.stack([node[own], node[root[own]]], axis=1)


def _spread(node: np.ndarray, n: np.ndarray, prefixes: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, edges) of a batch of sets: rows (key, node, n, place) for each prefix shingle.

    Of keys with over ``_ALL_PAIRS`` rows, runs are linked here already, and only their
    ends go on (with place -1), so a hot key costs a few rows a batch.
    """
    lengths = np.array([len(p) for p in prefixes], np.int64)
    rows = np.stack([np.concatenate([*prefixes, np.empty(0, np.int64)]), np.repeat(node, lengths), np.repeat(n, lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)])
    _, inverse, count = np.unique(rows[0], return_inverse=True, return_counts=True)
    hot = count[inverse] > _ALL_PAIRS
    if not hot.any():
        return rows, np.empty((0, 2), np.int64)
    part = rows[:, hot]
    part = part[:, np.lexsort((part[1], part[2], part[0]))]
    edges = _stars_of_runs(part[0], part[1], part[2], similarity)
    root = _runs(part[0], part[2], similarity)
    at = np.arange(len(root))
    ends = part[:, (root == at) | np.r_[root[1:] != root[:-1], True]]
    ends[3] = -1
    return np.concatenate([rows[:, ~hot], ends], axis=1), np.unique(np.sort(edges, axis=1), axis=0)


def candidates(sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect, among others, all pairs of sets with a similarity of at least ``similarity``.

    ``sets`` has columns node (long, unique), n (size of the set) and prefix (its rarest
    shingles, as 64-bit words).  Exact: sets that share no prefix shingle are less similar.
    Rows of a key come in order of size, so a large bucket is linked as it streams by.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "node", "n", "place"]
        for b in batches:
            prefixes = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
            node, size = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
            part = np.cumsum([len(p) for p in prefixes]) // _BATCH_ROWS  # as many sets at once as have about so many rows
            for k in np.unique(part).tolist():
                lo, hi = np.searchsorted(part, [k, k + 1])
                rows, edges = _spread(node[lo:hi], size[lo:hi], prefixes[lo:hi], similarity)
                for x in range(0, rows.shape[1], 50_000):
                    key, of, n, place = rows[:, x : x + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(of), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32))], names=names)
                if len(edges):  # pass the shuffle as rows (first node, second node, -1, -2)
                    yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1]), pa.array(np.full(len(edges), -1, np.int32)), pa.array(np.full(len(edges), -2, np.int32))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((4, 0), np.int64)  # rows of the last key so far, if not more than fit one bucket
        tail: np.ndarray | None = None  # the last row of a larger one

        def answer(rows: np.ndarray) -> pa.RecordBatch:
            done = rows[3] == -2
            out = [rows[:2, done].T]
            rows = rows[:, ~done]
            key, node, n, at = rows
            _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            large = count > _ALL_PAIRS
            large[inverse[at < 0]] = True
            many = large[inverse]
            out.append(_stars_of_runs(key[many], node[many], n[many], similarity))
            for lo, k in zip(first[~large & (count > 1)].tolist(), count[~large & (count > 1)].tolist(), strict=True):
                out.append(np.stack(_bucket_pairs(node[lo : lo + k], n[lo : lo + k], at[lo : lo + k], similarity), axis=1))
            pairs = np.concatenate(out)
            return _pairs(np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0))

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(4)])
            if tail is not None:  # the key of a large bucket may go on
                rows = np.concatenate([tail, rows], axis=1)
            else:
                rows = np.concatenate([held, rows], axis=1)
            last = int(np.searchsorted(rows[0], rows[0, -1]))
            if rows.shape[1] - last > _ALL_PAIRS:  # a large bucket: link what is here, carry on from its last row
                yield answer(np.concatenate([rows[:, :last], np.where(np.arange(4)[:, None] == 3, np.minimum(rows[:, last:], -1), rows[:, last:])], axis=1))
                own = np.flatnonzero((rows[0] == rows[0, -1]) & (rows[3] != -2))
                tail, held = (rows[:, own[-1:]], held[:, :0]) if len(own) else (None, held[:, :0])
                if tail is not None:  # its size, and the first node of its run
                    run = rows[:, own]
                    tail[1], tail[3] = run[1, _runs(run[0], run[2], similarity)[-1]], -1
            else:
                yield answer(rows[:, :last])
                held, tail = rows[:, last:], None
        yield answer(np.concatenate([tail if tail is not None else held], axis=1))

    rows = map_arrow(sets.select("node", "n", "prefix"), spread, "key bigint, node bigint, n int, place int")
    return map_arrow(rows.repartition("key").sortWithinPartitions("key", "n", "node"), run, "a bigint, b bigint").distinct()


def _bucket_stars(key: np.ndarray, node: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Spanning stars of the local components of every bucket, rows in order of the key; in a bucket of two the tree is one distance."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.r_[first, len(key)])
    two = first[count == 2]
    two = two[distances(fps[two], fps[two + 1]) <= radius]
    out = [np.stack([node[two + 1], node[two]], axis=1)]
    for lo, n in zip(first[count > 2].tolist(), count[count > 2].tolist(), strict=True):
        if stars := _stars(node[lo : lo + n], fps[lo : lo + n], radius):
            out.append(np.array(stars, np.int64))
    return np.concatenate(out)


def near_links(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """Edges (a, b) that connect all sets with fingerprints within ``RADIUS`` bits that share a prefix shingle.

    ``sets`` has columns node (long, unique), prefix (the rarest shingles, as 64-bit words)
    and fp (the fingerprint); ``counts`` are the counters of ``frequencies``, which bound the
    rows of every bucket.  A bucket is the sets with one prefix shingle.
    """
    names = [f"w{k}" for k in range(WORDS)]
    crowded = counts > BUCKET

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prefixes = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            fps = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64).reshape(-1, WORDS)
            node, lengths = b.column(0).to_numpy(), np.array([len(p) for p in prefixes], np.int64)
            part = np.cumsum(lengths) // _BATCH_ROWS  # as many sets at once as have about so many rows
            for k in np.unique(part).tolist():
                lo, hi = np.searchsorted(part, [k, k + 1])
                key, of = np.concatenate([*prefixes[lo:hi], np.empty(0, np.int64)]), np.repeat(np.arange(lo, hi), lengths[lo:hi])
                for x in range(0, len(key), 50_000):
                    i = of[x : x + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(key[x : x + 50_000]), pa.array(node[i]), *(pa.array(fps[i, w]) for w in range(WORDS))], names=["key", "node", *names])

    def in_crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = np.concatenate([*(np.frombuffer(x, np.int64) for x in b.column(0).to_pylist()), np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(key[crowded[key.view(np.uint64) & np.uint64(_COUNTERS - 1)]])], names=["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.empty((0, 2 + WORDS), np.int64)  # of the last key so far
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.concatenate([rows, np.stack([c.to_numpy() for c in b.columns], axis=1)])
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            yield _pairs(_bucket_stars(rows[:last, 0], rows[:last, 1], rows[:last, 2:].view(np.uint64), RADIUS))
            rows = rows[last:]
        yield _pairs(_bucket_stars(rows[:, 0], rows[:, 1], rows[:, 2:].view(np.uint64), RADIUS))

    rows = map_arrow(sets.select("node", "prefix", "fp"), spread, ", ".join(f"{c} bigint" for c in ("key", "node", *names)))
    if crowded.any():
        large = map_arrow(sets.select("prefix"), in_crowded, "key bigint").groupBy("key").count().filter(F.col("count") > BUCKET)
        if not large.isEmpty():
            rows = _in_parts(rows, large, names)
    return map_arrow(rows.repartition("key").sortWithinPartitions("key"), run, "a bigint, b bigint").distinct()


def _similar(nodes: list[int], sets: list[np.ndarray], side: list[int], similarity: float, all_links: bool = False) -> list[tuple[int, int]]:
    """Spanning edges (or all) of the pairs with an exact Jaccard similarity of ``similarity`` or more: across sides 0 and 1, or all if there is one side."""
    sizes = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    across = len(set(side)) > 1
    left = [i for i, x in enumerate(side) if not across or x == 0]
    mine = np.array(side) == 1
    mark = np.zeros(int(codes.max(initial=0)) + 1, bool)
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in left:
        own = codes[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        shared = np.bincount(owner[mark[codes]], minlength=len(sizes))
        mark[own] = False
        near = shared >= similarity * (sizes + sizes[i] - shared) - 1e-9
        near = near & mine if across else near
        for j in np.flatnonzero(near).tolist():
            if all_links:
                out.append((nodes[i], nodes[j]))
            elif (x := find(i)) != (y := find(j)):
                root[max(x, y)] = min(x, y)
                out.append((nodes[i], nodes[j]))
    return out


def _compare(tiles: DataFrame, keys: list[str], similarity: float, all_links: bool = False) -> DataFrame:
    """Edges (a, b) of the similar pairs of each tile: rows (keys..., node, side, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def answer() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            nodes, sides, sets = zip(*held, strict=True)
            return _similar(list(nodes), list(sets), list(sides), similarity, all_links)

        for b in batches:
            out = []
            for *at, node, side, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != key:
                    out += answer()
                    held, key = [], at
                held.append((node, side, np.frombuffer(x, np.uint64)))
            yield _pairs(out)
        yield _pairs(answer())

    return map_arrow(tiles.select(*keys, "node", "side", "shingles").repartition(*keys).sortWithinPartitions(*keys), run, "a bigint, b bigint")


def _main_heads(links: DataFrame) -> DataFrame:
    """(label, main): of the heads of each component, as bits, those that members similar to two of them connect, the most members first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, mains = [], []
            for label, masks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                groups: list[list[int]] = []  # heads as bits, members
                for r in masks:
                    mask, n = r["mask"], r["n"]
                    for g in [g for g in groups if g[0] & mask]:
                        mask, n = mask | g[0], n + g[1]
                        groups.remove(g)
                    groups.append([mask, n])
                labels.append(label)
                mains.append(max(groups, key=lambda g: (g[1], g[0]))[0])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int64()), pa.array(mains, pa.int32())], names=["label", "main"])

    masks = links.groupBy("label", "mask").agg(F.count("*").alias("n")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("mask", "n"))).alias("masks"))  # at most 2^_HEADS of a label
    return map_arrow(masks, run, "label bigint, main int")


def verified(sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect the pairs of at least ``similarity`` inside components; every edge is an exact one.

    ``sets`` has columns label (component of candidates), node (unique) and shingles (its
    set).  A component of up to ``_TILE`` texts meets in one task.  In a larger one, all
    members are first compared with its ``_HEADS`` heads (members of least hash), each on
    its own, in parts of about ``_PART`` members that the heads are sent to once; those that
    the heads connect need not meet each other.  The rest is cut into
    chunks, and each meets each chunk of the whole component.
    """
    counts = sets.groupBy("label").agg(F.count("*").alias("members"))
    sized = salted_join(sets, counts, "label", "node")
    small = sized.filter(F.col("members") <= _TILE).withColumn("side", F.lit(0))
    edges = _compare(small, ["label"], similarity)
    if counts.filter(F.col("members") > _TILE).isEmpty():
        return edges.distinct()
    large = sized.filter(F.col("members") > _TILE)
    order = F.struct(F.xxhash64("node", F.lit("head")), F.col("node"))
    # the least hashes of a label: of each salted part first, then of all
    first = large.select("label", "node", order.alias("o"), F.pmod(F.xxhash64("node"), F.lit(64)).alias("part"))
    for by in (["label", "part"], ["label"]):
        first = first.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("o"))).filter(F.col("r") <= _HEADS)
    # members in parts of about _PART, and the heads once before each part
    parts = F.ceil(F.col("members") / _PART).cast("int")
    head = (F.col("r") - 1).alias("head")
    heads = large.join(first.select("node", head), "node").select("label", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "head", "node", "shingles", "members")
    placed = large.select("label", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), F.lit(_HEADS).alias("head"), "node", "shingles", "members")

    def to_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, []
        for b in batches:
            own = b.column(2).to_numpy() == _HEADS
            masks, near = [], []
            for label, part, head, node, x in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4), strict=True):
                mine = np.frombuffer(x.as_buffer(), np.uint64)
                if (label, part) != at:
                    at, known = (label, part), []
                if head < _HEADS:
                    known.append((head, node, mine.copy()))
                    continue
                hits = []
                for k, other_node, other in known:
                    shared = len(np.intersect1d(mine, other, assume_unique=True))
                    if shared >= similarity * (len(mine) + len(other) - shared) - 1e-9:
                        hits.append((k, other_node))
                masks.append(sum(1 << k for k, _ in hits))
                near.append([v for _, v in hits if v != node])
            kept = b.filter(pa.array(own))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(3), kept.column(4), kept.column(5), pa.array(masks, pa.int32()), pa.array(near, pa.list_(pa.int64()))], names=["label", "node", "shingles", "members", "mask", "near"])

    met = heads.unionByName(placed).repartition("label", "part").sortWithinPartitions("label", "part", "head")
    met = materialize(map_arrow(met.select("label", "part", "head", "node", "shingles", "members"), to_heads, "label bigint, node bigint, shingles binary, members bigint, mask int, near array<bigint>"))
    edges = edges.union(met.select(F.col("node").alias("a"), F.explode("near").alias("b")))
    placed = salted_join(met, _main_heads(met.filter("mask > 0").select("label", "mask")), "label", "node", "left", salts=64)
    placed = placed.withColumn("rest", F.col("mask").bitwiseAND(F.coalesce("main", F.lit(0))) == 0)
    left = placed.groupBy("label").agg(F.count_if("rest").alias("left"), F.count("*").alias("all")).filter("left > 0")
    left = left.select("label", F.ceil(F.col("left") / _TILE).cast("int").alias("us"), F.ceil(F.col("all") / _TILE).cast("int").alias("vs"))
    todo = salted_join(placed, left, "label", "node", salts=64)
    chunk = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    asks = todo.filter("rest").select("label", chunk("us").alias("u"), F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("v"), "node", F.lit(0).alias("side"), "shingles")
    asked = todo.select("label", F.explode(F.sequence(F.lit(0), F.col("us") - 1)).alias("u"), chunk("vs").alias("v"), "node", F.lit(1).alias("side"), "shingles")
    return edges.union(_compare(asks.union(asked), ["label", "u", "v"], similarity)).filter("a <> b").distinct()


def _bits_of(digests: DataFrame) -> np.ndarray:
    """Which of ``_BITS`` hash classes the digests (one column of longs) fall into, eight classes a byte."""
    per = _BITS // 8 // _SLICES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(_BITS // 8, np.uint8)
        for b in batches:
            i = (b.column(0).to_numpy().view(np.uint64) % np.uint64(_BITS)).astype(np.int64)
            np.bitwise_or.at(packed, i >> 3, (1 << (i & 7)).astype(np.uint8))
        some = [k for k in range(_SLICES) if packed[k * per : (k + 1) * per].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packed[k * per : (k + 1) * per].tobytes() for k in some], pa.binary())], names=["slice", "bits"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, np.uint8(0)) | np.frombuffer(x, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "bits"])

    out = np.zeros(_BITS // 8, np.uint8)
    schema = "slice int, bits binary"
    for r in map_arrow(map_arrow(digests, mark, schema).repartition("slice"), add, schema).collect():
        out[r["slice"] * per : (r["slice"] + 1) * per] = np.frombuffer(r["bits"], np.uint8)
    return out


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a set as two signed longs."""
    return tuple(np.array(divmod(xxhash.xxh3_128_intdigest(shingles.tobytes(), SEED), 2**64), np.uint64).view(np.int64).tolist())


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", by: str = "simhash") -> DataFrame:
    """The rows of ``docs``, one for each group of near-duplicates: one with the least id.

    Groups are the components of the pairs whose sets of distinct ``size``-word shingles
    have a Jaccard similarity of at least ``similarity`` and, but for ``by="prefix"``,
    fingerprints within ``RADIUS`` bits (which suits a similarity of 0.8 or more).  Sets are known by 128-bit digests
    and equal sets are one node.  Only sizes and prefixes are written, and the sets of
    candidates; texts are read again where they are needed.  The rows to keep are found by
    a join on digest and id, which spreads even a large group of copies.
    """
    if by not in ("simhash", "prefix"):
        raise ValueError(f"unknown way to propose links: {by}")
    if by == "simhash" and similarity < 0.8:
        raise ValueError("RADIUS is meant for similarities from 0.8 on")
    texts = docs.select(columns_of(docs)[docs.columns.index(id_col)].alias("id"), columns_of(docs)[docs.columns.index(text_col)].cast("binary").alias("text"))
    counters = frequencies(docs, size, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(counters)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for b in batches:
            sets = list(shingle_sets(b.column(1).to_pylist(), size))
            digests = np.array([_digest(x) for x in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([len(x) for x in sets], pa.int32()), pa.array([prefix(x, counts, similarity).tobytes() for x in sets], pa.binary()), pa.array([set_fingerprint(x) for x in sets], pa.binary())], names=["id", "d0", "d1", "n", "prefix", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))).alias("best")
    rows = map_arrow(texts, describe, f"id {kind}, d0 bigint, d1 bigint, n int, prefix binary, fp binary")
    distinct = materialize(rows.groupBy("d0", "d1").agg(best, F.count("*").alias("rows"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("fp").alias("fp")).withColumn("node", F.monotonically_increasing_id()))
    label = materialize(components(near_links(distinct, counters) if by == "simhash" else candidates(distinct, similarity)))
    found = materialize(distinct.select("node", "d0", "d1").join(label, "node"))
    wanted = docs.sparkSession.sparkContext.broadcast(_bits_of(found.select("d0")))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = wanted.value
        for b in batches:
            out: dict[tuple[int, int], bytes] = {}
            for x in shingle_sets(b.column(0).to_pylist(), size):
                d = _digest(x)
                i = d[0] % _BITS
                if flags[i >> 3] >> (i & 7) & 1:
                    out[d] = x.tobytes()
            for lo in range(0, len(out), 200):
                part = list(out.items())[lo : lo + 200]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in part], pa.int64()), pa.array([k[1] for k, _ in part], pa.int64()), pa.array([v for _, v in part], pa.binary())], names=["d0", "d1", "shingles"])

    sets = map_arrow(texts.select("text"), sets_of, "d0 bigint, d1 bigint, shingles binary").dropDuplicates(["d0", "d1"])
    sets = materialize(sets.join(found, ["d0", "d1"]).select("label", "node", "shingles"))
    group = components(verified(sets, similarity))
    named = distinct.select("node", "best", "d0", "d1", "rows").join(group, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min(F.struct("best", "node")).alias("least"))
    kept = least.select(F.col("least.node").alias("node")).join(named, "node").select(F.col("best.id").alias("__id"), F.col("d0").alias("__d0"), F.col("d1").alias("__d1"), F.col("rows").alias("__rows"))
    kept = materialize(kept)
    for t in (sets, found, label, distinct):
        discard(t)
    base, schema = extended(docs, __d0="bigint", __d1="bigint")
    at = base.columns.index(text_col)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = np.array([_digest(x) for x in shingle_sets([None if t is None else t.encode() for t in b.column(at).to_pylist()], size)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests[:, 0]), pa.array(digests[:, 1])], names=[f"c{i}" for i in range(b.num_columns + 2)])

    marked = map_arrow(base, mark, schema)
    mine = marked.withColumnRenamed("__d0", "__m0").withColumnRenamed("__d1", "__m1")
    own = columns_of(base)
    same = own[base.columns.index(id_col)]
    joined = mine.join(kept, (F.col("__m0") == F.col("__d0")) & (F.col("__m1") == F.col("__d1")) & same.eqNullSafe(F.col("__id")))
    once = joined.filter("__rows = 1").select(*own)
    again = joined.filter("__rows > 1").dropDuplicates(["__m0", "__m1"]).select(*own)
    return once.unionAll(again)


def hex_of(fp: Column) -> Column:
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
