"""Stupid-backoff language-model scores over the corpus's own counts (operator 8).

    S(w | c) = count(c w) / count(c)   if count(c w) >= MIN_COUNT
             = ALPHA * S(w | c')       otherwise, c' one word shorter; S(w) = count(w) / tokens

The computation is relational: documents are exploded into n-grams, count tables of
each order are partitioned by n-gram hash, the exploded n-grams are joined to them, and
the log scores are summed per document.  Rows of these relations are *blocks*: a row
holds the sorted distinct n-grams of a bounded number of tokens in packed columns, so
counts are aggregated before any shuffle and an n-gram costs some six bytes on the
wire instead of a row of forty.  The steps:

1. ``blocks``  documents -> one row a block: the hashes of its distinct words and its
   tokens; written to the shared folder.
2. ``counts``, for orders 1 and 2 and then for each order k above: blocks -> slices (order,
   hash range, block) of distinct n-gram hashes with their counts, shuffled by hash range;
   each range adds up its slices and answers every slice with the corpus counts, which
   are written.  An n-gram can only occur ``MIN_COUNT`` times if both its parts of order
   k - 1 do, so from order 3 on only those are counted: the others are known to back off.
3. ``score``   answers joined to blocks by block; log scores summed per document.

A frequent n-gram occurs once a block, so no hash range is hot; ranges and tasks are as
many as the number of tokens demands, so that a task's share does not grow.  Slices are
never more than distinct n-grams in blocks: where there are more ranges than a block has
n-grams, a slice is one n-gram, a plain row.  All documents and all n-grams take part.
N-grams are known by 64-bit hashes (at 10^8 n-grams a clash has odds of about 1 in 3000).
A block stores its words' hashes and its tokens only; its n-grams are made again from them
where they are needed, which costs less than to store and shuffle them.

Edge cases: null and blank texts have 0 tokens, score 0 and mean 0; repeated rows are
counted and scored each; nothing depends on the order of n-grams of equal count; an empty
table gives no rows; extra columns are not read; a text longer than a block is a block of
its own, held by one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ketflow.llm.common import map_arrow, materialize

ORDER = 3
MIN_COUNT = 2
ALPHA = 0.4
BLOCK_TOKENS = 1 << 19
#: Distinct n-grams that a hash range gathers from all blocks, about.
RANGE_NGRAMS = 1 << 21
#: Ranges, or blocks, that a task takes one after the other, about.  Tasks of a single one are a
#: second's work, and every file written costs a process of its own on a local file system.
PER_TASK = 4
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_M1, _M2 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case."""
    return (text or b"").translate(_LOWER).split()


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes; 64-bit hashes as differences modulo 2^64."""
    if values.dtype == np.uint64:
        values = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    values = np.ascontiguousarray(planes.T).view(dtype).reshape(-1)
    return np.cumsum(values, dtype=np.uint64) if dtype == np.uint64 else values


def _join(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of the n-gram of a context and the word after it."""
    h = (context ^ (context >> np.uint64(29))) * _M1 + word
    h = (h ^ (h >> np.uint64(32))) * _M2
    return h ^ (h >> np.uint64(29))


def _tokens(texts: list[list[bytes]]) -> tuple[bytes, bytes]:
    """Packed word hashes of tokenised documents, and the packed place of each token among them.

    Words stand by falling frequency, then by hash: frequent tokens get small places, and
    the many words of equal frequency still have short differences.
    """
    local: dict[bytes, int] = {}
    flat = np.fromiter((local.setdefault(w, len(local)) for t in texts for w in t), np.int64, sum(map(len, texts)))
    hashes = np.array([xxhash.xxh64_intdigest(w, 0) for w in local], np.uint64)
    order = np.lexsort((hashes, -np.bincount(flat, minlength=len(hashes))))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return pack(hashes[order]), pack(place[flat])


@dataclass
class Grams:
    """Distinct n-grams of one order in a block: hashes in order, counts, places of context and suffix one order down, and the n-gram of each token for which this order is the longest."""

    hash: np.ndarray
    count: np.ndarray
    ctx: np.ndarray
    suf: np.ndarray
    top: np.ndarray


def grams(vocabulary: bytes, tokens: bytes, lengths: list[int], order: int) -> list[Grams]:
    """The n-grams of a block, one entry an order."""
    size = np.array(lengths, np.int64)
    words = unpack(vocabulary, np.uint64)[unpack(tokens, np.int32)]
    offset = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
    out: list[Grams] = []
    gram, back = words, np.empty(0, np.int64)
    for k in range(1, order + 1):
        if k > 1:
            gram = np.concatenate([np.zeros(min(1, len(gram)), np.uint64), _join(gram[:-1], words[1:])])
        at = np.flatnonzero(offset >= k - 1)
        uniq, first, inverse, count = np.unique(gram[at], return_index=True, return_inverse=True, return_counts=True)
        index = np.full(len(words), -1, np.int32)
        index[at] = inverse
        where = at[first]
        out.append(Grams(uniq, count, back[where - 1] if k > 1 else back, back[where] if k > 1 else back, index[offset == k - 1] if k < order else index[at]))
        back = index
    return out


def blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table of blocks."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[bytes]] = []
        held, serial = 0, TaskContext.get().partitionId() << 32
        id_type = None

        def flush() -> pa.RecordBatch:
            nonlocal ids, texts, held, serial
            cols = [pa.array([serial], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([[len(t) for t in texts]], pa.list_(pa.int64()))]
            cols += [pa.array([c], pa.binary()) for c in _tokens(texts)]
            ids, texts, held, serial = [], [], 0, serial + 1
            return pa.RecordBatch.from_arrays(cols, names=["block", "ids", "lengths", "vocabulary", "tokens"])

        for b in batches:
            id_type = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = tokens_of(t)
                if texts and held + len(words) > block_tokens:
                    yield flush()
                ids.append(i)
                texts.append(words)
                held += len(words)
        if texts:
            yield flush()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = f"block bigint, ids array<{kind}>, lengths array<bigint>, vocabulary binary, tokens binary"
    return materialize(map_arrow(rows, run, schema))


def _answered(parts: list[tuple[int, bytes]], size: int, kept: np.ndarray) -> np.ndarray:
    """Corpus counts of a block's n-grams of one order: the answers, in order, where they were asked for, else 0."""
    out = np.zeros(size, np.int64)
    if parts:
        out[kept] = np.concatenate([unpack(x, np.int64) for _, x in sorted(parts)])
    return out


def _worth(g: Grams, k: int, below: np.ndarray | None, min_count: int) -> np.ndarray:
    """The n-grams of order k + 1 to count: from order 3 on, those both of whose parts occur ``min_count`` times."""
    if k < 2:
        return np.arange(len(g.hash))
    return np.flatnonzero((below[g.ctx] >= min_count) & (below[g.suf] >= min_count))


def _by_block(table: DataFrame, answers: list[DataFrame], n_blocks: int) -> DataFrame:
    """Blocks with the answers of all orders so far."""
    columns = ["block", "lengths", "vocabulary", "tokens"]
    if not answers:
        return table.select(*columns, F.lit(None).cast("array<struct<k: int, lo: bigint, n: binary>>").alias("answers"))
    all_of = answers[0]
    for more in answers[1:]:
        all_of = all_of.union(more)
    tasks = -(-n_blocks // PER_TASK) or 1
    got = all_of.repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("k", "lo", "n")).alias("answers"))
    return table.repartition(tasks, "block").join(got, "block", "left").select("ids", *columns, "answers")


def counts(table: DataFrame, orders: list[int], ranges: int, min_count: int = MIN_COUNT) -> DataFrame:
    """(block, k, lo, n): corpus counts of the n-grams of ``orders`` (from 0) that each block asks for, from the lo-th on; 0 below ``min_count`` for k > 0.

    ``table`` is the result of ``_by_block`` with the answers of the orders below.
    """
    bits = max(0, (ranges - 1).bit_length())
    upto = orders[-1] + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, lengths, vocabulary, tokens, got in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, below = [], None
                for k, g in enumerate(grams(vocabulary, tokens, lengths, upto)):
                    ask = _worth(g, k, below, min_count)
                    if k not in orders:
                        below = _answered([(a["lo"], a["n"]) for a in got or () if a["k"] == k], len(g.hash), ask)
                        continue
                    h, n = g.hash[ask], g.count[ask].astype(np.uint32)
                    edges = np.searchsorted(h, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
                    at = [0, *np.asarray(edges).tolist(), len(h)]
                    rows += [((k << 40) + p, block, k, lo, pack(h[lo:hi]), pack(n[lo:hi])) for p, (lo, hi) in enumerate(zip(at, at[1:], strict=False)) if hi > lo]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["key", "block", "k", "lo", "h", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def answer() -> pa.RecordBatch:
            h = [unpack(r[4], np.uint64) for r in held]
            n = np.concatenate([unpack(r[5], np.uint32) for r in held]).astype(np.int64)
            uniq, inverse = np.unique(np.concatenate(h), return_inverse=True)
            total = np.bincount(inverse, weights=n, minlength=len(uniq)).astype(np.int64)  # exact below 2^53
            if held[0][2] > 0:
                total[total < min_count] = 0
            parts = np.split(total[inverse], np.cumsum([len(x) for x in h])[:-1])
            cols = [pa.array([r[i] for r in held], t) for i, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int64()))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([pack(p) for p in parts], pa.binary())], names=["block", "k", "lo", "n"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][0] != r[0]:
                    yield answer()
                    held = []
                held.append(r)
        if held:
            yield answer()

    slices = map_arrow(table.select("block", "lengths", "vocabulary", "tokens", "answers"), cut, "key bigint, block bigint, k int, lo bigint, h binary, n binary")
    tasks = -(-(len(orders) << bits) // PER_TASK)
    return map_arrow(slices.repartition(tasks, "key").sortWithinPartitions("key"), add, "block bigint, k int, lo bigint, n binary")


def score(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_backoff, log_score, mean_log_score) of every row; natural logarithms."""
    table = blocks(docs, id_col=id_col, text_col=text_col)
    size = table.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens"), F.count("*").alias("blocks")).first()
    tokens = size["tokens"] or 0
    ranges = max(1, math.ceil(tokens / RANGE_NGRAMS))
    answers: list[DataFrame] = []
    for orders in [list(range(min(2, order))), *([k] for k in range(2, order))]:
        answers.append(materialize(counts(_by_block(table, answers, size["blocks"]), orders, ranges, min_count)))
    joined = _by_block(table, answers, size["blocks"]).select("ids", "lengths", "vocabulary", "tokens", "answers")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            id_type = b.column(0).type.value_type
            for ids, lengths, vocabulary, words, got in zip(*(c.to_pylist() for c in b.columns), strict=True):
                size = np.array(lengths, np.int64)
                total, steps = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
                below = log_below = steps_below = None
                for k, g in enumerate(grams(vocabulary, words, lengths, order)):
                    n = _answered([(a["lo"], a["n"]) for a in got or () if a["k"] == k], len(g.hash), _worth(g, k, below, min_count))
                    with np.errstate(divide="ignore"):
                        if k == 0:
                            logs, back = np.log(n / max(1, tokens)), np.zeros(len(n), np.int64)
                        else:
                            seen = n > 0
                            logs = np.where(seen, np.log(np.maximum(n, 1) / np.maximum(below[g.ctx], 1)), math.log(alpha) + log_below[g.suf])
                            back = np.where(seen, 0, 1 + steps_below[g.suf])
                    own = (size > k).astype(np.int64) if k < order - 1 else np.maximum(size - k, 0)
                    doc = np.repeat(np.arange(len(ids)), own)
                    total += np.bincount(doc, weights=logs[g.top], minlength=len(ids))
                    steps += np.bincount(doc, weights=back[g.top], minlength=len(ids)).astype(np.int64)
                    below, log_below, steps_below = n, logs, back
                mean = np.divide(total, size, out=np.zeros(len(ids)), where=size > 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(size), pa.array(steps), pa.array(total), pa.array(mean)], names=["doc_id", "n_tokens", "n_backoff", "log_score", "mean_log_score"])

    return map_arrow(joined, run, f"doc_id {kind}, n_tokens bigint, n_backoff bigint, log_score double, mean_log_score double")


def oracle() -> str:
    """DuckDB SQL for order 3: count tables joined to the exploded n-grams."""
    return f"""
    WITH d AS (
      SELECT row_number() OVER () AS rid, doc_id,
             list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
      FROM documents),
    t AS (SELECT rid, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
    c1 AS (SELECT c, count(*) AS n FROM t GROUP BY c),
    c2 AS (SELECT b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b, c),
    c3 AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY a, b, c),
    s AS (
      SELECT rid, CASE WHEN t.a IS NOT NULL AND coalesce(abc.n, 0) < {MIN_COUNT} THEN 1 ELSE 0 END AS off3,
             CASE WHEN t.b IS NOT NULL AND coalesce(bc.n, 0) < {MIN_COUNT} THEN 1 ELSE 0 END AS off2,
             abc.n AS n3, ab.n AS n2a, bc.n AS n2, b1.n AS n1b, one.n AS n1, t.a IS NOT NULL AS has3, t.b IS NOT NULL AS has2
      FROM t JOIN c1 one ON one.c = t.c LEFT JOIN c1 b1 ON b1.c = t.b
             LEFT JOIN c2 bc ON bc.b = t.b AND bc.c = t.c LEFT JOIN c2 ab ON ab.b = t.a AND ab.c = t.b
             LEFT JOIN c3 abc ON abc.a = t.a AND abc.b = t.b AND abc.c = t.c),
    x AS (
      SELECT rid, CASE WHEN has3 AND off3 = 0 THEN 0 ELSE off3 + off2 END AS backed,
             CASE WHEN has3 AND off3 = 0 THEN ln(n3 / n2a)
                  WHEN has2 AND off2 = 0 THEN off3 * ln({ALPHA}) + ln(n2 / n1b)
                  ELSE (off3 + off2) * ln({ALPHA}) + ln(n1 / (SELECT count(*) FROM t)) END AS x
      FROM s),
    g AS (SELECT rid, count(*) AS n, sum(backed) AS b, sum(x) AS x FROM x GROUP BY rid)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_tokens, coalesce(b, 0)::BIGINT AS n_backoff,
           round(coalesce(x, 0.0), 4) + 0.0 AS log_score, round(coalesce(x / n, 0.0), 6) + 0.0 AS mean_log_score
    FROM d LEFT JOIN g USING (rid)"""
