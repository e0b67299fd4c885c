"""Benchmark decontamination (operator 9): a prefix-filtered set join with exact verification.

Every item is cut into windows (``window`` consecutive words; the whole item if it
has fewer).  A window occurs in a document only if all its shingles do, so for the
similarity asked (all of the window) the necessary prefix is one shingle: the rarest
over all documents.  One pass counts the benchmark's shingles over all documents,
the second pass looks each document's shingles up in the prefix index, applies the
positional and length bounds (the window must fit around the position), and verifies
the words of the whole window.

The benchmark is read in blocks of at most ``BLOCK_WORDS`` words.  An item that is longer
is cut into pieces that overlap by a window less one word, so that pieces have the
item's windows, each once.  A block's index is a set of arrays, ``Index.nbytes`` in all
(some 100 bytes a word), plus its dictionary of distinct words; it is what is broadcast,
and its bound does not depend on the size of the benchmark.  Each block costs two scans
of the documents without a shuffle.  From the second block on, the result is written
between blocks, so that a worker holds one index at a time.  Documents are never
shuffled, grouped or collected, so hot passages only cost the documents they are in.

Edge cases: null and wordless texts have 0 words and no hits; null or wordless items
have no windows; repeated items count once by id; a null item_id counts as the id "";
an empty benchmark hits nothing; equally rare shingles: the first in the window is its
prefix; repeated rows get the same answer each; an empty table gives no rows; texts and
items of any length are read whole, a text in memory in proportion to it; extra columns
pass through ``matches`` untouched, but for one with the name of the output, which is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ketflow.llm.common import columns_of, discard, extended, map_arrow, materialize

WINDOW = 10
SHINGLE = 3
BLOCK_WORDS = 1 << 18
#: Candidate windows of a text that are verified at once.
_CHUNK = 1 << 16
#: Lower case A-Z, and white space for the ASCII signs that are no word signs.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else (32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b) for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, over UTF-8 bytes."""
    return (text or b"").translate(_TABLE).split()


def pieces_of(items: Iterable[tuple[str, bytes | None]], window: int = WINDOW, most: int = BLOCK_WORDS) -> Iterator[tuple[str, list[bytes]]]:
    """(item, words) of every item with words; one of over ``most`` words in pieces that share window - 1 words."""
    most = max(most, window)
    for item, text in items:
        words = words_of(text)
        for at in range(0, max(1, len(words) - window + 1) if words else 0, most - window + 1):
            yield item, words[at : at + most]


class Index:
    """Windows of one benchmark block, with exact integer codes for words and shingles.

    ``levels[k]`` are the sorted codes of the block's shingles of k + 1 words: the rank of
    the first k words among theirs, times the number of words, plus the last word.
    """

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int = WINDOW, shingle: int = SHINGLE) -> None:
        self.window, self.shingle = window, shingle
        self.word_ids: dict[bytes, int] = {}
        self.names: list[str] = sorted({item for item, _ in pieces})
        name_at = {n: i for i, n in enumerate(self.names)}
        sizes = np.array([len(w) for _, w in pieces], np.int64)
        self.flat = np.fromiter((self.word_ids.setdefault(x, len(self.word_ids)) for _, w in pieces for x in w), np.int32, int(sizes.sum()))
        self.base = np.int64(len(self.word_ids) + 1)
        starts = np.cumsum(sizes) - sizes
        n = np.maximum(sizes - window + 1, 1)
        at = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        length = np.repeat(np.minimum(sizes, window), n)
        owner = np.repeat(np.array([name_at[item] for item, _ in pieces], np.int64), n)
        rows = np.where(np.arange(window) < length[:, None], self.flat[np.minimum(at[:, None] + np.arange(window), max(0, len(self.flat) - 1))], -2) if len(at) else np.empty((0, window), np.int32)
        _, first, same = np.unique(np.ascontiguousarray(rows.astype(np.int32)).view([("", np.int32)] * window).reshape(-1), return_index=True, return_inverse=True)
        self.at, self.length = at[first].astype(np.int32), length[first].astype(np.int32)
        pairs = np.unique(same * np.int64(len(self.names) + 1) + owner) if len(at) else np.empty(0, np.int64)
        self.item = (pairs % (len(self.names) + 1)).astype(np.int32)
        self.item_from = np.searchsorted(pairs // (len(self.names) + 1), np.arange(len(first) + 1)).astype(np.int32)
        self.sizes = sorted({min(shingle, int(x)) for x in np.unique(self.length)})
        self._learn(starts, sizes)
        edges = np.cumsum([0, *(len(self.levels[size - 1]) for size in self.sizes)])
        self.code_from = dict(zip(self.sizes, edges.tolist(), strict=False))
        self.counts = np.zeros(int(edges[-1]), np.int64)

    def _learn(self, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Codes of all shingles of the block, and their ranks by place in ``flat``."""
        left = np.repeat(starts + sizes, sizes) - np.arange(len(self.flat))
        rank = self.flat.astype(np.int64)
        self.levels, self.rank_at = [np.arange(len(self.word_ids), dtype=np.int64)], [rank.astype(np.int32)]
        for size in range(2, self.shingle + 1):
            at = np.flatnonzero(left >= size)
            codes, inverse = np.unique(rank[at] * self.base + self.flat[at + size - 1], return_inverse=True)
            rank = np.full(len(self.flat), -1, np.int64)
            rank[at] = inverse
            self.levels.append(codes)
            self.rank_at.append(rank.astype(np.int32))

    @property
    def nbytes(self) -> int:
        """Bytes of all arrays."""
        arrays = [x for x in vars(self).values() if isinstance(x, np.ndarray)] + self.levels + self.rank_at
        return sum(x.nbytes for x in arrays)

    def encode(self, text: bytes | None) -> np.ndarray:
        """Word ids of a text; -1 stands for every word that the block lacks."""
        get = self.word_ids.get
        words = words_of(text)
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def shingles(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, places in the text, numbers among all counted shingles) of the block's shingles that occur in a text."""
        at = np.flatnonzero(ids >= 0)
        rank = ids[at]
        for size in range(1, max(self.sizes, default=0) + 1):
            if size > 1:
                at, rank = at[at + size <= len(ids)], rank[at + size <= len(ids)]
                last = ids[at + size - 1]
                at, code = at[last >= 0], (rank * self.base + last)[last >= 0]
                level = self.levels[size - 1]
                if not len(level):
                    return
                rank = np.minimum(np.searchsorted(level, code), len(level) - 1)
                at, rank = at[level[rank] == code], rank[level[rank] == code]
            if size in self.code_from:
                yield size, at, rank + self.code_from[size]

    def count(self, text: bytes | None, into: np.ndarray) -> None:
        """Add the text's shingles, each once, to the document frequencies ``into``."""
        for _, _, number in self.shingles(self.encode(text)):
            into[np.unique(number)] += 1

    def choose_prefixes(self, counts: np.ndarray) -> None:
        """Index every window under its rarest shingle (ties: the first)."""
        self.counts = counts
        size = np.minimum(self.shingle, self.length).astype(np.int64)
        number, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        least = np.full(len(size), np.iinfo(np.int64).max)
        for k in range(self.window):
            for s in self.sizes:
                w = np.flatnonzero((size == s) & (k + s <= self.length))
                if len(w):
                    mine = self.rank_at[s - 1][self.at[w] + k] + self.code_from[s]
                    better = counts[mine] < least[w]
                    w, mine = w[better], mine[better]
                    least[w], number[w], offset[w] = counts[mine], mine, k
        order = np.argsort(number, kind="stable")
        self.prefix_window, self.prefix_offset = order.astype(np.int32), offset[order].astype(np.int32)
        self.prefix_from = np.searchsorted(number[order], np.arange(len(counts) + 1)).astype(np.int32)

    def match(self, text: bytes | None) -> tuple[int, np.ndarray, list[str]]:
        """(number of words, mask of hit words, items with an occurring window, in order)."""
        ids = self.encode(text)
        mark = np.zeros(len(ids) + 1, np.int64)
        found: list[np.ndarray] = []
        for _, at, number in self.shingles(ids):
            lo, n = self.prefix_from[number].astype(np.int64), (self.prefix_from[number + 1] - self.prefix_from[number]).astype(np.int64)
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            upto = np.cumsum(n)
            for a in range(0, int(upto[-1]) if len(n) else 0, _CHUNK):
                k = np.arange(a, min(a + _CHUNK, int(upto[-1])))
                j = np.searchsorted(upto, k, side="right")
                place = lo[j] + k - (upto[j] - n[j])
                w, s = self.prefix_window[place].astype(np.int64), at[j] - self.prefix_offset[place]
                fits = (s >= 0) & (s + self.length[w] <= len(ids))
                w, s = w[fits], s[fits]
                for d in range(self.window):
                    inside = d < self.length[w]
                    same = ~inside | (ids[np.minimum(s + d, len(ids) - 1)] == self.flat[np.minimum(self.at[w] + d, len(self.flat) - 1)])
                    w, s = w[same], s[same]
                np.add.at(mark, s, 1)
                np.add.at(mark, s + self.length[w], -1)
                found.append(np.unique(w))
        windows = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        items = np.unique(np.concatenate([self.item[self.item_from[w] : self.item_from[w + 1]] for w in windows.tolist()])) if len(windows) else []
        return len(ids), np.cumsum(mark)[: len(ids)] > 0, [self.names[i] for i in items]


def _spans(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0])).tolist()
    return [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]


_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
_FOUND_DDL = "struct<n_words: bigint, spans: array<struct<start: bigint, end: bigint>>, items: array<string>>"


def _blocks(bench: DataFrame, block_words: int, window: int, id_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark's pieces in blocks of at most ``block_words`` words; the driver holds one partition of items and one block."""
    rows = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("binary").alias("text"))
    block, held, some = [], 0, False
    for item, words in pieces_of(((r.item, None if r.text is None else bytes(r.text)) for r in rows.toLocalIterator()), window, block_words):
        if held + len(words) > block_words and block:
            yield block
            block, held, some = [], 0, True
        block.append((item, words))
        held += len(words)
    if block or not some:
        yield block


def matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out: str = "found") -> DataFrame:
    """All rows and columns of ``docs`` plus struct ``out``: n_words, hit spans [start, end) of words, item ids."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    docs, schema = extended(docs, **{out: _FOUND_DDL})
    done = docs.select(*columns_of(docs), F.lit(None).cast(_FOUND_DDL).alias(out))
    at_text, at_out = schema.fieldNames().index(text_col), len(schema) - 1
    written = None
    for turn, block in enumerate(_blocks(bench, block_words, window, item_col, item_text_col)):
        index = Index(block, window, shingle)
        shared = sc.broadcast(index)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            got = np.zeros(len(shared.value.counts), np.int64)
            for b in batches:
                for t in b.column(0).to_pylist():
                    shared.value.count(t, got)
            some = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(got[some])], names=["code", "n"])

        counts = np.zeros(len(index.counts), np.int64)
        if len(counts):
            got = map_arrow(texts, count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
            counts[got["code"].to_numpy()] = got["n"].to_numpy()
        index.choose_prefixes(counts)
        ready = sc.broadcast(index)

        def look(batches: Iterator[pa.RecordBatch], ready=ready) -> Iterator[pa.RecordBatch]:
            index = ready.value
            for b in batches:
                found = []
                for text, old in zip(b.column(at_text).to_pylist(), b.column(at_out).to_pylist(), strict=True):
                    n, hit, items = index.match(None if text is None else text.encode())
                    if old:
                        items = sorted({*items, *old["items"]})
                        for s in old["spans"]:
                            hit[s["start"] : s["end"]] = True
                    found.append({"n_words": n, "spans": _spans(hit), "items": items})
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, _FOUND)], names=[f"c{i}" for i in range(b.num_columns)])

        if turn:  # one index at a time in a worker
            last, written = written, materialize(done)
            done = written
            if last is not None:
                discard(last)
        done = map_arrow(done, look, schema)
    return done


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's output."""
    f = F.col("found")
    n_hit = F.aggregate(f["spans"], F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", f["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def oracle() -> str:
    """DuckDB SQL: windows of all lengths joined to the document's own runs of words."""
    words = "list_filter(regexp_split_to_array(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""
    WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words.format(t="text")} AS w FROM benchmark),
    bw AS (
      SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS win
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    d AS (SELECT row_number() OVER () AS rid, doc_id, {words.format(t="text")} AS w FROM documents),
    dw AS (
      SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
      FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
    hit AS (SELECT DISTINCT rid, i, n, item FROM dw JOIN bw USING (n, win)),
    pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid),
    its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)"""
