"""Toxicity by compression distance (operator 1), with zstandard dictionaries.

Two dictionaries are trained: one on ordinary text, one on the spans of toxic texts that
ordinary ones seldom have: runs of byte 5-grams that at least ``LEAST`` toxic training
texts hold and that are, smoothed, ``RATIO`` times as frequent there as in ordinary ones.
(Trained on toxic text as it stands, a dictionary mostly holds ordinary words, and the
lengths of windows tell next to nothing; README has the figures.)  Every text is cut into
windows of ``WINDOW`` words.  Each window is compressed with the ordinary dictionary alone
and with the toxic one put before it; as both share their ordinary part, the difference in
length is what toxic content alone saves.  A text's distance is the sum of its ``TOP``
greatest savings, and a monotone calibration (isotonic, on sample rows kept apart) turns
it into a score.

The model is fitted on a bounded sample of labelled rows: at most ``MAX_TOXIC`` and
``MAX_ORDINARY`` ids, those of least hash, and of these texts at most ``MAX_BYTES`` bytes,
so its cost does not grow with the corpus.  Scoring covers every window of every text, in
one pass without a shuffle.

Edge cases: null, blank and wordless texts have no window, distance 0 and the score of
distance 0; without a toxic or an ordinary training row every score is 0; repeated
labels of an id count once (the greatest); repeated rows get the same score each, as do
texts of equal distance; texts of any length are scored whole, ``CHUNK`` windows at a time;
an empty table gives no rows; extra columns pass through ``score``, but for one with the
name of the output, which is replaced.
"""

from __future__ import annotations

import heapq
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketflow.llm.common import crc32_mod, extended, map_arrow

MAX_TOXIC, MAX_ORDINARY, MAX_BYTES = 2000, 6000, 64 << 20
WINDOW, GRAM, TOP = 4, 5, 3
#: Toxic training texts that must hold a gram, and how much more frequent it must be there than in ordinary ones.
LEAST, RATIO = 3, 20.0
#: Windows of a text that are compressed at once, and distances that the calibration tells apart.
CHUNK, LEVELS = 1 << 14, 65
TOXIC_BYTES, ORDINARY_BYTES = 4096, 1024
#: Bytes of the ordinary dictionary put before each window: a sure match in both, so that the fixed cost of a compressed block cancels out.
CARRIER = 32
THRESHOLD = 0.7
_TABLE = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_PARAMS = zstandard.ZstdCompressionParameters(window_log=17, hash_log=14, chain_log=14, search_log=5, min_match=GRAM, target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_TABLE).split()


def windows_of(text: str | None, size: int = WINDOW) -> list[bytes]:
    """All windows of ``size`` words, the last one shorter, spaced on both ends."""
    w = words_of(text)
    return [b" " + b" ".join(w[k : k + size]) + b" " for k in range(0, len(w), size)]


def _grams(text: bytes) -> list[bytes]:
    return [text[i : i + GRAM] for i in range(len(text) - GRAM + 1)]


def _spans(text: bytes, wanted: set[bytes]) -> list[bytes]:
    """Maximal stretches of ``text`` all of whose grams are wanted."""
    out, start = [], None
    grams = _grams(text)
    for i, g in enumerate([*grams, b""]):
        if g in wanted:
            start = i if start is None else start
        elif start is not None:
            out.append(text[start : i + GRAM - 1])
            start = None
    return out


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; of too few samples for the trainer, their distinct text itself."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(dict.fromkeys(samples))[-size:]


@dataclass
class Model:
    """Both dictionaries and the calibrated probability of each distance."""

    ordinary: bytes
    toxic: bytes
    score_of: np.ndarray

    def __post_init__(self) -> None:
        self._pair = None

    def __getstate__(self) -> tuple:
        return self.ordinary, self.toxic, self.score_of

    def __setstate__(self, state: tuple) -> None:
        self.ordinary, self.toxic, self.score_of = state
        self._pair = None

    def savings(self, windows: list[bytes]) -> list[int]:
        """Bytes that the toxic dictionary saves in each window."""
        if self._pair is None:
            pair = []
            for content in (self.ordinary, self.toxic + self.ordinary):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=_PARAMS)
                pair.append(zstandard.ZstdCompressor(dict_data=d, compression_params=_PARAMS))
            self._pair = pair
        carried = [self.ordinary[-CARRIER:] + w for w in windows]
        plain, toxic = (c.multi_compress_to_buffer(carried) for c in self._pair)
        return [len(a) - len(b) for a, b in zip(plain, toxic, strict=True)]

    def distance(self, text: str | None) -> int:
        """Sum of the ``TOP`` greatest savings of the text's windows."""
        if not self.toxic:
            return 0
        windows, best = windows_of(text), [0] * TOP
        for at in range(0, len(windows), CHUNK):
            best = heapq.nlargest(TOP, [*best, *self.savings(windows[at : at + CHUNK])])
        return sum(best)

    def score(self, text: str | None) -> float:
        return float(self.score_of[min(self.distance(text), len(self.score_of) - 1)])


def _isotonic(distance: np.ndarray, toxic: np.ndarray, weight: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Monotone probability of each distance by pooling adjacent violators, with half a row of each label at the ends."""
    blocks: list[list[float]] = []
    for k in range(levels):
        at = np.minimum(distance, levels - 1) == k
        pos, all_ = float((weight * toxic)[at].sum()), float(weight[at].sum())
        if k == 0:
            all_ += 0.5
        if k == levels - 1:
            pos, all_ = pos + 0.5, all_ + 0.5
        blocks.append([pos, all_, 1])
        while len(blocks) > 1 and (blocks[-1][1] == 0 or blocks[-2][1] and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]):
            p, a, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p, blocks[-1][1] + a, blocks[-1][2] + n]
    return np.concatenate([np.full(int(n), p / a if a else 0.0) for p, a, n in blocks])


def telling_grams(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """Grams that enough toxic texts hold and that are ``RATIO`` times as frequent there, by smoothed document frequency."""
    held: Counter[bytes] = Counter()
    for t in toxic:
        held.update(set(_grams(t)))
    held = Counter({g: n for g, n in held.items() if n >= LEAST})
    plain: Counter[bytes] = Counter()
    for t in ordinary:
        plain.update(held.keys() & set(_grams(t)))
    return {g for g, n in held.items() if (n + 0.5) / (len(toxic) + 1) >= RATIO * (plain[g] + 0.5) / (len(ordinary) + 1)}


def fit(texts: list[str | None], labels: list[int], toxic_total: int, ordinary_total: int) -> Model:
    """Model of sample texts; two of three train the dictionaries, the third calibrates.

    The totals are the numbers of labelled rows that the sample stands for.
    """
    y = np.array(labels, np.int64)
    if not (y == 1).any() or not (y == 0).any():
        return Model(b"", b"", np.zeros(2))
    rank = np.zeros(len(y), np.int64)
    for k in (0, 1):
        rank[y == k] = np.arange((y == k).sum())
    learns = rank % 3 != 2
    flat = [b" " + b" ".join(words_of(t)) + b" " for t in texts]
    ordinary = [t for t, k, use in zip(flat, labels, learns, strict=True) if use and not k]
    toxic = [t for t, k, use in zip(flat, labels, learns, strict=True) if use and k]
    wanted = telling_grams(toxic, ordinary)
    own = [b"\n".join(s) + b"\n" for t in toxic if (s := _spans(t, wanted))]
    samples = [w for t, k, use in zip(texts, labels, learns, strict=True) if use and not k for w in windows_of(t, 32)]
    model = Model(train_dictionary(samples, ORDINARY_BYTES), train_dictionary(own, TOXIC_BYTES) if own else b"", np.zeros(2))
    rest = ~learns if (~learns & (y == 1)).any() and (~learns & (y == 0)).any() else np.ones(len(y), bool)
    distance = np.array([model.distance(t) for t, use in zip(texts, rest, strict=True) if use])
    # each class as heavy as its share of all labelled rows, the sample's size in all
    share = toxic_total / max(1, toxic_total + ordinary_total)
    at = y[rest]
    weight = np.where(at == 1, share / max(1, (at == 1).sum()), (1 - share) / max(1, (at == 0).sum())) * len(at)
    model.score_of = _isotonic(distance, at, weight)
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> Model:
    """Fit on the labelled rows for which ``learn`` holds (a condition on the id).

    The sample's ids (a bounded number) are broadcast to one scan of the documents; the
    fit runs in one task on the sample's texts and returns the two small dictionaries.
    """
    key, y = F.col(id_col), F.col(label_col)
    known = labels.filter(y.isin(0, 1) & (F.lit(True) if learn is None else learn)).groupBy(key.alias("k")).agg(F.max(y).cast("int").alias("y"))
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("k"), F.lit("toxicity"))
    ids = known.filter("y = 1").orderBy(order, "k").limit(max_toxic).unionByName(known.filter("y = 0").orderBy(order, "k").limit(max_ordinary))
    sample = docs.select(key.alias("k"), F.col(text_col).alias("text")).join(F.broadcast(ids), "k").groupBy("k").agg(F.max("text").alias("text"), F.max("y").alias("y"))
    toxic_total, ordinary_total = totals.get(1, 0), totals.get(0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held < MAX_BYTES:
                    rows.append((text, y))
                    held += len(text or "")
        model = fit([r[0] for r in rows], [r[1] for r in rows], toxic_total, ordinary_total)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    ordered = sample.select("text", "y", F.xxhash64("k").alias("h")).repartition(1).sortWithinPartitions("h", "text").select("text", "y")
    got = map_arrow(ordered, run, "model binary").collect()
    return pickle.loads(bytes(got[0].model)) if got else Model(b"", b"", np.zeros(2))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` plus double ``out``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs, schema = extended(docs, **{out: "double"})
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array([shared.value.score(t) for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[f"c{i}" for i in range(b.num_columns + 1)])

    return map_arrow(docs, run, schema)


def learns(doc_id: Column) -> Column:
    """Rows whose labels may be learnt."""
    return crc32_mod(doc_id, 3) != 1
