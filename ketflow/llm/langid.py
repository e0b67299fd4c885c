"""Language identification by segmentation-marginalised unigrams (operator 7).

Each language has a probability for every piece of a fixed public vocabulary.  The
likelihood of a word is the sum over all its segmentations into pieces, computed by a
forward recursion, and that of a text is the product over its words; the score is the
posterior of the best language under equal priors.

All pieces of the vocabulary take part, up to its longest.  (Pieces with a word mark
after another sign or with signs that are no letters are in no word's lattice.)

Training runs expectation-maximisation: forward-backward over the words of a bounded
sample, ``SAMPLE`` texts a language in expectation, chosen by hash and written once.
Each round is one pass over the sample that returns expected counts, at most
vocabulary x languages numbers.  Training takes a word of over ``RUN`` signs as several
words of that many; scoring never cuts a word.  The recursion runs over all distinct
words of a batch at once in numpy, and a bounded cache holds the likelihoods of words
met before.  Scoring is one pass over all whole texts without a shuffle.

The posterior only compares the learnt languages, so it tells nothing about a text that
fits none of them.  For that a model also knows the mean log likelihood a sign of each
language's own sample; a text that falls below ``FLOOR`` times that of its best language
is not ``known`` (on the tables here texts reach 2.4 times, two strings of random keys 4.5 and 5.2 times).

Edge cases: null texts and texts without a letter get ``und``, score 0 and are not known;
rows without a language are scored but not learnt from; with no learnable row every text
is ``und``; ties go to the first language by name; repeated rows get the same answer
each; texts of any length are read whole, a long one costs memory in proportion; an empty
table gives no rows; extra columns pass through ``predict``, but for those that bear the
name of an output, which are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketflow.llm import pieces
from ketflow.llm.common import crc32_mod, discard, extended, map_arrow, materialize

SAMPLE = 2000
ROUNDS = 3
#: Most signs of a word in training.
RUN = 48
#: Multiple of a language's mean log likelihood a sign below which a text does not fit it, and the fewest letters that tell.
FLOOR, FEW_LETTERS = 3.0, 20
#: Files of the written sample, for as many tasks in training.
_FILES = 32
UNKNOWN = 1e-7
SMOOTH = 0.1
CACHE = 200_000
CHUNK = 20_000
#: Signs of a piece that are looked up everywhere; longer pieces only where their head occurs.
_HEAD = 4
_WORD = re.compile(r"[^\W\d_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower case, each with the word mark before it."""
    return _WORD.findall(text.lower()) if text else []


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Lattice:
    """Finds the vocabulary's pieces at every position of many words at once."""

    def __init__(self, path: str | None = None, words: list[str] | None = None) -> None:
        if words is None:
            words = sorted(p for p in pieces.vocabulary(path) if pieces.SPACE not in p[1:])
        self.words, self.n, self.longest = words, len(words), max(map(len, words), default=1)
        self.tables = []
        for size in range(1, self.longest + 1):
            of = [(i, p) for i, p in enumerate(words) if len(p) == size]
            if not of:
                self.tables.append(None)
                continue
            self.tables.append(self._table(self._hash([p for _, p in of]), [i for i, _ in of]))
        heads = np.unique(self._hash([p[:_HEAD] for p in words if len(p) > _HEAD]))
        self.heads = self._table(heads, list(range(len(heads))))

    @staticmethod
    def _hash(same_size: list[str]) -> np.ndarray:
        """Rolling hash of strings of one length."""
        codes = np.array([[ord(c) for c in p] for p in same_size], np.uint64).reshape(len(same_size), -1)
        h = np.zeros(len(codes), np.uint64)
        for k in range(codes.shape[1]):
            h = h * _MULT + codes[:, k] + np.uint64(1)
        return h

    @staticmethod
    def _table(h: np.ndarray, ids: list[int]) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Open hash table (keys, values, shift, longest probe) with one slot in sixteen filled."""
        bits = max(8, (len(ids) * 16 - 1).bit_length())
        keys, vals, longest = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64), 0
        for k, i, at in zip(h, ids, ((h * _MULT) >> np.uint64(64 - bits)).tolist(), strict=True):
            probe = 0
            while keys[(at + probe) % len(keys)]:
                probe += 1
            keys[(at + probe) % len(keys)], vals[(at + probe) % len(keys)] = k, i
            longest = max(longest, probe)
        return keys, vals, 64 - bits, longest

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray, int, int], h: np.ndarray) -> np.ndarray:
        keys, vals, shift, longest = table
        slot = ((h * _MULT) >> np.uint64(shift)).astype(np.int64)
        out = np.where(keys[slot] == h, vals[slot], -1)
        left = np.flatnonzero((keys[slot] != h) & (keys[slot] != 0))
        for probe in range(1, longest + 1):
            at = (slot[left] + probe) % len(keys)
            same = keys[at] == h[left]
            out[left[same]] = vals[at[same]]
            left = left[~same & (keys[at] != 0)]
        return out

    def find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(starts, lengths, ids per size): ids[s][k] is the piece of s + 1 signs at sign k, or -1; a lone unknown sign is piece n."""
        return self.find_marked([pieces.SPACE + w for w in words])

    def find_marked(self, marked: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """``find`` over words that bear their marks already."""
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        signs = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        starts = np.cumsum(lengths) - lengths
        left = np.repeat(starts + lengths, lengths) - np.arange(len(signs))
        h = np.zeros(len(signs), np.uint64)
        out = []
        at = None  # beyond _HEAD signs, only where a longer piece begins like that
        for size in range(1, self.longest + 1):
            n = len(signs) - size + 1
            if n <= 0:
                break
            t = self.tables[size - 1]
            ids = np.full(len(signs), -1, np.int32)
            if size <= _HEAD:
                h = h[:n] * _MULT + signs[size - 1 :] + np.uint64(1)
                if t is not None:
                    ids[:n] = np.where(left[:n] >= size, self._look(t, h), -1)
                if size == 1:
                    ids[ids < 0] = self.n
                if size == _HEAD:
                    at = np.flatnonzero((left[:n] > size) & (self._look(self.heads, h) >= 0))
                    h = h[at]
            else:
                fits = left[at] >= size
                at, h = at[fits], h[fits]
                if not len(at):
                    break
                h = h * _MULT + signs[at + size - 1] + np.uint64(1)
                if t is not None:
                    ids[at] = self._look(t, h)
            out.append(ids)
        return starts, lengths, out


def _sweep(lattice: Lattice, probs: np.ndarray, words: list[str], counts: np.ndarray | None = None) -> np.ndarray:
    """Log likelihood (words x languages); with ``counts`` also adds expected piece counts into it by backward sweeps.

    ``counts`` is a pair (weights of the words by language, array to add to).
    """
    starts, lengths, ids = lattice.find(words)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    n_lang, longest = probs.shape[1], int(lengths[0])
    keep = counts is not None
    ring = longest + 1 if keep else lattice.longest + 1
    alpha = np.zeros((ring, len(words), n_lang))
    alpha[0] = 1.0
    scale = np.zeros((len(words), n_lang))
    result = np.zeros((len(words), n_lang))
    active = np.searchsorted(-lengths, -np.arange(longest + 1), side="right")  # words of at least that length
    for j in range(1, longest + 1):
        k = active[j]
        now = np.zeros((k, n_lang))
        for size in range(1, min(j, len(ids)) + 1):
            piece = ids[size - 1][starts[:k] + j - size]
            at = np.flatnonzero(piece >= 0)
            if len(at):
                now[at] += alpha[(j - size) % ring, at] * probs[piece[at]]
        alpha[j % ring, :k] = now
        ended = active[j + 1] if j < longest else 0
        if ended < k:
            with np.errstate(divide="ignore"):
                result[ended:k] = np.log(now[ended:]) + scale[ended:k]
        if not keep and j % 8 == 0 and ended:
            small = np.flatnonzero(alpha[:, :ended].max(axis=0).min(axis=1) < 1e-60)
            if len(small):
                top = alpha[:, small].max(axis=0)
                alpha[:, small] /= top
                scale[small] += np.log(top)
    if keep:
        weights, into = counts
        weights = weights[order]
        total = alpha[lengths, np.arange(len(words))]
        beta = np.zeros_like(alpha)
        beta[lengths, np.arange(len(words))] = np.divide(weights, total, out=np.zeros_like(total), where=total > 0)
        for i in range(longest - 1, -1, -1):
            for size in range(1, len(ids) + 1):
                if i + size > longest:
                    break
                k = active[i + size]
                piece = ids[size - 1][starts[:k] + i]
                at = np.flatnonzero(piece >= 0)
                if len(at):
                    part = probs[piece[at]] * beta[i + size, at]
                    beta[i, at] += part
                    np.add.at(into, piece[at], alpha[i, at] * part)
    back = np.empty_like(result)
    back[order] = result
    return back


class Model:
    """Languages and piece probabilities, with a bounded cache of word likelihoods."""

    def __init__(self, languages: list[str], probs: np.ndarray, path: str | None = None, floors: np.ndarray | None = None) -> None:
        self.languages, self.probs, self.path = languages, probs, path
        self.floors = np.full(len(languages), -np.inf) if floors is None else floors
        self._lattice = None
        self._rows: dict[str, int] = {}
        self._logs = np.empty((0, len(languages)))

    def __getstate__(self) -> tuple:
        return self.languages, self.probs, self.path, self.floors

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _learn_words(self, texts: list[list[str]]) -> None:
        if self._lattice is None:
            self._lattice = Lattice(self.path)
        if len(self._rows) > CACHE:
            self._rows, self._logs = {}, self._logs[:0]
        new = list({w for t in texts for w in t}.difference(self._rows))
        new.sort(key=len)
        got = [self._logs]
        for at in range(0, len(new), CHUNK):
            got.append(_sweep(self._lattice, self.probs, new[at : at + CHUNK]))
        self._rows.update(zip(new, range(len(self._logs), len(self._logs) + len(new)), strict=True))
        self._logs = np.concatenate(got)

    def log_likelihoods(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each text by language, and the number of its letters."""
        words = [words_of(t) for t in texts]
        self._learn_words(words)
        get = self._rows.__getitem__
        logs = np.array([self._logs[np.fromiter(map(get, w), np.int64, len(w))].sum(axis=0) for w in words]).reshape(len(texts), -1)
        return logs, np.array([sum(map(len, w)) for w in words], np.int64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """(language, posterior, whether the text fits that language at all) of each text."""
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        names, scores, known = [], [], []
        for at in range(0, len(texts), 512):
            part = texts[at : at + 512]
            for t, l, n in zip(part, *self.log_likelihoods(part), strict=True):
                if not has_letter(t):
                    names.append("und")
                    scores.append(0.0)
                    known.append(False)
                    continue
                k = int(np.argmax(l))
                names.append(self.languages[k])
                scores.append(float(1.0 / np.exp(l - l[k]).sum()))
                known.append(bool(n < FEW_LETTERS or l[k] >= self.floors[k] * n))
        return names, scores, known


def _runs(word: str, most: int = RUN) -> list[str]:
    return [word[i : i + most] for i in range(0, len(word), most)]


def _floors(rows: DataFrame, model: Model) -> np.ndarray:
    """Least log likelihood a sign that texts of each language may have, from rows (lang, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        at = {k: i for i, k in enumerate(m.languages)}
        for b in batches:
            logs, n = m.log_likelihoods(b.column(1).to_pylist())
            own = np.array([at[k] for k in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(logs[np.arange(len(own)), own]), pa.array(n)], names=["k", "l", "n"])

    out = np.full(len(model.languages), -np.inf)
    for r in map_arrow(rows, run, "k bigint, l double, n bigint").groupBy("k").agg(F.sum("l").alias("l"), F.sum("n").alias("n")).collect():
        if r.n:
            out[r.k] = FLOOR * r.l / r.n
    return out


def train(docs: DataFrame, learn: Column | None = None, sample: int = SAMPLE, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str | None = None) -> Model:
    """Fit the piece probabilities on about ``sample`` texts a language among the rows where ``learn`` holds."""
    lang, key = F.col(lang_col), F.col(id_col)
    known = docs.filter(lang.isNotNull() & (F.lit(True) if learn is None else learn))
    totals = {r.lang: r.n for r in known.groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], np.empty((0, 0)), path)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample / totals[k]))])
    drawn = F.pmod(F.xxhash64(key, F.lit("langid")), F.lit(1 << 30)) < F.element_at(share, lang) * float(1 << 30)
    rows = materialize(known.filter(drawn).select(lang.alias("lang"), F.col(text_col).alias("text")).repartition(_FILES))
    size = Lattice(path).n
    probs = np.full((size + 1, len(languages)), 1.0 / size)
    probs[-1] = UNKNOWN
    sc = docs.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast((languages, probs))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, p = shared.value
            at = {k: i for i, k in enumerate(names)}
            lattice, into = Lattice(path), np.zeros_like(p)
            held: dict[str, Counter] = {k: Counter() for k in names}

            def flush() -> None:
                words = sorted({w for c in held.values() for w in c}, key=len)
                for a in range(0, len(words), CHUNK // 4):
                    part = words[a : a + CHUNK // 4]
                    weight = np.array([[held[k][w] for k in names] for w in part], float)
                    _sweep(lattice, p, part, (weight, into))
                for c in held.values():
                    c.clear()

            for b in batches:
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    held[k].update(x for w in words_of(t) for x in _runs(w))
                    if sum(map(len, held.values())) > CACHE:
                        flush()
            flush()
            piece, k = np.nonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(k, pa.int64()), pa.array(into[piece, k])], names=["piece", "k", "n"])

        counts = np.full_like(probs, SMOOTH)
        got = map_arrow(rows, expect, "piece bigint, k bigint, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toArrow()
        counts[got["piece"].to_numpy(), got["k"].to_numpy()] += got["n"].to_numpy()
        probs = counts / counts[:-1].sum(axis=0)
        probs[-1] = UNKNOWN
    model = Model(languages, probs, path)
    model.floors = _floors(rows, model)
    discard(rows)
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", out: str = "lang_pred", out_score: str = "score", out_known: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` plus the predicted language, its posterior and, if asked, whether the text fits it at all."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs, schema = extended(docs, **{out: "string", out_score: "double"}, **({out_known: "boolean"} if out_known else {}))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores, known = shared.value.predict(b.column(at).to_pylist())
            new = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.bool_())][: 3 if out_known else 2]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[f"c{i}" for i in range(b.num_columns + len(new))])

    return map_arrow(docs, run, schema)


def learns(doc_id: Column) -> Column:
    """Rows whose languages may be learnt."""
    return crc32_mod(doc_id, 4) != 2
