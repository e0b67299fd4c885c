"""SentencePiece encoding and decoding with N-best segmentation (operator 3).

The piece lattice of a text has an arc for every piece of the public vocabulary that
fits, and byte arcs for signs it lacks.  Scores of forward Viterbi are exact
heuristics for a backward A-star search, which therefore pops whole segmentations in
order of score.  No piece has a space mark after another sign, so the lattice of a text
falls apart at the starts of words: words are searched on their own and met again from
a bounded cache, and the N best of the text are the N best sums over its words, for
which only the N - 1 words with the smallest gaps to their second best can matter.

The model file holds merge ranks and no probabilities; pieces are scored by Zipf's law
on the rank, log 1 / (rank + ``ZIPF``), in whole millionths.  A literal word mark is encoded by bytes and
runs of white space are kept, so decoding gives back every text exactly.

One pass over whole texts in Arrow batches, no shuffle.  Forward scores of all new
words of a batch are computed at once in numpy.

Edge cases: a null text has no pieces, decodes to null and has one segmentation of
score 0, as has the empty text, which decodes to itself; ties go to the segmentation
with the longer last pieces; repeated rows are encoded alike; an empty table gives no
rows; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ketflow.llm import pieces
from ketflow.llm.common import CACHES, extended, map_arrow
from ketflow.llm.langid import Lattice

N_BEST = 4
ZIPF = 10.0
#: Scores are kept as whole millionths, so that sums are exact.
UNIT = 1_000_000
_NEVER = -(1 << 60)
CACHE = 300_000
CELLS = 1_500_000
_MARK = pieces.SPACE
#: Stands for a literal word mark inside the lattice; no piece has it.
_LITERAL = "\ue000"
_CHUNK = re.compile(f" *[^ \n{_MARK}]+| +|\n|{_MARK}")


class Codec:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, path: str | None = None) -> None:
        sp = pieces.load(path)
        vocabulary = pieces.vocabulary(path)
        usable = {p: i for p, i in vocabulary.items() if not any(a != _MARK and b == _MARK for a, b in zip(p, p[1:], strict=False)) and "\n" not in p}
        self.longest = max(map(len, usable))
        least = min(usable.values())
        self.score = {p: -round(UNIT * float(np.log(i - least + ZIPF))) for p, i in usable.items()}
        self.ids = usable
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_score = -round(UNIT * float(np.log(sp.get_piece_size() + ZIPF)))
        self.surface: list[bytes] = [b""] * sp.get_piece_size()
        for p, i in vocabulary.items():
            self.surface[i] = p.replace(_MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.surface[i] = bytes([b])
        self.lattice = Lattice(path, sorted(usable))
        names = self.lattice.words
        self.piece_id = np.array([usable[p] for p in names], np.int32)
        self.piece_score = np.array([self.score[p] for p in names], np.int64)
        self._known: dict[str, tuple[bytes, int, int]] = {}
        self._lists: dict[tuple[str, int], list] = {}

    # -- one chunk: A-star ---------------------------------------------------

    def _arcs(self, s: str, end: int, chunk: str) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(start, score, ids) of the arcs of ``chunk`` with lattice form ``s`` that end at ``end``."""
        for size in range(1, min(end, self.longest) + 1):
            p = s[end - size : end]
            i = self.ids.get(p)
            if i is not None:
                yield end - size, self.score[p], (i,)
            elif size == 1:
                raw = chunk[end - 1].encode()
                yield end - 1, self.byte_score * len(raw), tuple(self.byte_ids[b] for b in raw)

    @staticmethod
    def marked(chunk: str) -> str:
        """Lattice form of a chunk: spaces are word marks, and a literal mark becomes a sign that has no piece."""
        return _LITERAL if chunk == _MARK else chunk.replace(" ", _MARK)

    def nbest_chunk(self, chunk: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` best (score, ids) of one chunk, best first.

        Scores are whole numbers, so equal segmentations are equal exactly and the search
        goes straight on with the one that is closest to the start.
        """
        s = self.marked(chunk)
        best = [0] * (len(s) + 1)
        arcs: list[list] = [[]]
        for end in range(1, len(s) + 1):
            got = list(self._arcs(s, end, chunk))
            arcs.append(got)
            best[end] = max(best[a] + sc for a, sc, _ in got)
        out, heap, serial = [], [(-best[len(s)], len(s), 0, 0, None)], 0
        while heap and len(out) < n:
            _, at, _, done, tail = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while tail is not None:
                    ids += tail[0]
                    tail = tail[1]
                out.append((done, tuple(ids)))
                continue
            for a, sc, ids in arcs[at]:
                serial += 1
                heapq.heappush(heap, (-(done + sc + best[a]), a, serial, done + sc, (ids, tail)))
        return out

    # -- many chunks: forward Viterbi with the second best -------------------

    def _viterbi(self, chunks: list[str]) -> None:
        """Best ids, best score and gap to the second best of new chunks (sorted by length)."""
        lengths, starts, n = np.array([len(c) for c in chunks]), 0, len(chunks)
        while starts < n:
            width = int(lengths[starts])
            stop = starts
            while stop < n and (stop - starts + 1) * (int(lengths[stop]) + 1) <= max(CELLS, width + 1):
                stop += 1
            self._viterbi_block(chunks[starts : max(stop, starts + 1)])
            starts = max(stop, starts + 1)

    def _viterbi_block(self, chunks: list[str]) -> None:
        forms = [self.marked(c) for c in chunks][::-1]  # longest first
        names = chunks[::-1]
        at, lengths, ids = self.lattice.find_marked(forms)
        m, longest = len(forms), int(lengths[0])
        best = np.full((longest + 1, m), _NEVER)
        second = np.full((longest + 1, m), _NEVER)
        step = np.zeros((longest + 1, m), np.int8 if self.longest < 128 else np.int32)
        best[0] = 0
        signs = np.frombuffer("".join(forms).encode("utf-32-le"), np.uint32)
        n_bytes = 1 + (signs >= 0x80).astype(np.int64) + (signs >= 0x800) + (signs >= 0x10000)
        active = np.searchsorted(-lengths, -np.arange(longest + 1), side="right")
        for j in range(1, longest + 1):
            k = active[j]
            for size in range(1, min(j, len(ids)) + 1):
                piece = ids[size - 1][at[:k] + j - size]
                use = np.flatnonzero(piece >= 0)
                if not len(use):
                    continue
                p = piece[use]
                if size == 1:
                    lone = p == self.lattice.n
                    sc = np.where(lone, self.byte_score * n_bytes[at[use] + j - 1], self.piece_score[np.where(lone, 0, p)])
                else:
                    sc = self.piece_score[p]
                b, s2 = best[j - size, use] + sc, second[j - size, use] + sc
                old, old2 = best[j, use], second[j, use]
                better = b >= old  # ties to the longer last piece, as in the search
                second[j, use] = np.maximum(np.where(better, old, b), np.maximum(s2, old2))
                best[j, use] = np.where(better, b, old)
                step[j, use[better]] = size
        pos, row = lengths.copy(), np.arange(m)
        out_row, out_piece, out_at = [], [], []
        live = row
        while len(live):
            size = step[pos[live], live].astype(np.int64)
            begin = pos[live] - size
            got = np.empty(len(live), np.int64)
            for z in np.unique(size).tolist():
                sel = size == z
                got[sel] = ids[z - 1][at[live[sel]] + begin[sel]]
            out_row.append(live)
            out_piece.append(got)
            out_at.append(begin)
            pos[live] = begin
            live = live[begin > 0]
        r, p, b = np.concatenate(out_row), np.concatenate(out_piece), np.concatenate(out_at)
        order = np.lexsort((b, r))
        r, p, b = r[order], p[order], b[order]
        bounds = np.searchsorted(r, np.arange(m + 1))
        whole = np.where(p == self.lattice.n, -1, self.piece_id[np.minimum(p, self.lattice.n - 1)]).astype(np.int32)
        lone_rows = set(r[p == self.lattice.n].tolist())
        raw = whole.tobytes()
        end_best, end_second = best[lengths, row], second[lengths, row]
        for i, name in enumerate(names):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            if i in lone_rows:
                flat: list[int] = []
                for piece, begin in zip(whole[lo:hi].tolist(), b[lo:hi].tolist(), strict=True):
                    flat += [piece] if piece >= 0 else [self.byte_ids[x] for x in name[begin].encode()]
                code = np.array(flat, np.int32).tobytes()
            else:
                code = raw[4 * lo : 4 * hi]
            gap = int(end_best[i] - end_second[i]) if end_second[i] > _NEVER // 2 else -1
            self._known[name] = (code, int(end_best[i]), gap)

    # -- texts ---------------------------------------------------------------

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Chunks of the text with the leading space that marks its first word."""
        return _CHUNK.findall(" " + text) if text else []

    def _prepare(self, texts: list[list[str]]) -> None:
        if len(self._known) > CACHE:
            self._known, self._lists = {}, {}
        new = list({c for t in texts for c in t}.difference(self._known))
        new.sort(key=len)
        self._viterbi(new)

    def encode_batch(self, texts: list[str | None], n: int = N_BEST) -> list[tuple[bytes, list[float]]]:
        """(ids of the best segmentation as int32 bytes, scores of the n best) of each text."""
        cut = [self.chunks(t) if t else [] for t in texts]
        self._prepare(cut)
        get = self._known.__getitem__
        out = []
        for c in cut:
            if not c:
                out.append((b"", [0.0]))
                continue
            got = list(map(get, c))
            codes, scores, gaps = zip(*got, strict=True)
            total = sum(scores)
            out.append((b"".join(codes), [(total - loss) / UNIT for loss, _ in self._losses(c, np.array(gaps, np.int64), n)]))
        return out

    def _chunk_losses(self, chunk: str, n: int) -> list[int]:
        key = (chunk, n)
        if key not in self._lists:
            found = self.nbest_chunk(chunk, n)
            self._lists[key] = [found[0][0] - s for s, _ in found]
        return self._lists[key]

    def _losses(self, chunks: list[str], gaps: np.ndarray, n: int) -> list[tuple[int, dict[int, int]]]:
        """The n least (loss, rank by chunk position) over choices of a segmentation for each chunk.

        ``gaps`` are losses to the second best of each chunk, -1 where there is none.
        """
        open_ = np.flatnonzero(gaps >= 0)
        if len(open_) > n - 1:
            key = gaps[open_]
            kth = np.partition(key, n - 2)[n - 2] if n > 1 else -1
            less, same = open_[key < kth], open_[key == kth]
            open_ = np.sort(np.concatenate([less, same[: n - 1 - len(less)]])) if n > 1 else open_[:0]
        sums: list[tuple[int, dict[int, int]]] = [(0, {})]
        for at in open_.tolist():
            own = self._chunk_losses(chunks[at], n)
            sums = heapq.nsmallest(n, [(a + b, c | {at: r} if r else c) for a, c in sums for r, b in enumerate(own)], key=lambda x: x[0])
        return sums

    def nbest(self, text: str, n: int = N_BEST) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text: (score, ids), best first."""
        c = self.chunks(text)
        self._prepare([c])
        if not c:
            return [(0.0, [])]
        base = sum(self._known[x][1] for x in c)
        out = []
        for loss, ranks in self._losses(c, np.array([self._known[x][2] for x in c], np.int64), n):
            ids: list[int] = []
            for i, x in enumerate(c):
                r = ranks.get(i, 0)
                ids += self.nbest_chunk(x, n)[r][1] if r else np.frombuffer(self._known[x][0], np.int32).tolist()
            out.append(((base - loss) / UNIT, ids))
        return out

    def decode(self, ids) -> str:
        """Text of a sequence of ids; the space before the first word is the codec's own."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        return raw.decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def codec(path: str | None = None) -> Codec:
    return Codec(path)


CACHES.append(codec.cache_clear)


def encode(docs: DataFrame, n: int = N_BEST, path: str | None = None, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus ``ids`` (null for a null text) and the ``scores`` of the n best segmentations."""
    docs, schema = extended(docs, ids="array<int>", scores="array<double>")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = part.column(at).to_pylist()
                got = tool.encode_batch(texts, n)
                ids = pa.array([None if t is None else np.frombuffer(c, np.int32) for t, (c, _) in zip(texts, got, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array([s for _, s in got], pa.list_(pa.float64()))], names=[f"c{i}" for i in range(b.num_columns + 2)])

    return map_arrow(docs, run, schema)


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All rows and columns plus the text that the ids stand for (null for null ids)."""
    encoded, schema = extended(encoded, **{out: "string"})
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for b in batches:
            texts = [None if i is None else tool.decode(i) for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[f"c{i}" for i in range(b.num_columns + 1)])

    return map_arrow(encoded, run, schema)


def round_trip(docs: DataFrame, n: int = N_BEST, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids_sha256 of the little-endian int32 ids, scores of the n best, round_trip) of every row.

    Encodes and decodes each whole text in one task, so that no id leaves it.
    """
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_pieces bigint, ids_sha256 string, scores array<double>, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for b in batches:
            rows: list[tuple] = []
            texts = b.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                part = texts[lo : lo + 256]
                for t, (code, scores) in zip(part, tool.encode_batch(part, n), strict=True):
                    back = None if t is None else tool.decode(np.frombuffer(code, np.int32).tolist())
                    rows.append((len(code) // 4, hashlib.sha256(code).hexdigest(), [round(s, 6) for s in scores], back == t))
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.float64())), pa.array(cols[3], pa.bool_())], names=["doc_id", "n_pieces", "ids_sha256", "scores", "round_trip"])

    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)
