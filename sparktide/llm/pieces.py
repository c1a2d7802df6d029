"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

No piece holds a space mark behind another character, so no merge crosses the place before a run of
space marks: a text is cut there into words, and each distinct word is merged once for many texts. Nor does a merge cross two
characters that stand beside each other in no piece: words are cut there into segments, which are merged on their own.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words that a worker keeps before it drops those that the texts at hand don't hold, and the characters of the longest that it keeps; the results don't depend on them. A worker's memory stays its own in later jobs.
CACHE_WORDS = 150_000
CACHE_CHARS = 64
#: Symbols from which a segment is merged by itself.
LONG = 2_000
#: Characters that a worker splits into words at a time.
SLICE_CHARS = 250_000
_WORD = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")
_NONE = 1 << 30


def split_words(text: str) -> list[str]:
    """Words with their leading spaces; joined, they are the text behind one leading space."""
    return _WORD.findall(" " + text) if text else []


def slices(texts: list[str | None]):
    """(first, end) of consecutive texts that together have about SLICE_CHARS characters."""
    first = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE_CHARS:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _alternate(chained: np.ndarray) -> np.ndarray:
    """Of places in order, those to merge so that none overlap: chained[k] says that place k overlaps the one before it."""
    k = np.arange(len(chained))
    return (k - np.maximum.accumulate(np.where(chained, 0, k))) % 2 == 0


class PieceModel:
    """The tables of a SentencePiece BPE model with byte fallback and without normalisation; others raise ValueError."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        normalizer, kinds = proto.normalizer_spec, [p.type for p in proto.pieces]
        named = sentencepiece_model_pb2.ModelProto.SentencePiece
        if (
            proto.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE
            or not proto.trainer_spec.byte_fallback or normalizer.precompiled_charsmap
            or normalizer.remove_extra_whitespaces or not normalizer.add_dummy_prefix
            or {named.USER_DEFINED, named.UNUSED} & set(kinds)
            or any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces)
        ):
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation, user-defined or unused pieces")
        self.size = len(kinds)
        self.bos = next(i for i, p in enumerate(proto.pieces) if p.piece == (proto.trainer_spec.bos_piece or "<s>"))
        self.eos = next(i for i, p in enumerate(proto.pieces) if p.piece == (proto.trainer_spec.eos_piece or "</s>"))
        self.byte_ids = np.zeros(256, np.uint32)
        self.surface: list[bytes] = []
        self.normal: dict[str, int] = {}
        for i, p in enumerate(proto.pieces):
            if p.type == named.BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.surface.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type == named.NORMAL:
                self.normal[p.piece] = i
                self.surface.append(p.piece.replace(SPACE, " ").encode())
            else:
                self.surface.append(b"" if p.type == named.CONTROL else " ⁇ ".encode())
        scores = np.array([p.score for p in proto.pieces], np.float32)
        ranks = np.unique(-scores, return_inverse=True)[1]
        pairs = {}
        for piece, i in self.normal.items():
            for k in range(1, len(piece)):
                left, right = self.normal.get(piece[:k]), self.normal.get(piece[k:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.rank = ranks[self.merged].astype(np.int64)
        self.beside = np.array(sorted({(ord(a) << 32) | ord(b) for p in self.normal for a, b in zip(p, p[1:])}), np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NONE: no such piece or another word) and piece of each pair of symbols."""
        wanted = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found = same & (self.keys[at] == wanted)
        return np.where(found, self.rank[at], _NONE), self.merged[at]

    def _segments(self, points: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The number of each character's segment: a new one begins with each word and between characters that stand together in no piece."""
        wanted = (points[:-1].astype(np.int64) << 32) | points[1:]
        at = np.minimum(np.searchsorted(self.beside, wanted), len(self.beside) - 1)
        return np.cumsum(np.concatenate(([0], (self.beside[at] != wanted) | (word[1:] != word[:-1]))))

    def _merge_rounds(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left of all segments, and their segments, out of order.

        In each round every segment merges all its pairs of smallest rank that don't overlap, from the left, all segments at once, and
        the arrays are compacted; segments without a pair leave them. One after the other, these merges could be broken off by a pair of a smaller rank that one of them makes:
        a segment where that happens merges the leftmost alone in that round.
        """
        same = lambda s: np.append(s[1:], -1)[: len(s)] == s
        rank, into = self._look_up(sym, np.append(sym[1:], sym[:1]), same(seg))
        done_seg, done_sym = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            sizes = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            if (closed := least == _NONE).any():
                gone = np.repeat(closed, sizes)
                done_seg.append(seg[gone])
                done_sym.append(sym[gone])
                sym, seg, rank, into = sym[~gone], seg[~gone], rank[~gone], into[~gone]
                if not len(sym):
                    break
                least, sizes = least[~closed], sizes[~closed]
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            at = at[_alternate(np.concatenate(([False], (at[1:] == at[:-1] + 1) & (seg[at[1:]] == seg[at[:-1]]))))]
            again = np.concatenate(([False], seg[at[1:]] == seg[at[:-1]]))
            if again.any():
                new, lowest = into[at], rank[at]
                after = np.minimum(at + 2, len(sym) - 1)
                right, _ = self._look_up(new, sym[after], (after == at + 2) & (seg[after] == seg[at]))
                beside = np.concatenate(([False], at[1:] == at[:-1] + 2)) & again
                before = np.where(beside, np.roll(new, 1), sym[np.maximum(at - 1, 0)])
                left, _ = self._look_up(before, new, (at > 0) & (seg[np.maximum(at - 1, 0)] == seg[at]))
                broken = np.unique(seg[at[(right <= lowest) | (left <= lowest)]])
                if len(broken):
                    keep = ~again | ~np.isin(seg[at], broken)
                    at = at[keep]
            sym[at] = into[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, seg, rank, into = sym[stay], seg[stay], rank[stay], into[stay]
            at = at - np.arange(len(at))
            before = at[at > 0] - 1
            touched = np.concatenate((at, before[seg[before] == seg[before + 1]]))
            after = np.minimum(touched + 1, len(sym) - 1)
            rank[touched], into[touched] = self._look_up(sym[touched], sym[after], (after > touched) & (seg[after] == seg[touched]))
        return np.concatenate(done_sym or [sym]), np.concatenate(done_seg or [seg])

    def _merge_long(self, sym: np.ndarray) -> np.ndarray:
        """The symbols left of one long segment: the same rounds over linked places, each of which only looks at the places of its rank."""
        sym, size = sym.copy(), len(sym)
        following, preceding = np.arange(1, size + 1), np.arange(-1, size - 1)
        following[-1] = -1
        rank, into = self._look_up(sym, np.roll(sym, -1), following >= 0)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[rank[at] < _NONE]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1):
                r = int(rank[part[0]])
                if r not in waiting:
                    heapq.heappush(ranks, r)
                waiting.setdefault(r, []).append(part)

        put(np.arange(size))
        while ranks:
            r = heapq.heappop(ranks)
            own = np.unique(np.concatenate(waiting.pop(r)))
            own = own[rank[own] == r]
            if not len(own):
                continue
            at = own[_alternate(np.concatenate(([False], following[own[:-1]] == own[1:])))]
            gone = following[at]
            after, before, new = following[gone], preceding[at], into[at]
            beside = np.concatenate(([False], gone[:-1] == before[1:]))
            left, _ = self._look_up(np.where(beside, np.roll(new, 1), sym[before]), new, before >= 0)
            right, _ = self._look_up(new, sym[after], after >= 0)
            broken = np.flatnonzero((left <= r) | (right <= r))
            if len(broken) and broken[0] + 1 < len(at):  # the rest waits until the pair of smaller rank is merged
                stop = broken[0] + 1
                put(own[own > at[stop - 1]])
                at, gone, after, new = at[:stop], gone[:stop], after[:stop], new[:stop]
            sym[at], rank[gone], sym[gone] = new, _NONE, -1
            following[at] = after
            preceding[after[after >= 0]] = at[after >= 0]
            before = preceding[at]
            touched = np.unique(np.concatenate((at, before[before >= 0])))
            after = following[touched]
            rank[touched], into[touched] = self._look_up(sym[touched], sym[after], after >= 0)
            put(touched)
        return sym[sym >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers, from flat symbol arrays over the segments of all words."""
        text = "".join(words).replace(" ", SPACE)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, which = np.unique(points, return_inverse=True)
        sym = np.array([self.normal.get(chr(c), self.size + c) for c in distinct.tolist()], np.int64)[which]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        if len(word):
            seg = self._segments(points, word)
            sizes = np.bincount(seg)
            of = word[np.cumsum(sizes) - 1]
            short = (sizes < LONG)[seg]
            done = [self._merge_rounds(sym[short], seg[short])]
            ends = np.cumsum(sizes)
            for k in np.flatnonzero(sizes >= LONG).tolist():
                own = self._merge_long(sym[ends[k] - sizes[k] : ends[k]])
                done.append((own, np.full(len(own), k)))
            sym, place = (np.concatenate(x) for x in zip(*done, strict=True))
            order = np.argsort(place, kind="stable")
            sym, word = sym[order], of[place[order]]
        odd = np.flatnonzero(sym >= self.size)  # characters without a piece become the pieces of their bytes
        if len(odd):
            octets = [chr(c).encode("utf-8", "surrogatepass") for c in (sym[odd] - self.size).tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = np.fromiter(map(len, octets), np.int64, len(octets))
            known = np.repeat(sym < self.size, times)
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            sym[~known] = self.byte_ids[np.frombuffer(b"".join(octets), np.uint8)]
        flat, ends = sym.astype("<u4").tobytes(), np.cumsum(np.bincount(word, minlength=len(words))) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if words else []

    def decode(self, ids: bytes) -> str:
        """The text of ids that encode() made: control pieces vanish and so does the first space."""
        surface = self.surface
        out = b"".join([surface[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return out.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> tuple[PieceModel, dict[str, bytes]]:
    """The model and the words that this worker keeps."""
    return PieceModel(path), {}


def encode_texts(path: str, texts: list[str | None]) -> list[bytes]:
    """Ids of each text without begin and end; null is empty."""
    model, seen = load(path)
    split = [split_words(t or "") for t in texts]
    wanted = set().union(*split)
    missing = list(wanted.difference(seen))
    if len(seen) + len(missing) > CACHE_WORDS:
        kept = {w: seen[w] for w in wanted.intersection(seen)}
        seen.clear()
        seen.update(kept)
    seen.update(zip(missing, model.encode_words(missing), strict=True))
    of = seen.__getitem__
    out = [b"".join(map(of, words)) for words in split]
    for w in missing:
        if len(w) > CACHE_CHARS:
            del seen[w]
    return out


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, decoded) of each row of docs(doc_id, text, ...), repeated rows included.

    ids: begin, the text's pieces, end, as little-endian unsigned 32-bit integers in one binary value; decoded: the text of these ids. A null or empty
    text has the begin and end ids alone and decodes to the empty text. An empty table gives no rows; other columns are ignored. Very long texts are coded whole, in time that
    grows with their length also where they hold no space. The model file must be at model_path on every executor.
    """

    def run(batches):
        model, _ = load(model_path)
        begin, end = (np.array([i], "<u4").tobytes() for i in (model.bos, model.eos))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids = [begin + x + end for x in encode_texts(model_path, texts[a:b])]
                yield pa.record_batch([batch.column(0)[a:b], pa.array(ids, pa.binary()), pa.array(map(model.decode, ids), pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary, decoded string")
