"""Runs of periodic words: longest common extensions by difference-cover samples, and a harmonic grid of pairs to extend."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktide.llm.common import let

#: A difference cover: any two places reach members of it by one common step. The members are a fixed value.
MODULUS = 21
COVER = (3, 6, 7, 12, 14)
#: Words of the shortest run.
LEAST = 12
#: Words that a task looks at together (a longer text is looked at by itself), and pairs of its grid at a time.
SLICE_WORDS = 400_000
BLOCK_PAIRS = 1 << 20

SPACE = r"[\x20\x09-\x0D]+"


def _steps() -> np.ndarray:
    """For each two remainders the least common step to members of the cover."""
    member = np.isin(np.arange(MODULUS), COVER)
    a, b, step = np.ogrid[:MODULUS, :MODULUS, :MODULUS]
    return (member[(a + step) % MODULUS] & member[(b + step) % MODULUS]).argmax(axis=2)


_STEP = _steps()


class Extensions:
    """Longest common extensions to the right of any two places of a sequence whose last symbol occurs once.

    Only suffixes at places of the cover are sorted: by their first MODULUS symbols, then by doubled spans of such blocks. Their neighbours' common prefixes
    answer any pair of them by a range minimum; other pairs compare fewer than MODULUS symbols until both are at places of the cover.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.symbols = symbols
        at = np.concatenate([np.arange(c, n, MODULUS) for c in COVER])
        m = len(at)
        self.slot = np.zeros(n, np.int64)
        self.slot[at] = np.arange(m)
        names = self._blocks(at)
        levels, span = [names], 1
        while m and names.max() + 1 < m:
            key = names * (m + 1)
            key[: m - span] += names[span:] + 1
            names = np.unique(key, return_inverse=True)[1]
            levels.append(names)
            span *= 2
        self.rank = names
        order = np.empty(m, np.int64)
        order[names] = np.arange(m)
        self.table = self._minima(self._neighbours(at, order, levels[:-1]))

    def _blocks(self, at: np.ndarray) -> np.ndarray:
        """Ranks of the blocks of MODULUS symbols at the given places. Each class of places ends in a block that holds the last symbol, hence in one of its own."""
        padded = np.concatenate([self.symbols + 1, np.zeros(MODULUS, np.int64)])
        bits = int(padded.max(initial=1)).bit_length()
        each = max(1, 62 // bits)
        columns = []
        for first in range(0, MODULUS, each):
            packed = np.zeros(len(at), np.int64)
            for k in range(first, min(first + each, MODULUS)):
                packed = (packed << bits) | padded[at + k]
            columns.append(packed)
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(at), bool)
        for column in columns:
            sorted_column = column[order]
            new[1:] |= sorted_column[1:] != sorted_column[:-1]
        names = np.empty(len(at), np.int64)
        names[order] = np.cumsum(new)
        return names

    def _neighbours(self, at: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefixes of suffixes next to each other in order: by blocks, the widest spans first, then by symbols."""
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = (levels[k][a] == levels[k][b]).astype(np.int64)
            a, b, common = a + (same << k), b + (same << k), common + same * (MODULUS << k)
        x, y, left = at[a], at[b], np.arange(len(a))
        for k in range(MODULUS):
            left = left[self.symbols[x[left] + k] == self.symbols[y[left] + k]]
            if not len(left):
                break
            common[left] += 1
        return common

    @staticmethod
    def _minima(values: np.ndarray) -> np.ndarray:
        """Row j holds the least of each 2**j values from a place on."""
        rows = [values.astype(np.int32)]
        while len(values) >> len(rows):
            half, last = 1 << (len(rows) - 1), rows[-1]
            row = last.copy()
            row[: len(row) - half] = np.minimum(last[: len(row) - half], last[half:])
            rows.append(row)
        return np.stack(rows)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of different places the number of equal symbols from them on."""
        step = _STEP[i % MODULUS, j % MODULUS]
        out, alive, k = np.zeros(len(i), np.int64), np.ones(len(i), bool), 0
        left = np.flatnonzero(step > 0)
        while len(left):
            same = self.symbols[i[left] + k] == self.symbols[j[left] + k]
            alive[left[~same]] = False
            left, k = left[same], k + 1
            out[left] = k
            left = left[step[left] > k]
        left = np.flatnonzero(alive)
        if len(left):
            x, y = self.rank[self.slot[i[left] + step[left]]], self.rank[self.slot[j[left] + step[left]]]
            x, y = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp((y - x).astype(float))[1] - 1
            out[left] += np.minimum(self.table[level, x], self.table[level, y - (1 << level)])
        return out


def runs(codes: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of texts given as their words' numbers one after another, in the order of text, start and period.

    A run of period p and of 2p words or more holds two places of the grid 0, p, 2p, ... next to each other: extending each such pair to both sides finds it, and a text of n
    words has about n log n pairs. A stretch found with several periods has the least of them.
    """
    codes, lengths = codes.astype(np.int64), lengths.astype(np.int64)
    total, top = len(codes), int(codes.max(initial=-1)) + 1
    first = np.cumsum(lengths) - lengths + np.arange(len(lengths)) + 1
    symbols = np.empty(total + len(lengths) + 1, np.int64)
    marks = np.append(0, first + lengths)
    inside = np.ones(len(symbols), bool)
    inside[marks] = False
    symbols[inside], symbols[marks] = codes, top + np.arange(len(marks))
    n = len(symbols)
    halves = np.where(lengths >= least, lengths // 2, 0)
    text = np.repeat(np.arange(len(lengths)), halves)
    period = np.arange(len(text)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    counts = (lengths[text] - 1) // period
    ends = np.cumsum(counts)
    found = []
    ahead = back = None
    k = 0
    while k < len(text):
        until = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + BLOCK_PAIRS, "right")))
        part, count = slice(k, until), counts[k:until]
        p, t = np.repeat(period[part], count), np.repeat(text[part], count)
        a = first[t] + (np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)) * p
        near = np.flatnonzero((symbols[a] == symbols[a + p]) | (symbols[a - 1] == symbols[a + p - 1]))
        if len(near):
            if ahead is None:
                ahead, back = Extensions(symbols), Extensions(symbols[::-1].copy())
            a, p, t = a[near], p[near], t[near]
            right, left = ahead.common(a, a + p), back.common(n - a, n - a - p)
            good = np.flatnonzero((left + right >= p) & (left + right + p >= least))
            a, p, t, right, left = a[good], p[good], t[good], right[good], left[good]
            found.append(np.unique(np.stack([t, a - left - first[t], left + right + p, p]), axis=1))
        k = until
    t, start, length, p = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((4, 0), np.int64)
    shortest = np.ones(len(t), bool)
    shortest[1:] = (t[1:] != t[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    t, start, length, p = t[shortest], start[shortest], length[shortest], p[shortest]
    order = np.lexsort((p, start, t))
    return t[order], start[order], length[order], p[order]


def slices(lengths: np.ndarray):
    """(first, end) of consecutive texts that together have about SLICE_WORDS words."""
    first = size = 0
    for k, n in enumerate(lengths):
        size += int(n)
        if size >= SLICE_WORDS:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(lengths):
        yield first, len(lengths)


def words_of(text: Column) -> Column:
    """The words of a text between ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def planted(doc_id: Column, words: Column) -> Column:
    """The words, of which the texts whose id's checksum ends in 0 repeat a stretch of their own from some place on to the end; others, and those without an id, stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when((h % 10 == 0) & (n > 0), F.transform(w, lambda x, i: F.when(i >= a, F.get(w, (a + F.pmod(i - a, p)).cast("int"))).otherwise(x))).otherwise(w)

    return let(words, repeated)


def find_runs(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, runs, collapsed) of each row of rows(doc_id, words array<string>, ...), repeated rows included.

    runs: (start, length, period), in words from 0, of all stretches of `least` words or more and of two periods or more that no neighbouring word extends, each with its smallest period, by start and period;
    collapsed: the words that no run contains after its first period, joined by a space. Null words count as none, a null among words as the empty word; rows without words, or with fewer than
    `least`, have no runs. Very long texts are searched whole, each in one task. An empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        for whole in batches:
            sizes = pc.fill_null(pc.list_value_length(whole.column("words")), 0).to_numpy(zero_copy_only=False)
            for x, y in slices(sizes):
                batch, lengths = whole.slice(x, y - x), sizes[x:y].astype(np.int64)
                flat = pc.fill_null(batch.column("words").flatten(), "")
                codes = pc.dictionary_encode(flat)
                t, start, length, period = runs(codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), lengths, least)
                offsets = np.append(0, np.cumsum(lengths))
                change = np.zeros(len(flat) + 1, np.int64)
                np.add.at(change, offsets[t] + start + period, 1)
                np.add.at(change, offsets[t] + start + length, -1)
                kept = np.cumsum(change)[:-1] == 0
                left = np.append(0, np.cumsum(kept))[offsets]
                words = pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(kept)))
                each = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], ["start", "length", "period"])
                places = pa.ListArray.from_arrays(pa.array(np.searchsorted(t, np.arange(len(lengths) + 1)), pa.int32()), each)
                yield pa.record_batch([batch.column("doc_id"), places, pc.binary_join(words, " ")], names=["doc_id", "runs", "collapsed"])

    own = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("words").cast("array<string>").alias("words"))
    return own.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
