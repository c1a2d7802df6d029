"""Burrows-Wheeler transforms of string collections, merged by interleave refinement (numpy helpers for one task)."""

from __future__ import annotations

import numpy as np

#: Units (bytes, or hashes of words) of one symbol: a text is read as GRAM interleaved strings of whole grams, so that few rounds reach the wanted depth.
GRAM = 100


def gram_size(length: int) -> int:
    """Units of a symbol for strings of `length` units: a quarter of them, or else the largest part that divides them."""
    return length // next(d for d in (4, 3, 2, 1) if length % d == 0)


def lanes(units: np.ndarray, gram: int) -> tuple[np.ndarray, list[int]]:
    """64-bit numbers, one for each place of the units, and the steps at which those of a gram lie; behind the end are zeros."""
    if units.dtype == np.uint8 and gram >= 8:
        padded = np.concatenate((units, np.zeros(gram + 8, np.uint8)))
        return np.ndarray(len(units) + gram, "<u8", padded, strides=(1,)), [*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])]
    return np.concatenate((units.astype(np.uint64), np.zeros(gram, np.uint64))), list(range(gram))


def gram_symbols(data: np.ndarray, valid: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A number from 1 for the gram that starts at each valid position, equal exactly for equal grams; 0 elsewhere.

    Grams are numbered in the order of a hash; should two different ones share it, their units decide.
    """
    out = np.zeros(len(data), np.int64)
    at = np.flatnonzero(valid)
    if not len(at):
        return out
    eight, steps = lanes(data, gram)
    h = np.zeros(len(data), np.uint64)
    for step in steps:
        h ^= eight[step : step + len(data)]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = h[at]
    order = np.argsort(h)
    same = np.zeros(len(at), bool)
    same[1:] = h[order][1:] == h[order][:-1]
    a, b = at[order][1:][same[1:]], at[order][:-1][same[1:]]
    if any((eight[a + s] != eight[b + s]).any() for s in steps):
        order = np.lexsort([eight[at + s] for s in reversed(steps)])
        same = np.zeros(len(at), bool)
        same[1:] = np.logical_and.reduce([eight[at[order][1:] + s] == eight[at[order][:-1] + s] for s in steps])
    number = np.empty(len(at), np.int64)
    number[order] = np.cumsum(~same)
    out[at] = number
    return out


def _rank_pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    both = first * (int(second.max(initial=0)) + 1) + second
    order = np.argsort(both)
    new = np.ones(len(both), bool)
    new[1:] = both[order][1:] != both[order][:-1]
    rank = np.empty(len(both), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def shard_transform(sym: np.ndarray, depth: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by the first `depth` symbols and the symbol before each suffix, 0 if none.

    sym[i] is the symbol at place i of the shard's strings, laid end to end; 0 where a string has no whole gram left. The
    suffix at i goes on at i + gram. Ranks reach up to twice as deep in each step; the order of equal suffixes is open.
    """
    rank, reach = sym, 1
    while reach < depth:
        step = min(reach, depth - reach)
        follow = np.zeros(len(rank), np.int64)
        follow[: max(0, len(rank) - step * gram)] = rank[step * gram :]
        rank = np.where(sym == 0, 0, _rank_pairs(rank, np.where(sym == 0, 0, follow)))
        reach += step
    order = np.argsort(rank)
    before = np.zeros(len(sym), np.int64)
    before[gram:] = sym[: max(0, len(sym) - gram)]
    return order, before[order]


def _stable_order(values: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative integers by 16-bit radix passes."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    if len(values) and int(values.max()) > 0xFFFF:
        order = order[np.argsort((values[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def merge(transforms: list[np.ndarray], empties: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, block): the shard that each place of the merged order comes from, and the number of its block of equal prefixes of `depth` symbols.

    transforms: each shard's symbols before its suffixes, in its suffix order; its first `empties` suffixes hold no
    symbol. Each round deals the shards' entries, in the order so far, to the buckets of their preceding symbols:
    the interleave is then right to one more symbol, and entries part into blocks where the symbol or the block of
    what follows differs, which gives the common prefixes. Suffixes are not compared again.
    """
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    fixed = np.repeat(np.arange(len(transforms), dtype=np.uint8), empties)
    block = np.zeros(len(shard), np.int64)
    flat, symbols = np.concatenate(transforms), np.empty(len(shard), np.int64)
    for _ in range(depth):
        symbols[np.argsort(shard, kind="stable")] = flat
        dealt = np.flatnonzero(symbols)
        order = dealt[_stable_order(symbols[dealt])]
        new = np.ones(len(order), bool)
        new[1:] = (symbols[order][1:] != symbols[order][:-1]) | (block[order][1:] != block[order][:-1])
        shard = np.concatenate((fixed, shard[order]))
        block = np.concatenate((np.zeros(len(fixed), np.int64), np.cumsum(new)))
    return shard, block


def repeated_starts(strings: list[bytes], times: np.ndarray, length: int, shards: int = 4, gram: int = GRAM, unit: str = "u1") -> list[np.ndarray]:
    """For each string of units the starts of its substrings of `length` units that start at two places or more, a string counting `times` over."""
    depth = length // gram
    if depth * gram != length:
        raise ValueError("length must be a multiple of the gram")
    sizes = np.fromiter(map(len, strings), np.int64, len(strings)) // np.dtype(unit).itemsize
    # One more place behind each string, and empty places so that no shift by a gram reaches the next string.
    starts = np.concatenate(([0], np.cumsum(sizes + gram + 1)))
    data = np.zeros(int(starts[-1]), unit)
    own = np.repeat(np.arange(len(strings)), sizes + gram + 1)
    within = np.arange(len(data)) - starts[own]
    inside = within < sizes[own]
    data[inside] = np.frombuffer(b"".join(strings), unit)
    sym = gram_symbols(data, within + gram <= sizes[own], gram)
    cuts = np.searchsorted(starts, np.linspace(0, starts[-1], shards + 1)[1:-1])
    bounds = starts[np.unique(np.concatenate(([0], cuts, [len(strings)])))]
    orders, transforms, empties = [], [], []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        part = sym[a:b]
        order, before = shard_transform(part, depth, gram)
        orders.append(order + a)
        transforms.append(before)
        empties.append(int((part == 0).sum()))
    shard, block = merge(transforms, empties, depth)
    place = np.empty(len(shard), np.int64)
    for k, order in enumerate(orders):
        place[shard == k] = order
    whole = within[place] + length <= sizes[own[place]]
    count = np.bincount(block[whole], weights=times[own[place[whole]]], minlength=1)
    hit = np.sort(place[whole][count[block[whole]] >= 2])
    return np.split(within[hit], np.searchsorted(own[hit], np.arange(1, len(strings))))
