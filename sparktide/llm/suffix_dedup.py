"""Removal of strings that start at two places or more, found by merged Burrows-Wheeler transforms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktide.llm.bwt import gram_size, lanes, repeated_starts
from sparktide.llm.common import forget, partitions, slices, write_once

LENGTH = 400
#: Bytes of the gram whose hash routes a window; a window holds LENGTH - ANCHOR + 1 of them.
ANCHOR = 32
#: Words of the shortest passage that repeated_passages() reports, and of the gram whose hash routes it.
WORDS = 51
WORD_ANCHOR = 16
#: Windows of a text that are looked at together.
STRIDE = 4_000_000
#: Distinct strings of one group from which it is parted further, and the widths in windows of the parts, level by level.
HOT_STRINGS = 1_000
WIDTHS = (64, 8, 1)
#: Units of strings that a task transforms together; a group of strings that is larger goes alone.
CHUNK = 200_000
_PLACE = np.uint64((1 << 24) - 1)
_MIX = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) | 1) for k in range(5)]
_SPACES = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


@dataclass(frozen=True)
class Search:
    """What repeats: strings of `length` bytes, or of `length` words parted by ASCII white space; windows are routed by grams of `anchor` of them."""

    length: int = LENGTH
    anchor: int = ANCHOR
    words: bool = False
    hot_strings: int = HOT_STRINGS

    @property
    def unit(self) -> str:
        return "<u8" if self.words else "u1"

    @property
    def least_bytes(self) -> int:
        return 2 * self.length - 1 if self.words else self.length

    def units(self, data: bytes) -> np.ndarray:
        """The bytes of a text, or the hashes of its words."""
        if not self.words:
            return np.frombuffer(data, np.uint8)
        parted = data.split()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, parted), np.uint64, len(parted))

    def spans(self, data: bytes, ranges: list) -> list[list[int]]:
        """(start, end) in bytes of ranges (a, b) of units."""
        if not self.words:
            return [[r["a"], r["b"]] for r in ranges]
        space = np.isin(np.frombuffer(data, np.uint8), _SPACES)
        edges = np.diff(np.concatenate(([1], space, [1])).astype(np.int8))
        begin, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        return [[int(begin[r["a"]]), int(end[r["b"] - 1])] for r in ranges]


BYTES = Search()
PASSAGES = Search(WORDS, WORD_ANCHOR, True)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(values) - width + 1], ahead[width - 1 : len(values)])


def _gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    eight, steps = lanes(units, gram)
    size = len(units) - gram + 1
    h = np.zeros(size, np.uint64)
    for step in steps:
        h += eight[step : step + size]
        h *= _MIX[0]
    h ^= h >> np.uint64(31)
    h *= _MIX[4]
    return h ^ (h >> np.uint64(29))


def anchor_runs(units: np.ndarray, length: int = LENGTH, gram: int = ANCHOR) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, count, anchor) of runs of consecutive windows of `length` units that share their anchor's place.

    A window's anchor is its gram of least hash, the leftmost of equals: it depends on the window's units alone, so equal windows
    have equal anchors, wherever they stand. Windows of one run differ from each other.
    """
    out = []
    for first in range(0, len(units) - length + 1, STRIDE):
        h = _gram_hashes(units[first : first + STRIDE + length - 1], gram)
        least = _sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & _PLACE
        starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        out.append((starts + first, np.diff(np.append(starts, len(least))), h[least[starts]].view(np.int64)))
    return out


def _key(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("octets"))


def _same_row(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.th") == F.col(f"{right}.th"))


def _runs(rows: DataFrame, search: Search) -> DataFrame:
    """(doc_id, th, start, n, anchor, sid): the runs of all texts; sid is a hash of the run's units."""

    def run(batches):
        length, digest = search.length, xxhash.xxh3_64_intdigest
        for batch in (part for whole in batches for part in slices(whole)):
            where, parts, sids = [], [], []
            for k, data in enumerate(batch.column(2).to_pylist()):
                units = search.units(data)
                wide = units.itemsize
                raw = units.tobytes() if search.words else data
                for part in anchor_runs(units, length, search.anchor):
                    parts.append(part)
                    where.append((k, len(part[0])))
                    sids += [digest(raw[a * wide : (a + c + length - 1) * wide]) for a, c in zip(part[0].tolist(), part[1].tolist(), strict=True)]
            if parts:
                at = pa.array(np.repeat([k for k, _ in where], [n for _, n in where]))
                starts, counts, anchors = (np.concatenate([p[j] for p in parts]) for j in range(3))
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(anchors), pa.array(np.array(sids, np.uint64).view(np.int64))]
                yield pa.record_batch(columns, names=["doc_id", "th", "start", "n", "anchor", "sid"])

    long_enough = rows.where(F.octet_length("octets") >= search.least_bytes)
    return long_enough.mapInArrow(run, "doc_id long, th long, start long, n long, anchor long, sid long")


def _strings(chosen: DataFrame, search: Search) -> DataFrame:
    """(grp, sid, times, bytes): the units of the runs in chosen(doc_id, th, octets, runs), grouped by their anchor; repeated rows beside each other give them once."""

    def run(batches):
        last = None
        for batch in batches:
            rows, strings = [], []
            for row, th, data, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row, th) == last:
                    continue
                last, units = (row, th), search.units(data)
                for r in runs:
                    rows.append((r["anchor"], r["sid"], r["times"]))
                    strings.append(units[r["start"] : r["start"] + r["n"] + search.length - 1].tobytes())
            if rows:
                yield pa.record_batch([*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), pa.array(strings, pa.binary())], names=["grp", "sid", "times", "bytes"])

    return chosen.select("doc_id", "th", "octets", "runs").mapInArrow(run, "grp long, sid long, times long, bytes binary")


def _parts(strings: DataFrame, search: Search, width: int) -> DataFrame:
    """(grp, sid, up_grp, up_sid, offset, times, bytes): strings of crowded groups cut into parts of at most `width` windows.

    A window's distance to its anchor is decided by its units, so parts are cut at multiples of `width` of that distance.
    All windows of a part then hold the same length - width + 1 units, whose hash names the part's group: equal windows
    still meet, while strings that share less than that go apart. At width 1 a group is one string.
    """
    length = search.length

    def run(batches):
        for batch in batches:
            rows, strings = [], []
            for up, sid, times, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                units = np.frombuffer(data, search.unit)
                h = _gram_hashes(units[:length], search.anchor)
                place = int(np.argmin(h & ~_PLACE))
                start, end = 0, len(units) - length + 1
                while start < end:
                    q = (place - start) // width
                    stop = min(end, place - q * width + 1)
                    core = units[place - q * width : place - q * width + length - width + 1].tobytes()
                    grp = xxhash.xxh3_64_intdigest(np.array([up, q, width], np.int64).tobytes() + core)
                    part = units[start : stop + length - 1].tobytes()
                    rows.append((grp - (1 << 63), xxhash.xxh3_64_intdigest(part) - (1 << 63), up, sid, start, times))
                    strings.append(part)
                    start = stop
            if rows:
                yield pa.record_batch([*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), pa.array(strings, pa.binary())], names=["grp", "sid", "up_grp", "up_sid", "offset", "times", "bytes"])

    return strings.select("grp", "sid", "times", "bytes").mapInArrow(run, "grp long, sid long, up_grp long, up_sid long, offset long, times long, bytes binary")


def _crowded_repeats(strings: DataFrame, search: Search) -> DataFrame:
    """As _repeats(), for strings of crowded groups: cut finer and finer until no group is crowded, results carried back up."""
    owners, found, used = [], [], [strings]
    for width in (w for w in WIDTHS if 2 * w < search.length or w == 1):
        parts = _parts(strings, search, width)
        owners.append(write_once(parts.select("grp", "sid", "up_grp", "up_sid", "offset"), "owners"))
        distinct = write_once(parts.groupBy("grp", "sid", "bytes").agg(F.sum("times").alias("times")), "parts")
        crowded = write_once(distinct.groupBy("grp").agg(F.count("*").alias("many")).where(F.col("many") > search.hot_strings).select("grp"), "crowded")
        found.append(write_once(_repeats(distinct.join(crowded, "grp", "left_anti"), search), "part-repeats"))
        used += [distinct, crowded]
        if crowded.isEmpty():
            break
        strings = distinct.join(crowded, "grp", "left_semi")
    used += owners + found
    up = None
    while owners:
        own, got = owners.pop(), found.pop()
        got = got if up is None else got.union(up)
        up = got.join(own, ["grp", "sid"]).select(F.col("up_grp").alias("grp"), F.col("up_sid").alias("sid"), (F.col("first") + F.col("offset")).alias("first"), (F.col("last") + F.col("offset")).alias("last"))
    up = write_once(up, "crowded-repeats")
    forget(*used)
    return up


def _repeats(strings: DataFrame, search: Search) -> DataFrame:
    """(grp, sid, first, last) of strings(grp, sid, times, bytes): ranges of window starts whose windows repeat."""
    length, wide = search.length, np.dtype(search.unit).itemsize

    def solve(rows):
        texts, times = [r[3] for r in rows], np.array([r[2] for r in rows])
        if len(rows) == 1:  # the windows of one string differ from each other
            hits = [np.arange(len(texts[0]) // wide - length + 1) if times[0] > 1 else np.array([], np.int64)]
        else:
            hits = repeated_starts(texts, times, length, gram=gram_size(length), unit=search.unit)
        out = []
        for r, hit in zip(rows, hits, strict=True):
            if len(hit):
                cut = np.flatnonzero(np.diff(hit) > 1)
                out += [(r[0], r[1], a, b) for a, b in zip(hit[np.append(0, cut + 1)].tolist(), hit[np.append(cut, len(hit) - 1)].tolist(), strict=True)]
        return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=["grp", "sid", "first", "last"])

    def run(batches):
        group, chunk, size = [], [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][0] != row[0]:
                    if len(group) == 1:
                        yield solve(group)
                    else:
                        chunk += group
                        size += sum(len(r[3]) for r in group)
                    group = []
                    if size >= CHUNK * wide:
                        yield solve(chunk)
                        chunk, size = [], 0
                group.append(row)
        if len(group) == 1:
            yield solve(group)
        else:
            chunk += group
        if chunk:
            yield solve(chunk)

    dealt = strings.select("grp", "sid", "times", "bytes").repartition(partitions(strings.sparkSession), "grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(run, "grp long, sid long, first long, last long")


def repeated_ranges(docs: DataFrame, search: Search = BYTES) -> DataFrame:
    """(doc_id, th, ranges) of the texts that hold repeats; th is xxhash64 of the text, ranges are (a, b) in units and may overlap.

    A range covers strings of `length` units that also start anywhere else in docs(doc_id, text, ...), the same document
    included; strings don't cross documents. Rows of equal doc_id and text are copies of each other and come back once. Null and short texts
    hold none, an empty table gives no rows; other columns are ignored. Very long texts are read in strides that overlap by a window.

    Each window is routed by an anchor that its units alone decide, so all places of a
    repeated string meet; only anchors found twice go on. Runs of equal units are one string with a count. The distinct strings
    of an anchor are transformed in shards, and the merged transforms' blocks of common prefixes are the repeated strings; an
    anchor with but one string has nothing to merge, all its windows repeat. An anchor of more than hot_strings strings is parted (see _parts).
    """
    rows = _key(docs)
    runs = write_once(_runs(rows, search), "runs")
    often = write_once(runs.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "often")
    again = write_once(runs.join(often, "anchor"), "again")
    forget(runs, often)
    place = F.struct("doc_id", "th", "start", "n")
    single = write_once(again.groupBy("anchor", "sid").agg(F.count("*").alias("times"), F.min(place).alias("at")), "strings")
    several = write_once(single.groupBy("anchor").agg(F.count("*").alias("many")), "several")
    strings = single.join(several, "anchor")

    def texts_of(chosen: DataFrame) -> DataFrame:
        runs = chosen.groupBy("at.doc_id", "at.th").agg(F.collect_list(F.struct("anchor", "sid", "at.start", "at.n", "times")).alias("runs"))
        return _strings(rows.alias("r").join(runs.alias("l"), _same_row("r", "l")).select("r.doc_id", "r.th", "octets", "runs"), search)

    used = [write_once(_repeats(texts_of(strings.where((F.col("many") > 1) & (F.col("many") <= search.hot_strings))), search), "merged")]
    if not several.where(F.col("many") > search.hot_strings).isEmpty():
        used.append(_crowded_repeats(write_once(texts_of(strings.where(F.col("many") > search.hot_strings)), "crowded-strings"), search))
    repeats = strings.where("many = 1").select(F.col("anchor").alias("grp"), "sid", F.lit(0).cast("long").alias("first"), (F.col("at.n") - 1).alias("last"))
    for found in used:
        repeats = repeats.union(found)
    held = again.join(repeats.withColumnRenamed("grp", "anchor"), ["anchor", "sid"])
    span = F.struct((F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + search.length).alias("b"))
    ranges = write_once(held.groupBy("doc_id", "th").agg(F.collect_set(span).alias("ranges")), "ranges")
    forget(again, single, several, *used)
    return ranges


def _cutter(searches: tuple[Search, ...]):
    """A function of the text and its ranges by each search, both null where nothing goes: the spans, the bytes that remain, and these as text."""
    kind = pa.struct([("spans", SPANS), ("kept", pa.binary()), ("text", pa.string())])

    def cut(octets: pa.Array, *ranges: pa.Array) -> pa.Array:
        out = []
        for data, *found in zip(octets.to_pylist(), *(r.to_pylist() for r in ranges), strict=True):
            if data is None:
                out.append(None)
                continue
            merged: list[list[int]] = []
            for a, b in sorted(x for search, own in zip(searches, found, strict=True) for x in search.spans(data, own or [])):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            edges = [0, *(x for m in merged for x in m), len(data)]
            pieces = [data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
            out.append({"spans": [{"start": a, "end": b} for a, b in merged], "kept": b"".join(pieces), "text": "".join(p.decode("utf-8", "ignore") for p in pieces)})
        return pa.array(out, kind)

    return F.arrow_udf(cut, "spans array<struct<start: long, end: long>>, kept binary, text string")


def remove_repeats(docs: DataFrame, *searches: Search, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of every row of docs(doc_id, text, ...) and (octets, spans, kept, rest), repeated rows included.

    A byte goes if a string of a search that covers it starts at two places or more. octets: the text's bytes (null: none); spans: the maximal
    removed runs as (start, end) bytes, by all searches together; kept: the remaining bytes; rest: these as text, less what a cut leaves of a character; null for a null text.
    Texts cross the network once for all searches; those that lose nothing don't go through Python. Null and empty texts lose nothing; a repeated row loses all that its copies hold, and so do they; very long texts are
    searched whole, each cut in one task; an empty table gives no rows; columns of docs whose names clash with these stay apart, and come back where `keep` names them.
    """
    found, names = None, [f"ranges{k}" for k in range(len(searches))]
    for name, search in zip(names, searches, strict=True):
        own = repeated_ranges(docs, search).select("doc_id", "th", F.col("ranges").alias(name))
        found = own if found is None else found.unionByName(own, allowMissingColumns=True)
    if len(searches) > 1:
        found = found.groupBy("doc_id", "th").agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])
    found = found.select(F.col("doc_id").alias("at"), F.col("th").alias("text_hash"), *names)
    rows = docs.select(*[F.col(c).alias(f"in_{c}") for c in keep], F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("th") == F.col("text_hash")), "left")
    octets = F.coalesce("text", F.lit("")).cast("binary")
    changed = F.coalesce(*names).isNotNull()
    cut = joined.withColumn("cut", _cutter(searches)(F.when(changed, octets), *names))
    none = F.array().cast("array<struct<start: long, end: long>>")
    return cut.select(
        *[F.col(f"in_{c}").alias(c) for c in keep], octets.alias("octets"), F.coalesce("cut.spans", none).alias("spans"), F.coalesce("cut.kept", octets).alias("kept"), F.coalesce("cut.text", "text").alias("rest")
    )


def removal(docs: DataFrame, search: Search = BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) of every row of docs; see remove_repeats() for nulls, repeats, very long texts and the like. text is what remains, empty for a null text; other columns are ignored."""
    done = remove_repeats(docs, search)
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return done.select(
        F.col("doc_id").cast("long"), F.octet_length("octets").cast("long").alias("n_bytes"), lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.coalesce("rest", F.lit("")).alias("text")
    )


def removal_report(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot_strings: int = HOT_STRINGS) -> DataFrame:
    """removal() without the text, for strings of `length` bytes."""
    return removal(docs, Search(length, anchor, False, hot_strings)).drop("text")


def repeated_passages(docs: DataFrame, words: int = WORDS, anchor: int = WORD_ANCHOR) -> DataFrame:
    """(doc_id, th, spans) of the rows of docs that hold a passage of `words` words or more which also starts anywhere else; repeated rows come back as often as they came.

    Words are parted by ASCII white space and compared as they stand, by 64-bit hashes. spans: the maximal such passages as (start, end) bytes, from the first word to the last.
    """
    done = remove_repeats(docs, Search(words, anchor, True))
    return done.where(F.size("spans") > 0).select("doc_id", F.xxhash64(F.col("octets").cast("string")).alias("th"), "spans")
