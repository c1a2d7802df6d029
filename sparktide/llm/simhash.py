"""SimHash near-duplicates, linked by a generalised pigeonhole search."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktide.llm.common import forget, slices, write_once
from sparktide.llm.components import connected_components

BITS = 64
SHINGLE = 4
DISTANCE = 4
#: Hash functions of a band and bands of similar_documents(): a pair at 0.8 shares no band in 1 of 9,000 cases.
BAND = 6
BANDS = 30
#: Members of a bucket up to which all its pairs are compared, and the members that all others meet beyond, before crowded_links() looks for the rest.
BUCKET = 32
HUBS = 4
#: Shingles whose hashes are looked at together.
SLICE = 200_000
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _digests(octets: bytes | None, shingle: int) -> np.ndarray:
    """The XXH64 (seed 42) of all word shingles of a text; A-Z are lower-cased, fewer words are one shingle, none (or null) give none."""
    words = (octets or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, size = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], 42) for a, b in pairs], np.uint64)


def _majority(digests: np.ndarray) -> int:
    if not len(digests):
        return 0
    octets = digests.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BYTE_BITS for j in range(8)])
    return int(np.packbits(2 * ones > len(octets), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The majority bits of the XXH64 (seed 42) of all word shingles, as a signed 64-bit integer.

    A-Z are lower-cased; a text of fewer words is one shingle; no words (or null) give zero; a tie gives 0.
    """
    return _majority(_digests((text or "").encode("utf-8", "surrogatepass"), shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row of docs, null texts and repeated rows included."""

    def of(batches):
        for batch in batches:
            values = [_majority(_digests(x, shingle)) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(of, "doc_id long, fp long")


def bit_correlation(fps: DataFrame) -> np.ndarray:
    """The absolute correlation of each two fingerprint bits over all rows; 64 x 64 sums reach the driver."""

    def sums(batches):
        total, rows = np.zeros((BITS + 1, BITS + 1)), 0
        for batch in batches:
            if batch.num_rows:
                bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                bits = np.concatenate([bits, np.ones((len(bits), 1), np.uint8)], axis=1).astype(np.float64)
                total += bits.T @ bits
                rows += len(bits)
        if rows:
            i, j = np.indices(total.shape)
            yield pa.record_batch([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "n"])

    got = fps.select("fp").mapInArrow(sums, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS + 1, BITS + 1))
    for r in got:
        both[r.i, r.j] = r.n
    rows = max(both[BITS, BITS], 1.0)
    mean = both[:BITS, BITS] / rows
    covariance = both[:BITS, :BITS] / rows - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
    return np.abs(covariance / np.outer(spread, spread))


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of near-equal width: each starts from the free bit most tied to the others and takes the bits most tied to it."""
    free, groups = set(range(BITS)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        first = max(sorted(free), key=lambda b: sum(correlation[b, c] for c in free if c != b))
        group = [first]
        free.remove(first)
        while len(group) < width:
            best = max(sorted(free), key=lambda b: correlation[b, group].sum())
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def mask_of(bits) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def allocate(equal_pairs: list[float], widths: list[int], rows: float, distance: int) -> tuple[float, list[int]]:
    """Thresholds of -1 (skip) or more that add up to distance - parts + 1, of the least estimated work.

    Work of a partition at threshold t: the values probed and the pairs expected behind them, taken as the
    pairs of equal value times the size of the ball. Dynamic programming over partitions and sums.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for pairs, width in zip(equal_pairs, widths, strict=True):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, distance + 1):
                ball = sum(comb(width, k) for k in range(t + 1))
                total = cost + 10 * ball * rows + ball * pairs
                if used + t not in step or total < step[used + t][0]:
                    step[used + t] = (total, [*chosen, t])
        best = step
    return best[distance - len(widths) + 1]


def plan_partitions(fps: DataFrame, distance: int, parts=(2, 3, 4, 5)) -> list[tuple[int, int, list[int]]]:
    """(mask, threshold, bits) of the partitions to probe, the cheapest plan over the given numbers of partitions."""
    correlation = bit_correlation(fps)
    trial = [(m, bits) for m in parts for bits in group_bits(correlation, m)]
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask_of(b))).alias("v")) for k, (_, b) in enumerate(trial)]))
    counts = fps.select(keys.alias("p")).groupBy("p.k", "p.v").count()
    got = {r.k: (float(r.pairs), float(r.n)) for r in counts.groupBy("k").agg(F.sum(F.col("count").cast("double") ** 2).alias("pairs"), F.sum("count").alias("n")).collect()}
    plans = []
    for m in parts:
        mine = [(k, bits) for k, (of, bits) in enumerate(trial) if of == m]
        rows = got.get(mine[0][0], (0.0, 0.0))[1]
        cost, thresholds = allocate([max(1.0, got.get(k, (0.0, 0.0))[0]) for k, _ in mine], [len(b) for _, b in mine], max(1.0, rows), distance)
        plans.append((cost, [(mask_of(b), t, b) for (_, b), t in zip(mine, thresholds, strict=True) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


def _keys(plan, ball: bool) -> Column:
    """(part, value) of a fingerprint, with all values within the partition's threshold if ball."""

    def values(k: int, mask: int, t: int, bits: list[int]) -> Column:
        flips = [mask_of(c) for r in range(t + 1 if ball else 1) for c in combinations(bits, r)]
        own = F.col("fp").bitwiseAND(F.lit(mask))
        return F.transform(F.lit(np.array(flips, np.int64)), lambda f: F.struct(F.lit(k).alias("k"), own.bitwiseXOR(f).alias("v")))

    return F.explode(F.concat(*[values(k, *p) for k, p in enumerate(plan)]))


def links(fps: DataFrame, distance: int = DISTANCE, dense: int | None = None) -> DataFrame:
    """(a, b): fingerprints of the distinct column fp at 1 to distance differing bits; enough of them to connect what any such pairs connect.

    Values of the planned partitions are probed and each pair is verified inside the join. A fingerprint
    that stands in a bucket of more than `dense` (default: the size of the midpoint ball), or would probe one, would meet too many others there. Two such fingerprints are
    instead joined through all points within distance/2 of each: they share a point exactly if they link
    (distance is even), so each fingerprint costs a fixed number of rows, no group is paired with itself, and nothing probes a crowded bucket.
    """
    half = distance // 2
    if distance % 2:
        raise ValueError("distance must be even")
    ball = [mask_of(c) for r in range(half + 1) for c in combinations(range(BITS), r)]
    plan = plan_partitions(fps, distance)
    data = fps.select("fp", _keys(plan, False).alias("p")).select("fp", "p.*")
    crowded = write_once(data.groupBy("k", "v").count().where(F.col("count") > (dense or len(ball))).select("k", "v"), "crowded")
    flagged, found = fps.withColumn("dense", F.lit(False)), None
    if not crowded.isEmpty():
        probes = fps.select("fp", _keys(plan, True).alias("p")).select("fp", "p.*")
        thick = write_once(probes.join(crowded, ["k", "v"]).select("fp").distinct(), "dense")
        flagged = fps.join(thick.withColumn("dense", F.lit(True)), "fp", "left").fillna(False, ["dense"])
        points = thick.select("fp", F.explode(F.transform(F.lit(np.array(ball, np.int64)), lambda f: F.col("fp").bitwiseXOR(f))).alias("point"))
        met = points.groupBy("point").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1")
        found = points.join(met, "point").where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct()
    left = flagged.where("NOT dense").select(F.col("fp").alias("a"), _keys(plan, True).alias("p")).select("a", "p.*")
    right = flagged.select(F.col("fp").alias("b"), "dense", _keys(plan, False).alias("q")).select("b", "dense", F.col("q.k").alias("bk"), F.col("q.v").alias("bv"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(True)
    for k, (mask, t, _) in enumerate(plan[:-1]):  # a pair counts in the first partition that shows it
        first = first & ((F.col("k") <= k) | (F.bit_count(differ.bitwiseAND(F.lit(mask))) > t))
    pairs = left.join(
        right,
        (F.col("k") == F.col("bk")) & (F.col("v") == F.col("bv")) & ((F.col("a") < F.col("b")) | F.col("dense"))
        & (F.bit_count(differ) <= distance) & (differ != 0) & first,
    ).select("a", "b")
    return pairs if found is None else pairs.union(found)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, dense: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs(doc_id, text, ...).

    Rows of equal fingerprint are one node; nodes at up to `distance` differing bits link; component_id is the
    smallest doc_id that a row reaches, its own included (null ids count only if a component has no other).
    Rows without words share fingerprint zero. Very long texts are hashed whole. Repeated rows come back as often as they came. An empty table gives no rows; other columns are ignored.
    """
    marks = write_once(fingerprints(docs, shingle), "fingerprints")
    fps = write_once(marks.groupBy("fp").agg(F.min("doc_id").alias("low")), "fps")
    roots = connected_components(links(fps.select("fp"), distance, dense))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return marks.join(rooted.join(lows, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _band_factors() -> np.ndarray:
    """Odd 32-bit factors, one for each hash function, by the rule of the splitmix64 generator."""
    x = np.arange(1, BAND * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _bands(sets: list[np.ndarray]) -> list[list[int]]:
    """The hash of each band's least values for each set of digests; a hash function is a product of the digest's upper half, modulo 2**32."""
    out = [[0] * BANDS for _ in sets]
    full = [k for k, s in enumerate(sets) if len(s)]
    factors = _band_factors()
    while full:
        size = max(1, int(np.searchsorted(np.cumsum([len(sets[k]) for k in full]), SLICE)))
        part, full = full[:size], full[size:]
        flat = (np.concatenate([sets[k] for k in part]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(sets[k]) for k in part])[:-1]))
        low = np.stack([np.minimum.reduceat(flat * f, starts) for f in factors], axis=1).reshape(len(part), BANDS, BAND)
        for k, rows in zip(part, low, strict=True):
            out[k] = [xxhash.xxh3_64_intdigest(row.tobytes(), j) - (1 << 63) for j, row in enumerate(rows)]
    return out


def _candidates(nodes: DataFrame, bucket: int, hubs: int) -> tuple[DataFrame, DataFrame]:
    """(a, b), a < b: pairs of nodes(node, fp, bands) that may be similar, each once; and (band, node) of the crowded buckets.

    Fingerprints at DISTANCE bits or fewer, by links(), and rows of equal fingerprint, each with the smallest of them; and nodes that share a band.
    Of a band's bucket of more than `bucket` nodes, a crowded one, each meets `hubs` of them, the same in all bands, so no group is paired with itself.
    """
    fps = write_once(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "fps")
    far = links(fps.select("fp"))
    far = far.join(fps.select(F.col("fp").alias("a"), F.col("rep").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("rep").alias("y")), "b").select("x", "y")
    near = nodes.join(fps, "fp").select(F.col("node").alias("x"), F.col("rep").alias("y"))
    data = nodes.select("node", F.explode("bands").alias("band"))
    order = [F.struct(F.xxhash64("node", F.lit(j)).alias("o"), "node") for j in range(hubs)]
    met = write_once(data.groupBy("band").agg(F.count("*").alias("n"), F.array(*[F.min(o)["node"] for o in order]).alias("hubs")).where("n > 1"), "met")
    some = data.join(met.where(F.col("n") <= bucket).select("band"), "band")
    small = some.alias("x").join(some.alias("y"), "band").where("x.node < y.node").select(F.col("x.node").alias("x"), F.col("y.node").alias("y"))
    crowded = write_once(data.join(met.where(F.col("n") > bucket).select("band", "hubs"), "band"), "crowded-bands")
    large = crowded.select(F.col("node").alias("x"), F.explode("hubs").alias("y"))
    every = far.union(near).union(small).union(large).where("x <> y")
    pairs = write_once(every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    forget(fps, met)
    return pairs, crowded.select("band", "node")


def crowded_links(crowded: DataFrame, roots: DataFrame, texts_of, similarity: float) -> DataFrame | None:
    """(a, b): similar nodes of different components that share a crowded bucket; None if no bucket has two components.

    crowded(band, node); roots(node, root): the components so far; texts_of: (node, s) of the nodes of a table(node), s the set as an array.
    Sets of a similarity of 0.8 share one of the elements that come first in any order of all elements, a fifth of either set. In the order
    by count these are a set's rarest ones, and one that a single node or component holds links nothing, so a group that is one component already
    is never paired with itself. A pair meets only where both sets have enough elements left, from the shared one on, for the overlap that their two sizes need.
    Nothing is capped: elements of equal count are told apart by value.
    """
    at = crowded.join(roots, "node")
    mixed = at.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    between = write_once(at.join(mixed, "band").select("node", "root").distinct(), "between")
    if between.isEmpty():
        forget(between)
        return None
    held = write_once(texts_of(between.select("node")).join(between, "node").withColumn("size", F.size("s")), "between-sets")
    every = held.select("node", F.explode("s").alias("e"))
    shared = every.join(every.groupBy("e").agg(F.count("*").alias("n")).where("n > 1"), "e").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("es"))
    # places from 0 in the order by count: elements of a single node come first and need no row; beyond size - k, k the least overlap with any set, nothing can be a pair's first shared element
    before, last = F.col("size") - F.size("es"), F.col("size") - F.ceil(F.col("size") * F.lit(similarity) - F.lit(1e-6))
    prefix = held.select("node", "root", "size").join(shared, "node").where(last >= before).select("node", "root", "size", before.alias("before"), F.posexplode(F.slice("es", F.lit(1), (last - before + 1).cast("int"))).alias("place", "f"))
    prefixes = write_once(prefix.select("node", "root", "size", (F.col("before") + F.col("place")).alias("at"), F.col("f.e").alias("e")), "prefixes")
    keys = prefixes.join(prefixes.groupBy("e").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("e"), "e")
    other = keys.select("e", F.col("node").alias("b"), F.col("root").alias("r"), F.col("size").alias("z"), F.col("at").alias("then"))
    overlap = (F.col("size") + F.col("z")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)
    near = (F.col("root") < F.col("r")) & (F.col("size") - F.col("at") >= overlap) & (F.col("z") - F.col("then") >= overlap)
    pairs = write_once(keys.join(other, (keys.e == other.e) & near).select(F.col("node").alias("a"), "b").distinct(), "between-pairs")
    found = write_once(_verified(pairs, held.select("node", "s"), similarity), "between-links")
    forget(between, held, prefixes, pairs)
    return found


def _verified(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The pairs(a, b) whose sets in held(node, s) have a Jaccard similarity of `similarity` or more."""
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared)).select("a", "b")


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bucket: int = BUCKET, hubs: int = HUBS) -> DataFrame:
    """(doc_id, th, component_id, first) for each row of docs(doc_id, text, ...); th is xxhash64 of the text.

    Rows of equal shingle sets are one node; nodes whose sets have a Jaccard similarity of `similarity` or more link; component_id as in near_duplicates().
    first: whether the row has its component's smallest doc_id, and the smallest th of that id; true for one text of each component.
    Candidates (see _candidates) are verified on the sets themselves; crowded_links() finds what the hubs of crowded buckets miss. Null texts and texts without words are one empty set; repeated rows come back as
    often as they came; an empty table gives no rows; other columns are ignored.
    """

    def of(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            digests = [_digests(x, shingle) for x in batch.column(2).to_pylist()]
            sets = [np.unique(d) for d in digests]
            marks = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
            fps = [_majority(d) for d in digests]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(marks, pa.int64()), pa.array(fps, pa.int64()), pa.array(_bands(sets), pa.list_(pa.int64()))], names=["doc_id", "th", "node", "fp", "bands"])

    def sets(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            values = [np.unique(_digests(x, shingle)).view(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(values, pa.list_(pa.int64()))], names=["node", "s"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("octets"))
    marks = write_once(rows.mapInArrow(of, "doc_id long, th long, node long, fp long, bands array<long>"), "marks")
    nodes = write_once(marks.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("at"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    places = nodes.select("node", F.col("at.doc_id").alias("id"), F.col("at.th").alias("h"))

    def sets_of(ends: DataFrame) -> DataFrame:
        texts = rows.join(places.join(ends, "node"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h"))).select("node", "octets")
        return texts.mapInArrow(sets, "node long, s array<long>").dropDuplicates(["node"])

    def components(edges: DataFrame) -> DataFrame:
        return nodes.select("node", "at").join(connected_components(edges), "node", "left").select("node", "at", F.coalesce("root", "node").alias("root"))

    pairs, crowded = _candidates(nodes, bucket, hubs)
    held = write_once(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "sets")
    edges = write_once(_verified(pairs, held, similarity), "similar")
    forget(pairs, held)
    rooted = components(edges)
    if not crowded.isEmpty():
        more = crowded_links(crowded, rooted.select("node", "root"), sets_of, similarity)
        if more is not None and not more.isEmpty():
            rooted = components(edges.union(more))
    forget(crowded)
    lows = rooted.groupBy("root").agg(F.min("at").alias("low"))
    found = marks.select("doc_id", "th", "node").join(rooted.join(lows, "root").select("node", "low"), "node")
    return found.select("doc_id", "th", F.col("low.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("th") == F.col("low.th"))).alias("first"))
