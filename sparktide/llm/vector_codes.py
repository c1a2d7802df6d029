"""Product codes of vectors: integer codebooks by rounds of nearest entries, with norm-of-sum bounds ahead of exact rescans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparktide.llm.common import forget, write_once

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Groups of entries of a codebook, each with a lower bound of its own; more groups make bounds closer and the written state larger.
GROUPS = 4
#: Bounds are loosened by this share, more than their rounding to 32 bits can take away.
SLACK = 1e-6
#: Numbers of a table of distances that a task holds at a time.
BLOCK = 1 << 21
#: Sums of integers of any size travel as 64-bit sums of digits of so many bits.
DIGIT = 30
#: Columns of a written round: rows of vectors with their bounds, and rows of sums.
NAMES = ["vec_id", "label", "code", "embedding", "bounds", "part", "entry", "digit", "sums"]
_FAR = float(np.finfo(np.float32).max)


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose embedding is an array of finite single-precision numbers."""
    vector = F.col("embedding").cast("array<float>")
    return rows.withColumn("embedding", vector).where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast("float"))))


def cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    """(first, end) of the consecutive parts of a vector."""
    return [(k * dim // parts, (k + 1) * dim // parts) for k in range(parts)]


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries; exact, as doubles hold every sum or else x holds Python integers."""
    if x.dtype == object:
        return ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float))


class Bounds:
    """For the rows of a batch and one part: the entry, an upper bound of its distance, a lower bound for each group of the others, and the round in which each bound was taken."""

    def __init__(self, code, upper, lower, upper_at, lower_at):
        self.code, self.upper, self.lower, self.upper_at, self.lower_at = code, upper, lower, upper_at, lower_at

    @staticmethod
    def dtype(parts: int) -> np.dtype:
        return np.dtype([("upper", np.float32, (parts,)), ("lower", np.float32, (parts, GROUPS)), ("upper_at", np.uint8, (parts,)), ("lower_at", np.uint8, (parts, GROUPS))])

    def advance(self, x: np.ndarray, history: list[np.ndarray]) -> int:
        """Moves to the last codebook of the history; returns how many distances it took.

        A bound taken in round r is off by no more than the norm of the entry's net displacement since r, the sum of its steps, which is at most the
        sum of the norms of the steps. Only groups whose lower bound doesn't clear the upper one are scanned again.
        """
        now, book = len(history) - 1, history[-1]
        edges = [k * len(book) // GROUPS for k in range(GROUPS + 1)]
        moved = np.stack([_root(((book - old) ** 2).sum(axis=1)) for old in history]) * (1 + SLACK)
        by_group = np.stack([moved[:, a:b].max(axis=1) if b > a else np.zeros(len(history)) for a, b in zip(edges, edges[1:], strict=False)], axis=1)
        upper = self.upper + moved[self.upper_at, self.code]
        lower = self.lower - by_group[self.lower_at, np.arange(GROUPS)]
        rows = np.flatnonzero(upper >= lower.min(axis=1))
        mine = ((x[rows] - book[self.code[rows]]) ** 2).sum(axis=1)
        upper[rows] = _root(mine) * (1 + SLACK)
        best, entry, work = mine.copy(), self.code[rows].copy(), len(rows)
        first, second, at, near = np.full((len(rows), GROUPS), np.inf), np.full((len(rows), GROUPS), np.inf), np.full((len(rows), GROUPS), -1), lower[rows] <= upper[rows][:, None]
        for g, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            r = np.flatnonzero(near[:, g]) if b > a else np.empty(0, int)
            if len(r):
                d = distances(x[rows[r]], book[a:b])
                work += d.size
                k = d.argmin(axis=1)
                least = d[np.arange(len(r)), k]
                first[r, g], at[r, g] = _root(least), a + k
                if b - a > 1:
                    d[np.arange(len(r)), k] = d.max() + 1
                    second[r, g] = _root(d.min(axis=1))
                closer = (least < best[r]) | ((least == best[r]) & (a + k < entry[r]))
                best[r[closer]], entry[r[closer]] = least[closer], (a + k)[closer]
        left = np.searchsorted(edges, self.code[rows], "right") - 1
        gone = np.flatnonzero((entry != self.code[rows]) & ~near[np.arange(len(rows)), left])
        upper[rows] = _root(best) * (1 + SLACK)
        found = np.where(at == entry[:, None], second, first) * (1 - SLACK)
        lower[rows] = np.where(near, found, lower[rows])
        lower[rows[gone], left[gone]] = np.minimum(lower[rows[gone], left[gone]], _root(mine[gone]) * (1 - SLACK))
        self.code[rows], self.upper_at[rows], self.lower_at[rows] = entry, now, np.where(near, now, self.lower_at[rows])
        # Rows without a scan keep their bounds as taken, with their stamps; a group that took in the entry left behind has a bound of this round.
        self.upper[rows] = upper[rows]
        self.lower[rows] = np.where(near, np.minimum(lower[rows], _FAR), self.lower[rows])
        self.lower[rows[gone], left[gone]], self.lower_at[rows[gone], left[gone]] = lower[rows[gone], left[gone]], now
        return work


def _digits(totals: np.ndarray, count: int) -> list[np.ndarray]:
    """Signed digits, least first, of integers."""
    if count == 1:
        return [totals.astype(np.int64)]
    out, rest = [], totals.astype(object)
    for _ in range(count - 1):
        out.append((rest % (1 << DIGIT)).astype(np.int64))
        rest = rest // (1 << DIGIT)
    return [*out, rest.astype(np.int64)]


def _binary(data: np.ndarray) -> pa.Array:
    """A column of equally long binary values, one for each row of the table of bytes."""
    n, width = data.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)[: n + 1].tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _integers(values: np.ndarray, scale: int, exact: bool) -> np.ndarray:
    scaled = np.floor(values.astype(np.float64) * scale)
    return np.frompyfunc(int, 1, 1)(scaled) if exact else scaled


def _round(state: DataFrame, history: list[list[np.ndarray]], dim: int, scale: int, digits: int, final: bool) -> DataFrame:
    """The state after assigning all rows to the last codebooks, with each task's sums for the next as rows of their own; in the final round with errors instead of bounds and sums."""
    parts, bound_type, exact = len(history[-1]), Bounds.dtype(len(history[-1])), digits > 1
    held = state.sparkSession.sparkContext.broadcast([[b.astype(object) if exact else b.astype(np.float64) for b in books] for books in history])

    def run(batches):
        books, places = held.value, cuts(dim, parts)
        sums = [np.zeros((len(books[-1][p]), digits, b - a + 1), np.int64) for p, (a, b) in enumerate(places)]
        for whole in batches:
            for start in range(0, len(whole), max(1, BLOCK // max(dim, ENTRIES))):
                batch = whole.slice(start, max(1, BLOCK // max(dim, ENTRIES)))
                n = len(batch)
                x = _integers(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(n, dim), scale, exact)
                old = batch.column("bounds").to_pylist()
                if len(books) == 1:
                    table, code = np.zeros(n, bound_type), np.zeros((n, parts), np.int64)
                    table["upper"], table["lower"] = np.inf, -np.inf
                else:
                    table = np.frombuffer(b"".join(old), bound_type).copy()
                    code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                error = np.zeros(n, object if exact else np.float64)
                for p, (a, b) in enumerate(places):
                    own = Bounds(code[:, p], table["upper"][:, p], table["lower"][:, p], table["upper_at"][:, p], table["lower_at"][:, p])
                    own.advance(x[:, a:b], [h[p] for h in books])
                    if final:
                        error = error + (((x[:, a:b] - books[-1][p][code[:, p]]) ** 2).sum(axis=1) if b > a else 0)
                    else:
                        for k in range(b - a):
                            if exact:
                                totals = np.zeros(len(books[-1][p]), object)
                                np.add.at(totals, code[:, p], x[:, a + k])
                            else:
                                totals = np.bincount(code[:, p], weights=x[:, a + k], minlength=len(books[-1][p]))
                            for w, digit in enumerate(_digits(totals, digits)):
                                sums[p][:, w, k] += digit
                        sums[p][:, 0, -1] += np.bincount(code[:, p], minlength=len(books[-1][p]))
                columns = [batch.column("vec_id"), batch.column("label"), _binary(code.astype(np.uint8))]
                if final:
                    yield pa.record_batch([*columns, pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])
                else:
                    nothing = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))]
                    yield pa.record_batch([*columns, batch.column("embedding"), _binary(table.view(np.uint8).reshape(n, -1)), *nothing], names=NAMES)
        if not final:
            at = [(p, e, w) for p, s in enumerate(sums) for e in range(len(s)) if s[e, 0, -1] for w in range(digits)]
            empty = [pa.nulls(len(at), t) for t in (pa.int64(), label_type, pa.binary(), pa.list_(pa.float32()), pa.binary())]
            keys = [pa.array([k[i] for k in at], pa.int32()) for i in range(3)]
            yield pa.record_batch([*empty, *keys, pa.array([sums[p][e, w].tolist() for p, e, w in at], pa.list_(pa.int64()))], names=NAMES)

    label_type = to_arrow_type(state.schema["label"].dataType)
    label = state.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, code binary, error long" if final else f"vec_id long, label {label}, code binary, embedding array<float>, bounds binary, part int, entry int, digit int, sums array<long>"
    return state.mapInArrow(run, schema)


def _next_books(state: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks from the tasks' sums: the floor of each entry's mean; entries without rows stay. A row for each entry, digit and place reaches the driver."""
    each = state.where("sums IS NOT NULL").select("part", "entry", "digit", F.posexplode("sums").alias("place", "value"))
    new, count = [b.astype(object) for b in books], {}
    totals: dict[tuple[int, int, int], int] = {}
    for r in each.groupBy("part", "entry", "digit", "place").agg(F.sum("value").alias("value")).collect():
        if r.place == books[r.part].shape[1]:
            if not r.digit:
                count[r.part, r.entry] = r.value
        else:
            key = (r.part, r.entry, r.place)
            totals[key] = totals.get(key, 0) + (r.value << (DIGIT * r.digit))
    for (p, e, k), value in totals.items():
        new[p][e, k] = value // count[p, e]
    return new


def compress_vectors(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of each usable row of rows(vec_id, embedding, label, ...), and the codebooks (entries x places, integers) of the parts.

    Components become floor(scale * x); code holds one byte for each part, the index of its nearest entry (ties: the lower), error the squared distances to these, summed. Codebooks start as the
    vectors of the `entries` (at most 256) smallest vec_ids and become the floored means of their rows in each round.

    Rows go if the vector is null, holds nulls or numbers that aren't finite in single precision, or has another length than the first of the smallest vec_id; null ids come last, rows of
    one id in the order of their vectors. Repeated rows count each. Parts of vectors whose length `parts` doesn't divide differ by one place. Sums and distances are exact at any size; an error
    of 2**63 or more is null. Other columns are ignored. An empty table gives no rows and no codebooks. The driver holds codebooks and their history alone.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256, as one byte holds an index")
    fine = usable(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding"))
    order = [F.asc_nulls_last("vec_id"), F.size("embedding"), "embedding"]
    first = fine.orderBy(*order).select("embedding").limit(1).collect()
    none = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code binary, error long"
    if not first:
        return rows.sparkSession.createDataFrame([], none), []
    dim = len(first[0][0])
    fine = fine.where(F.size("embedding") == dim)
    smallest = [r[0] for r in fine.orderBy(*order).select("embedding").limit(entries).collect()]
    seeds = np.array(smallest, np.float64).reshape(len(smallest), dim)
    widest = fine.select(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x)))).cast("double")).first()[0] or 0.0
    most = int(widest * scale) + 1
    bits = most.bit_length() + 34
    digits = 1 if 4 * (dim // parts + 1) * most * most < 1 << 53 else -(-bits // DIGIT)
    history = [[_integers(seeds[:, a:b], scale, True).reshape(len(seeds), b - a) for a, b in cuts(dim, parts)]]
    state = fine.select("vec_id", "label", "embedding", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("binary").alias("bounds"))
    for k in range(rounds):
        old, state = state, write_once(_round(state, history, dim, scale, digits, False), f"codes-{k}")
        history.append(_next_books(state, history[-1]))
        if k:
            forget(old)
        state = state.where("sums IS NULL")
    coded = write_once(_round(state, history, dim, scale, digits, True), "codes")
    if rounds:
        forget(state)
    return coded, history[-1]
