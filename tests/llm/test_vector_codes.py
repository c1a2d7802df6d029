"""Product codes against brute force in Python integers."""

import math
import random

import numpy as np
import pytest

from sparktide.llm import vector_codes


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    fine = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, len(r[1]), r[1]))
    fine = [r for r in fine if len(r[1]) == len(fine[0][1])]
    dim = len(fine[0][1])
    cuts = [(k * dim // parts, (k + 1) * dim // parts) for k in range(parts)]
    whole = [[math.floor(scale * x) for x in r[1]] for r in fine]
    books = [[v[a:b] for v in whole[:entries]] for a, b in cuts]

    def nearest(v, book):
        return min((sum((x - y) ** 2 for x, y in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            own = [[] for _ in books[p]]
            for v in whole:
                own[nearest(v[a:b], books[p])[1]].append(v[a:b])
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for m, e in zip(own, books[p], strict=True)]
    out = []
    for r, v in zip(fine, whole, strict=True):
        best = [nearest(v[a:b], books[p]) for p, (a, b) in enumerate(cuts)]
        out.append((r[0], r[2], bytes(k for _, k in best).hex(), sum(d for d, _ in best)))
    return out, books


def single(x):
    return [None if c is None else float(np.float32(c)) for c in x]


@pytest.mark.parametrize("size", [1.0, 3e5, 1e30])
@pytest.mark.parametrize("entries", [7, 256])
def test_codes(spark, size, entries):
    r = random.Random(entries)
    rows = [(k, single(size * r.choice([r.gauss(0, 1), 0.5, -0.25]) for _ in range(10)), r.choice([None, 1, 2])) for k in range(150)]
    rows += [(k, rows[k % 5][1], 3) for k in range(150, 320)]  # repeated vectors, hence ties
    rows += [(None, rows[0][1], 1), (3, rows[9][1], None), (3, rows[9][1], None), (400, None, 1), (401, [], 1), (402, single([1.0] * 9), 1)]
    rows += [(403, single([1.0] * 9) + [None], 1), (404, single([1.0] * 9) + [float("nan")], 1), (405, single([1.0] * 9) + [float("-inf")], 1)]
    table = spark.createDataFrame([(*x, "s", 1) for x in rows], "vec_id long, embedding array<float>, label int, code string, sums int").repartition(3)
    coded, books = vector_codes.compress_vectors(table, entries=entries)
    want, want_books = brute(rows, entries=entries)
    want = [(i, y, c, e if e < 1 << 63 else None) for i, y, c, e in want]
    order = lambda x: [(v is None, v) for v in x]
    assert sorted([(x.vec_id, x.label, bytes(x.code).hex(), x.error) for x in coded.collect()], key=order) == sorted(want, key=order)
    assert [b.tolist() for b in books] == want_books


def test_bounds_spare_work():
    r = np.random.default_rng(1)
    x = np.floor(np.concatenate([r.normal(c * 4000, 50, (200, 4)) for c in range(16)]))
    history, n = [x[:: len(x) // 32][:32]], len(x)
    own = vector_codes.Bounds(np.zeros(n, int), np.full(n, np.inf, np.float32), np.full((n, vector_codes.GROUPS), -np.inf, np.float32), np.zeros(n, np.uint8), np.zeros((n, vector_codes.GROUPS), np.uint8))
    work = []
    for _ in range(5):
        work.append(own.advance(x, history))
        assert (own.code == vector_codes.distances(x, history[-1]).argmin(axis=1)).all()
        history.append(np.stack([np.floor(x[own.code == k].mean(axis=0)) if (own.code == k).any() else history[-1][k] for k in range(32)]))
    assert work[0] == n * 33 and max(work[2:]) < work[0] / 2


def test_empty_and_narrow(spark):
    schema = "vec_id long, embedding array<double>, label int"
    for rows in ([], [(1, None, 1)]):
        coded, books = vector_codes.compress_vectors(spark.createDataFrame(rows, schema))
        assert coded.count() == 0 and books == []
    coded, books = vector_codes.compress_vectors(spark.createDataFrame([(2, [], None), (1, [], 5)], schema))
    assert sorted((x.vec_id, x.error) for x in coded.collect()) == [(1, 0), (2, 0)] and [b.shape for b in books] == [(2, 0)] * 4
    coded, _ = vector_codes.compress_vectors(spark.createDataFrame([(1, [0.5, -0.0001], 5)], schema))
    assert [(bytes(x.code), x.error) for x in coded.collect()] == [(b"\0" * 4, 0)]
    with pytest.raises(ValueError):
        vector_codes.compress_vectors(spark.createDataFrame([], schema), entries=300)
