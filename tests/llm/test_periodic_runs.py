"""Runs of words against brute force over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sparktide.llm import periodic_runs, queries


def brute_runs(words, least=12):
    n, found = len(words), set()
    for q in range(1, n // 2 + 1):
        k = 0
        while k + q < n:
            end = k
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end - k + q >= max(least, 2 * q) and not any(all(words[i] == words[i + d] for i in range(k, end + q - d)) for d in range(1, q)):
                found.add((k, end - k + q, q))
            k = max(end, k) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(brute_collapsed(words, runs)))


def test_common_extensions():
    r = np.random.default_rng(3)
    for alphabet, n in ((1, 300), (2, 700), (3, 50), (50, 400), (1, 1)):
        s = np.append(r.integers(0, alphabet, n), alphabet)
        e = periodic_runs.Extensions(s)
        i = r.integers(0, n + 1, 500)
        j = np.where(r.random(500) < 0.5, r.integers(0, n + 1, 500), np.minimum(i + r.integers(1, 30, 500), n))
        i, j = i[i != j], j[i != j]
        want = []
        for a, b in zip(i, j, strict=True):
            k = 0
            while max(a, b) + k <= n and s[a + k] == s[b + k]:
                k += 1
            want.append(k)
        assert e.common(i, j).tolist() == want


@pytest.mark.parametrize("pairs", [1, 50, 1 << 20])
def test_runs(pairs, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK_PAIRS", pairs)
    r = random.Random(pairs)
    for least in (2, 5, 12):
        texts = [[r.randint(0, r.choice([0, 1, 1, 2, 5])) for _ in range(r.choice([0, 1, 11, 12, 13, 40, 90]))] for _ in range(30)]
        for _ in range(10):
            unit = [r.randint(0, 3) for _ in range(r.randint(1, 7))]
            texts.append([r.randint(0, 3) for _ in range(5)] + unit * r.randint(1, 9) + unit[: r.randint(0, 3)] + [r.randint(0, 3) for _ in range(5)])
        t, start, length, period = periodic_runs.runs(np.array(sum(texts, [])), np.array([len(x) for x in texts]), least)
        got = [[] for _ in texts]
        for k, *run in zip(t.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
            got[k].append(tuple(run))
        assert got == [brute_runs(x, least) for x in texts]


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(periodic_runs, "SLICE_WORDS", 300)
    r = random.Random(5)
    texts = [" ".join(r.choice("abcde") * r.choice([1, 1, 1, 2]) for _ in range(r.randint(0, 120))) for _ in range(120)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "x y " * 9), (None, None), (7, ""), (7, " \t\x0b\n "), (8, None), (9, "a\x1cb é ü " * 20), (9, "a\x1cb é ü " * 20)]
    table = spark.createDataFrame([(*x, 1, "r", None) for x in rows], "doc_id long, text string, start long, runs string, words string").repartition(3)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    order = lambda x: [(v is None, v) for v in x]
    assert sorted(map(tuple, got.collect()), key=order) == sorted([brute_row(*x) for x in rows], key=order)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert queries.op12_periodic_runs(spark, str(tmp_path / "empty")).count() == 0


def test_very_long_text(spark):
    words = ["a"] * 60_000 + ["b", "c", "d"] * 30_000 + [f"w{k % 40_000}" for k in range(90_000)]
    got = periodic_runs.find_runs(spark.createDataFrame([(1, words)], "doc_id long, words array<string>")).first()
    assert [tuple(x) for x in got.runs] == [(0, 60_000, 1), (60_000, 90_000, 3), (150_000, 90_000, 40_000)]
    assert got.collapsed == " ".join(["a", "b", "c", "d"] + [f"w{k}" for k in range(40_000)])
