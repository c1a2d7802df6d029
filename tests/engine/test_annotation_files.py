"""The parser of annotation files against a plain loop over their lines."""

import random

import pytest

from sparktide.sources import annotations


def plain(lines):
    rate, held, out = 512.0, {}, []

    def close():
        if len(held) == 5:
            first = held["reg_start"]
            out.append((held["file_name"], *[float(held[k] - first + (86_400 if held[k] < first else 0)) for k in ("reg_end", "s", "e")], rate))
            held.clear()

    for kind, value in lines:
        if kind == "rate":
            rate = value or rate
        elif kind == "file_name":
            close()
            held[kind] = value
        elif kind != "other":
            if value is not None:
                held[kind] = value
            if kind == "e":
                close()
    close()
    return out


def written(kind, value):
    clock = lambda s: "later" if s is None else f"{s // 3600}.{s // 60 % 60}.{s % 60}"
    return {
        "rate": lambda: f"Data Sampling Rate: {int(value)} Hz" if value else "Data Sampling Rate: fast", "file_name": lambda: f"File name: {value}", "reg_start": lambda: f"Registration start time: {clock(value)}",
        "reg_end": lambda: f"Registration end time: {clock(value)}", "s": lambda: f"Seizure start time: {clock(value)}", "e": lambda: f"Seizure end time: {clock(value)}", "other": lambda: value,
    }[kind]()


@pytest.mark.parametrize("size", [1, 3, 1024])
def test_incomplete_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(annotations, "RANGE", size)
    r, rows, want = random.Random(size), [], []
    for file in range(60):
        lines = []
        for _ in range(r.randint(0, 25)):
            if r.random() < 0.5:  # whole blocks, in which lines may be missing
                block = [("file_name", f"f{r.randint(0, 9)}.edf"), *[(k, r.randint(0, 86_399)) for k in ("reg_start", "reg_end", "s", "e")]]
                lines += [x for x in block if r.random() < 0.9]
            else:
                kind = r.choice(["rate", "file_name", "reg_start", "reg_end", "s", "e", "other"])
                value = {"rate": r.choice([256.0, None]), "file_name": "g.edf", "other": r.choice(["", "Channel 1: F3"])}.get(kind, r.choice([None, r.randint(0, 86_399)]))
                lines.append((kind, value))
        want += [(file, *x) for x in plain(lines)]
        rows += [(file, k, written(*x)) for k, x in enumerate(lines)]
    table = spark.createDataFrame(rows, "file long, line int, text string").repartition(4)
    found = annotations.blocks_exact(table, "file", "line", "text")
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 100
    assert "Python" not in found._jdf.queryExecution().toString() and found._jdf.queryExecution().toString().count("Exchange hashpartitioning(file") <= 2
    assert annotations.blocks_exact(table.where("false"), "file", "line", "text").count() == 0
