"""EDF recordings: headers, signals and windows. Tasks read ranges of records, so that one recording fills many tasks and no content crosses a shuffle."""

from __future__ import annotations

import uuid
from fractions import Fraction
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "path string, sfreq double, n_samples long, channels array<string>, error string"
#: Seconds of a recording that a task decodes at a time, and seconds on either side that resampling looks at besides.
BLOCK_SEC = 120.0
MARGIN_SEC = 10.0
#: Windows that a decoder hands on at a time.
BATCH = 64


def discover(spark: SparkSession, folder: str, pattern: str = "*.edf") -> DataFrame:
    """(path, length, content) of the files; content is read only where it is asked for."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def write(rows: DataFrame, folder: str, channels: tuple[str, ...], rate: int, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Writes folder/<name>.edf for each of rows(name, signal: channels x samples of whole seconds), records of a second each; returns (name, records).

    Values are cut to [low, high] and rounded to 16 bits, halves up. A file is written aside and then moved, so that a task that runs twice leaves one whole file.
    """
    text = lambda x, n: str(x)[:n].ljust(n).encode("ascii", "replace")

    def run(batches):
        for pdf in batches:
            out = []
            for name, signal in zip(pdf["name"], pdf["signal"], strict=True):
                x = np.clip(np.stack([np.asarray(c, float) for c in signal]), low, high)
                records = x.shape[1] // rate
                digital = (np.floor((x[:, : records * rate] - low) / (high - low) * 65535 + 0.5) - 32768).astype("<i2")
                ns = len(channels)
                head = text(0, 8) + text("", 160) + text("01.01.24", 8) + text("00.00.00", 8) + text(256 * (ns + 1), 8) + text("", 44) + text(records, 8) + text(1, 8) + text(ns, 4)
                for value, width in ((None, 16), ("", 80), ("uV", 8), (low, 8), (high, 8), (-32768, 8), (32767, 8), ("", 80), (rate, 8), ("", 32)):
                    head += b"".join(text(c if value is None else value, width) for c in channels)
                system, place = _system(f"{folder}/{name}.edf")
                system.create_dir(place.rpartition("/")[0], recursive=True)
                aside = f"{place}.{uuid.uuid4().hex}"
                with system.open_output_stream(aside) as file:
                    file.write(head + digital.reshape(ns, records, rate).transpose(1, 0, 2).tobytes())
                system.move(aside, place)
                out.append((name, records))
            yield pd.DataFrame(out, columns=["name", "records"])

    return rows.select("name", "signal").mapInPandas(run, "name string, records long")


def header(data: bytes) -> dict:
    """The fields of an EDF header: fixed-width ASCII text."""
    text = lambda a, n: data[a : a + n].decode("ascii", "replace").strip()
    ns = int(text(252, 4))

    def each(start: int, width: int) -> list[str]:
        return [text(256 + start * ns + width * k, width) for k in range(ns)]

    h = {
        "labels": each(0, 16), "pmin": [float(x) for x in each(104, 8)], "pmax": [float(x) for x in each(112, 8)], "dmin": [float(x) for x in each(120, 8)],
        "dmax": [float(x) for x in each(128, 8)], "per_record": [int(x) for x in each(216, 8)], "records": int(text(236, 8)), "duration": float(text(244, 8)), "start": 256 + 256 * ns,
    }
    for label, low, high in zip(h["labels"], h["dmin"], h["dmax"], strict=True):
        if low == high:
            raise ValueError(f"channel {label} has no digital range")
    if h["duration"] <= 0 or sum(h["per_record"]) <= 0:
        raise ValueError("records hold no samples")
    return h


def _system(path: str):
    """The file system of a path and its place there; blanks and the like in a path stay as they are."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@%"))


def _open(path: str):
    """A file for reading at any place."""
    system, place = _system(path)
    return system.open_input_file(place)


def _head(path: str) -> bytes:
    """The header's bytes alone: 256, and 256 for each of the channels that these name."""
    with _open(path) as file:
        first = file.read(256)
        return first + file.read(256 * int(first[252:256]))


def headers(files: DataFrame) -> DataFrame:
    """(path, sfreq, n_samples, channels, error) of each file of discover(); annotation channels are left out.

    Only the headers are read. n_samples counts the whole records that the file's length holds. A file that can't be read as EDF has an error and nulls; one that ends before the records that its
    header counts (-1: unknown) has an error beside its other fields.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for path, length in zip(pdf["path"], pdf["length"], strict=True):
                try:
                    h = header(_head(path))
                    keep = [k for k, x in enumerate(h["labels"]) if "annotations" not in x.lower()]
                    per, records = h["per_record"][keep[0]] if keep else 0, (length - h["start"]) // (2 * sum(h["per_record"]))
                    short = f"truncated: {records} of {h['records']} records" if 0 <= records < h["records"] else None
                    out.append((path, per / h["duration"], per * max(records, 0), [h["labels"][k] for k in keep], short))
                except Exception as e:  # noqa: BLE001  whatever is wrong with a file goes to the dead letters
                    out.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            frame = pd.DataFrame(out, columns=["path", "sfreq", "n_samples", "channels", "error"])
            yield frame.astype({"n_samples": "Int64"})

    return files.select("path", "length").mapInPandas(run, HEADER)


def decoded(data: bytes, rate: float) -> tuple[list[str], list[np.ndarray]]:
    """Names and physical values of every channel of a file but annotations, resampled to `rate` by cutting or padding the spectrum."""
    h = header(data)
    flat = np.frombuffer(data, "<i2", offset=h["start"])
    grid = flat[: len(flat) // sum(h["per_record"]) * sum(h["per_record"])].reshape(-1, sum(h["per_record"]))
    at = np.concatenate(([0], np.cumsum(h["per_record"])))
    names, values = [], []
    for k, name in enumerate(h["labels"]):
        if "annotations" in name.lower():
            continue
        scale = (h["pmax"][k] - h["pmin"][k]) / (h["dmax"][k] - h["dmin"][k])
        x = (grid[:, at[k] : at[k + 1]].ravel().astype(float) - h["dmin"][k]) * scale + h["pmin"][k]
        names.append(name)
        values.append(resample(x, h["per_record"][k] / h["duration"], rate).astype(np.float32))
    return names, values


def signals(files: DataFrame, rate: float = 256.0) -> DataFrame:
    """(path, sfreq, channels, signal): the values of every channel at `rate`."""

    def run(batches):
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                names, values = decoded(bytes(data), rate)
                yield pd.DataFrame([(path, rate, names, [v.tolist() for v in values])], columns=["path", "sfreq", "channels", "signal"])

    return files.select("path", "content").mapInPandas(run, "path string, sfreq double, channels array<string>, signal array<array<float>>")


def read_range(path: str, h: dict, order: tuple[str, ...], first: int, end: int, rate: float) -> np.ndarray:
    """(channels, samples): samples [first, end) at `rate` of the channels `order`, read from their records alone.

    Of channels of equal names, apart from upper case and the prefix 'EEG ', the last counts. At another rate than the file's, MARGIN_SEC on either side (beyond the ends: the last value) are faded out and resampled
    with the range by cutting or padding the spectrum, then dropped. ValueError if the file doesn't hold the range.
    """
    names = [x.replace("EEG ", "").replace("eeg ", "").strip().upper() for x in h["labels"]]
    picked = [max(k for k, x in enumerate(names) if x == want) for want in order]
    per, starts = h["per_record"], np.concatenate(([0], np.cumsum(h["per_record"])))
    out = []
    with _open(path) as file:
        held = (file.size() - h["start"]) // (2 * sum(per))
        for own in sorted({per[k] for k in picked}):  # channels of one rate are read together
            ratio = Fraction(rate).limit_denominator(1000) * Fraction(h["duration"]).limit_denominator(1000) / own
            margin = 0 if ratio == 1 else int(MARGIN_SEC * own / h["duration"]) // ratio.denominator * ratio.denominator
            last, whole = -(-end * ratio.denominator // ratio.numerator), held * own
            if last > whole + 1 or not whole:
                raise ValueError(f"samples up to {last} of {whole}")
            a = int(first / ratio) // ratio.denominator * ratio.denominator - margin
            b = a - (a - last - margin) // ratio.denominator * ratio.denominator
            low, high = max(0, a), min(whole, b)
            r0, r1 = low // own, -(-high // own)
            file.seek(h["start"] + 2 * sum(per) * r0)
            grid = np.frombuffer(file.read(2 * sum(per) * (r1 - r0)), "<i2").reshape(-1, sum(per))
            for k in (k for k in picked if per[k] == own):
                scale = (h["pmax"][k] - h["pmin"][k]) / (h["dmax"][k] - h["dmin"][k])
                x = (grid[:, starts[k] : starts[k + 1]].ravel()[low - r0 * own : high - r0 * own].astype(float) - h["dmin"][k]) * scale + h["pmin"][k]
                if ratio != 1:
                    x = resample(_faded(np.pad(x, (low - a, b - high), "edge"), margin, b - last), own / h["duration"], rate)
                at = int(a * ratio)
                out.append((k, x[first - at : end - at].astype(np.float32)))
    by = dict(out)
    return np.stack([by[k] for k in picked])


def _faded(x: np.ndarray, ahead: int, behind: int) -> np.ndarray:
    """x with the outer halves of its margins falling to its mean, so that its ends meet."""
    x, mean = x.copy(), x.mean() if len(x) else 0.0
    for n, part in ((ahead // 2, slice(0, ahead // 2)), (behind // 2, slice(len(x) - behind // 2, len(x)))):
        if n:
            up = 0.5 - 0.5 * np.cos(np.pi * (np.arange(n) + 0.5) / n)
            x[part] = mean + (x[part] - mean) * (up if part.start == 0 else up[::-1])
    return x


def block_of(start: Column, rate: float = 256.0) -> Column:
    """The block of BLOCK_SEC seconds that a window's start falls in."""
    return F.floor(start / F.lit(float(int(BLOCK_SEC * rate)))).cast("long")


def windows(hops: DataFrame, order: tuple[str, ...], length: int, rate: float = 256.0) -> DataFrame:
    """(path, start, label, signal, error) of hops(path, start, label): `length` samples of the channels `order` from each start.

    Hops of one block of a recording meet in one task, which reads the records of that block alone: paths and starts are shuffled, never content, and a recording fills as many tasks as it has
    blocks. Windows leave a task in Arrow batches. A block that can't be read gives one row with its error and without a window; the other blocks are not touched by it.
    """
    cuts = hops.groupBy("path", block_of(F.col("start"), rate).alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("label").cast("int").alias("label")))).alias("cuts"))
    spark = hops.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = pa.list_(pa.list_(pa.float32()))
    names = ["path", "start", "label", "signal", "error"]

    def run(batches):
        for batch in batches:
            for path, cut in zip(batch.column("path").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                first = cut[0]["start"]
                try:
                    held = read_range(path, header(_head(path)), order, first, cut[-1]["start"] + length, rate)
                except Exception as e:  # noqa: BLE001  whatever is wrong with a block goes to the dead letters
                    yield pa.record_batch([pa.array([path]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, kind), pa.array([f"{type(e).__name__}: {e}"])], names=names)
                    continue
                for k in range(0, len(cut), BATCH):
                    part = cut[k : k + BATCH]
                    values = np.stack([held[:, c["start"] - first :][:, :length] for c in part])
                    inner = pa.ListArray.from_arrays(pa.array(np.arange(len(part) * len(order) + 1) * length, pa.int32()), pa.array(values.ravel(), pa.float32()))
                    signal = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * len(order), pa.int32()), inner)
                    yield pa.record_batch([pa.array([path] * len(part)), pa.array([c["start"] for c in part], pa.int64()), pa.array([c["label"] for c in part], pa.int32()), signal, pa.nulls(len(part), pa.string())], names=names)

    # A hash of the keys keeps this shuffle apart from the grouping's, whose partitions would be merged by their few bytes.
    return cuts.repartition(tasks, F.xxhash64("path", "block")).select("path", "cuts").mapInArrow(run, "path string, start long, label int, signal array<array<float>>, error string")


def resample(x: np.ndarray, old: float, new: float) -> np.ndarray:
    if old == new or not len(x):
        return x
    n = int(round(len(x) * new / old))
    return np.fft.irfft(np.fft.rfft(x)[: n // 2 + 1], n) * (n / len(x)) if n < len(x) else np.fft.irfft(np.pad(np.fft.rfft(x), (0, n // 2 + 1 - (len(x) // 2 + 1))), n) * (n / len(x))
