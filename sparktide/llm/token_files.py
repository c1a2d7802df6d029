"""Token ids as flat unsigned integer files with 64-bit document offsets."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktide.llm.common import new_path, partitions, write_once
from sparktide.llm.pieces import slices

END = 2
#: Pre-token runs that a worker keeps before it starts anew; the results don't depend on it.
CACHE_WORDS = 2_000_000
#: Bytes of ids of the longest run that it keeps.
CACHE_BYTES = 128
#: Documents and ids that a reader holds at a time; a document of more ids comes alone.
READ_DOCS = 4_096
READ_IDS = 4_000_000
# The fixed set of characters that Unicode calls White_Space.
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")
# Characters that some libraries take for white space and others don't.
_DOUBTFUL = re.compile(r"[\x1c-\x1f\x85\u180e\u200b-\u200d\u2060\ufeff]")


# A word of Latin letters and the ASCII punctuation behind it, which the pre-tokenizer takes for two pre-tokens.
_WORD_AND_MARKS = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]+)")
# Runs that can be told apart when they go to the library as lines of one text.
_PLAIN = re.compile(f" [^{_SPACES}]+")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer, the strings it looks for in raw text, the id of a line break, the type of an id and the ids of runs seen so far."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return tokenizer, added, tokenizer.encode("\n", add_special_tokens=False).ids, id_type(tokenizer.get_vocab_size()), {}


def id_type(vocabulary: int) -> str:
    """The smallest unsigned type that holds all ids."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _encode_runs(tokenizer, line: list[int], kind: str, runs: list[str]) -> dict[str, bytes]:
    code = "H" if kind == "<u2" else "I"
    out, plain, other = {}, [], []
    for run in runs:
        (plain if _PLAIN.fullmatch(run) else other).append(run)
    for k in range(0, len(plain), 2000):
        part = plain[k : k + 2000]
        ids = np.array(tokenizer.encode("\n".join(part), add_special_tokens=False).ids, kind)
        at = np.flatnonzero(ids == line[0])
        if len(line) != 1 or len(at) != len(part) - 1:
            other += part
            continue
        raw, size = ids.tobytes(), ids.itemsize
        out.update(zip(part, (raw[a * size : b * size] for a, b in zip([0, *(at + 1).tolist()], [*at.tolist(), len(ids)], strict=True)), strict=True))
    out.update((run, array(code, e.ids).tobytes()) for run, e in zip(other, tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True))
    return out


def encode_texts(path: str, texts: list[str | None]) -> list[bytes]:
    """Ids of each text as little-endian unsigned integers of id_type(), by the tokenizers library.

    The byte-level pre-tokenizer never reaches across the place before white space that follows other
    characters, so runs cut there are encoded once and looked up after that. Texts with strings of added
    tokens or doubtful characters go to the library whole.
    """
    tokenizer, added, line, kind, seen = _tokenizer(path)
    texts = [t or "" for t in texts]
    odd = {k for k, t in enumerate(texts) if _DOUBTFUL.search(t) or any(x in t for x in added)}
    runs: list[str] = []
    ends = []
    for k, t in enumerate(texts):
        if k not in odd:
            runs += _RUN.findall(t)
        ends.append(len(runs))
    if len(seen) > CACHE_WORDS:
        seen.clear()
    found = list(map(seen.get, runs))
    missing = [k for k, ids in enumerate(found) if ids is None]
    if missing:
        new = {runs[k] for k in missing}
        split = {run: m.groups() for run in new if (m := _WORD_AND_MARKS.fullmatch(run))}
        wanted = new.difference(split).union(*split.values())
        seen.update(_encode_runs(tokenizer, line, kind, [w for w in wanted if w not in seen]))
        seen.update((run, seen[a] + seen[b]) for run, (a, b) in split.items())
        for k in missing:
            found[k] = seen[runs[k]]
        for run in new.union(wanted):
            if len(seen[run]) > CACHE_BYTES:
                del seen[run]
    out = [b"".join(found[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    for k in odd:
        out[k] = np.array(tokenizer.encode(texts[k], add_special_tokens=False).ids, kind).tobytes()
    return out


def _put(base: str, name: str, chunks) -> None:
    """Writes a file under a name of its own and moves it into place, so that a task may be run again."""
    system, folder = fs.FileSystem.from_uri(base)
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/{(tmp := f'{name}.{uuid.uuid4().hex}.tmp')}") as out:
        for chunk in chunks:
            out.write(chunk)
    system.move(f"{folder}/{tmp}", f"{folder}/{name}")


def _reader(base: str, name: str, kind: str):
    """A function of (first, end) for parts of a file of numbers: memory-mapped where the folder is mounted, else read by range."""
    system, folder = fs.FileSystem.from_uri(base)
    path, wide = f"{folder}/{name}", np.dtype(kind).itemsize
    if not system.get_file_info(path).size:
        return lambda a, b: np.empty(0, kind)
    if isinstance(system, fs.LocalFileSystem):
        mapped = np.memmap(path, kind, "r")
        return lambda a, b: mapped[a:b]
    file = system.open_input_file(path)
    return lambda a, b: np.frombuffer(file.read_at((b - a) * wide, a * wide), kind)


def write_token_files(docs: DataFrame, tokenizer_path: str, base: str, parts: int, end: int = END) -> DataFrame:
    """Writes docs(doc_id, text, ...) in ascending doc_id order to the folder `base` (a URI all executors reach); returns its manifest.

    Part k is three files: part-k.tokens (ids of id_type(), each document closed by `end`),
    part-k.offsets (unsigned 64-bit starts of its documents within the part, and its length) and
    part-k.docs (64-bit doc_ids; the lowest number stands for null). The manifest is (part, id_bytes, n_docs, n_tokens, base_docs, base_tokens), the
    bases being sums over the parts before. Null ids come first, null texts are empty, rows of one doc_id
    stand by text. A part without rows has no files and no manifest row. Other columns are ignored.
    """

    def write(batches):
        name = f"part-{TaskContext.get().partitionId():06d}"
        ids, sizes = [], []

        def chunks(batch):
            while batch is not None:
                texts = batch.column(1).to_pylist()
                ids.append(batch.column(0).fill_null(-(1 << 63)).to_numpy())
                for a, b in slices(texts):
                    coded = [x + mark for x in encode_texts(tokenizer_path, texts[a:b])]
                    sizes.append(np.fromiter(map(len, coded), np.int64, len(coded)) // mark_size)
                    yield b"".join(coded)
                batch = next(filled, None)

        mark = np.array([end], _tokenizer(tokenizer_path)[3]).tobytes()
        mark_size = len(mark)
        filled = (b for b in batches if b.num_rows)
        first = next(filled, None)
        if first is None:
            return
        _put(base, f"{name}.tokens", chunks(first))
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype("<u8")
        _put(base, f"{name}.offsets", [offsets.tobytes()])
        _put(base, f"{name}.docs", [np.concatenate(ids).astype("<i8").tobytes()])
        yield pa.record_batch([pa.array([x]) for x in (int(name[5:]), mark_size, len(offsets) - 1, int(offsets[-1]))], names=["part", "id_bytes", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = write_once(dealt.mapInArrow(write, "part long, id_bytes long, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    return manifest.select("*", *[F.coalesce(F.sum(f"n_{x}").over(before), F.lit(0)).alias(f"base_{x}") for x in ("docs", "tokens")])


def read_token_files(manifest: DataFrame, base: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files; start counts the ids of all documents before it, ids_crc32 is over 32-bit ids."""

    def read(batches):
        for batch in batches:
            for part, first, size, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = f"part-{part:06d}"
                tokens, offsets, docs = (_reader(base, f"{name}.{x}", kind) for x, kind in (("tokens", f"<u{size}"), ("offsets", "<u8"), ("docs", "<i8")))
                at = 0
                while at < n:
                    ends = offsets(at, min(n, at + READ_DOCS) + 1).astype(np.int64)
                    many = max(1, int(np.searchsorted(ends, ends[0] + READ_IDS, "right")) - 1)
                    ends, ids = ends[: many + 1], docs(at, at + many)
                    held = tokens(int(ends[0]), int(ends[-1]))
                    sums = [zlib.crc32(held[a:b].astype("<u4")) for a, b in zip((ends[:-1] - ends[0]).tolist(), (ends[1:] - ends[0]).tolist(), strict=True)]
                    at += many
                    yield pa.record_batch([pa.array(ids, pa.int64(), mask=ids == -(1 << 63)), pa.array(ends[:-1] + first), pa.array(np.diff(ends)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = manifest.select("part", "base_tokens", "id_bytes", "n_docs")
    return rows.repartition(partitions(manifest.sparkSession)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes the files of docs to a new folder of the shared one and reads them back: (doc_id, start, n_tokens, ids_crc32) of every row.

    A null or empty text has the end id alone; very long texts are encoded whole; repeated rows stand beside each other, each with a start of its own; null
    ids come first; an empty table gives no rows; other columns are ignored. All rows of one doc_id are written by one task.
    """
    base = new_path(spark, "tokens")
    base = base if "://" in base else "file://" + base.removeprefix("file:")
    return read_token_files(write_token_files(docs, tokenizer_path, base, partitions(spark)), base)
