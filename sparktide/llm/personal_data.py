"""Personal data by patterns and by a skip-chain conditional random field that carries labels to repeated and similar tokens of a document."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktide.llm.common import forget, write_once
from sparktide.llm.pieces import slices

KINDS = ("email", "ip", "card", "phone")
#: Hashed features, and those of a token: the first OWN tell of the token itself, the others of its neighbours and of every token.
BUCKETS = 1 << 12
SLOTS = 10
OWN = 7
#: Texts whose sites the field is fitted on, and sites of each; rounds and step of the fit, and the cost of its weights.
TRAIN_ROWS = 4_000
TRAIN_SITES = 100
FIT_ROUNDS = 250
FIT_STEP = 0.1
FIT_COST = 1e-4
#: Rounds of message passing, the share that a message keeps of its last value, and the chance from which a span is added.
ROUNDS = 12
DAMPING = 0.3
THRESHOLD = 0.8
#: Links that a task sends messages over at a time.
EDGES = 1 << 16

SITE = np.dtype([("start", "<i8"), ("end", "<i8"), ("label", "i1"), ("chained", "i1"), ("same", "<u8"), ("tail", "<u8"), ("slots", "<u2", (SLOTS,))])

# The base patterns, fixed by the contract; the signs before them keep places out where no leftmost match can start.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SITE = re.compile(r"(?<![^\x20\t-\r])[^\x20\t-\r0-9@]*+[0-9@][^\x20\t-\r]*")
_GAP = re.compile(r"[\x20\t-\r]*")
_DIGITS = re.compile(r"[0-9]+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def luhn(digits: str) -> bool:
    """Whether the checksum of a card number holds."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match holds one @, with all characters of a local part before it that no match has taken."""
    last, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        first = at
        while domain and first > last and not _NOT_LOCAL.match(text, first - 1):
            first -= 1
        if domain and first < at:
            yield first, domain.end()
            last = domain.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of the base patterns' matches that pass their checks, by start, then kind."""
    found = [(a, b, 0) for a, b in _emails(text)]
    if _DIGITS.search(text):
        found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if _octets(m.group())]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        if "+" in text:
            found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def _bucket(name: str, value: object) -> int:
    return zlib.crc32(f"{name}={value}".encode("utf-8", "surrogatepass")) % BUCKETS


def _number(value: str) -> int:
    raw = value.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 32 | zlib.crc32(raw, 1)


def _features(token: str, before: str, after: str) -> list[int]:
    """Hashed features of a token: its outline and ends, digits, signs and checks, then its neighbours' outlines and the constant."""
    outline = re.sub(r"[^\W\d_]", "a", re.sub("[0-9]", "9", token))
    digits = "".join(_DIGITS.findall(token))
    signs = "".join(sorted(set(re.sub(r"\w", "", token))))
    near = [re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "9", w[-16:].lower())) for w in (before, after)]
    checks = (12 <= len(digits) <= 19 and luhn(digits), token.count(".") >= 3 and _octets(re.sub("[^0-9.]", "", token).strip(".")[:64] or "256"))
    own = [re.sub(r"(.)\1+", r"\1", outline)[:64], outline[:6], outline[-6:], min(len(digits), 24), signs, (checks, len(digits) > 11), ("@" in token, token.count("."), token[:1] == "+")]
    return [_bucket(f"own{k}", v) for k, v in enumerate(own)] + [_bucket("before", near[0]), _bucket("after", near[1]), _bucket("all", 1)]


def sites(text: str, base: list[tuple[int, int, int]]) -> np.ndarray:
    """The tokens with a digit or @, each with the label of the base span over it (0: none), whether it follows the site before it, the hashes under which it meets like tokens, and its features."""
    out, last, k = [], -1, 0
    for m in _SITE.finditer(text):
        start, end = m.span()
        while k < len(base) and base[k][1] <= start:
            k += 1
        label = min((kind + 1 for a, b, kind in base[k : k + 8] if a < end and b > start), default=0)
        token = m.group()
        word = re.sub(r"[\W_]", "", token).lower()
        digits = "".join(_DIGITS.findall(token))
        before, after = text[max(0, start - 48) : start].split(), text[end : end + 48].split()
        chained = last >= 0 and _GAP.fullmatch(text, last, start) is not None
        out.append((start, end, label, chained, _number(word) if len(word) > 3 else 0, _number(digits[-7:]) if len(digits) > 6 else 0, _features(token, before[-1] if before else "", after[0] if after else "")))
        last = end
    return np.array(out, SITE)


class Field:
    """Weights of the field: of features, of neighbours' labels, and of equal labels of like tokens, for two sorts of likeness."""

    def __init__(self):
        n = len(KINDS) + 1
        self.unary, self.chain, self.skip = np.zeros((BUCKETS, n)), np.zeros((n, n)), np.zeros((2, n))

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.unary, self.chain, self.skip]


def links(rows: np.ndarray, row: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each sort of likeness the pairs (site, next like site of its row): chains through all occurrences, never all their pairs."""
    out = []
    for name in ("same", "tail"):
        at = np.flatnonzero(rows[name] != 0)
        at = at[np.lexsort((at, rows[name][at], row[at]))]
        pair = (rows[name][at][1:] == rows[name][at][:-1]) & (row[at][1:] == row[at][:-1])
        out.append((at[:-1][pair], at[1:][pair]))
    return out


def _neighbours(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b = np.flatnonzero(rows["chained"] == 1)
    b = b[b > 0]
    return b - 1, b


def fit(tables: list[np.ndarray], rounds: int = FIT_ROUNDS, step: float = FIT_STEP, cost: float = FIT_COST) -> Field:
    """Weights of greatest pseudo-likelihood: each site's label given its features and the labels of its neighbours and like sites.

    Every site counts three times: with all it has, without the features of the token itself, and by its like sites alone, so that each of these gets weights of its own.
    A site without a base span whose like sites have one is what the field is to judge, not an example of no label: it isn't learned from.
    """
    field, n = Field(), len(KINDS) + 1
    tables = [t for t in tables if len(t)]
    if not tables:
        return field
    rows, row = np.concatenate(tables), np.repeat(np.arange(len(tables)), [len(t) for t in tables])
    label, slots = rows["label"].astype(int), rows["slots"].astype(int)
    left, right = _neighbours(rows)
    onehot = np.eye(n)[label]
    before, after = np.tile(np.eye(n)[0], (len(rows), 1)), np.tile(np.eye(n)[0], (len(rows), 1))
    before[right], after[left] = onehot[left], onehot[right]
    like = np.zeros((2, len(rows), n))
    for k, (a, b) in enumerate(links(rows, row)):
        np.add.at(like[k], a, onehot[b])
        np.add.at(like[k], b, onehot[a])
    weight = ((label > 0) | (like[:, :, 1:].sum(axis=(0, 2)) == 0))[:, None] / len(rows)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in field.parts]
    for t in range(1, rounds + 1):
        grads = [cost * p for p in field.parts]
        for first, chain in ((0, 1.0), (OWN, 1.0), (SLOTS - 1, 0.0)):
            seen = slots[:, first:]
            score = field.unary[seen].sum(axis=1) + chain * (before @ field.chain + after @ field.chain.T) + np.einsum("kin,kn->in", like, field.skip)
            p = np.exp(score - score.max(axis=1, keepdims=True))
            off = (p / p.sum(axis=1, keepdims=True) - onehot) * weight
            for y in range(n):
                grads[0][:, y] += np.bincount(seen.ravel(), weights=np.repeat(off[:, y], seen.shape[1]), minlength=BUCKETS)
            grads[1] += chain * (before.T @ off + off.T @ after)
            grads[2] += np.einsum("kin,in->kn", like, off)
        for p, g, (m, v) in zip(field.parts, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return field


def infer(rows: np.ndarray, row: np.ndarray, field: Field, rounds: int = ROUNDS, damping: float = DAMPING) -> np.ndarray:
    """The chance of each label at each site by loopy message passing; sites with a base span keep its label."""
    n, m = len(KINDS) + 1, len(rows)
    score = field.unary[rows["slots"].astype(int)].sum(axis=1)
    left, right = _neighbours(rows)
    starts, ends = np.ones(m, bool), np.ones(m, bool)
    starts[right], ends[left] = False, False
    score[starts] += field.chain[0]
    score[ends] += field.chain[:, 0]
    known = rows["label"] > 0
    score[known] = np.where(np.eye(n)[rows["label"][known].astype(int)] > 0, 0.0, -1e9)
    # Each edge stands twice, once for either direction, with the number of its table: the chain's, its transpose, or that of a sort of likeness.
    pairs = [(left, right), *links(rows, row)]
    a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    tables = np.stack([field.chain, *map(np.diag, field.skip), field.chain.T])
    sort = np.repeat(np.arange(len(pairs)), [len(p[0]) for p in pairs])
    source, target, sort = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([sort, np.where(sort == 0, len(tables) - 1, sort)])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    message = np.zeros((len(source), n))

    def beliefs() -> np.ndarray:
        out = score.copy()
        for y in range(n):
            out[:, y] += np.bincount(target, weights=message[:, y], minlength=m)
        return out

    for _ in range(rounds if len(source) else 0):
        belief, new = beliefs(), np.empty_like(message)
        for k in range(0, len(source), EDGES):
            part = slice(k, k + EDGES)
            ready = (belief[source[part]] - message[back[part]])[:, :, None] + tables[sort[part]]
            top = ready.max(axis=1, keepdims=True)
            new[part] = np.log(np.exp(ready - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        message = damping * message + (1 - damping) * new
    out = beliefs()
    out = np.exp(out - out.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def sample(docs: DataFrame, train_rows: int = TRAIN_ROWS, train_sites: int = TRAIN_SITES) -> list[np.ndarray]:
    """The first `train_sites` sites of at most `train_rows` different texts with any, those of the least hash.

    Hashes are chosen first, from a table of them alone: being even over their range, a part of it holds about twice the wanted number, however many there are. Then only the chosen texts are looked at.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    hashes = write_once(texts.select("h"), "hashes")
    reach = int(2.0**64 * min(1.0, 2.0 * train_rows / max(1, hashes.count()))) - (1 << 63) - 1
    chosen = hashes.where(F.col("h") <= reach).distinct().orderBy("h").limit(train_rows).agg(F.max("h").alias("last")).first().last
    forget(hashes)
    if chosen is None:
        return []

    def run(batches):
        for batch in batches:
            held = [sites(t, base_spans(t))[:train_sites].tobytes() for t in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(1), pa.array(held, pa.binary())], names=["h", "sites"])

    found = texts.where(F.col("h") <= chosen).mapInArrow(run, "h long, sites binary").groupBy("h").agg(F.min("sites").alias("sites"))
    return [np.frombuffer(r.sites, SITE) for r in sorted(found.collect(), key=lambda r: r.h)]


def _added(table: np.ndarray, chance: np.ndarray) -> list[tuple[int, int, int, float]]:
    """Spans of sites without a base span whose likeliest kind is sure enough; sites of one kind that follow each other are one span."""
    out: list[tuple[int, int, int, float]] = []
    best, last = chance.argmax(axis=1), -2
    for k in np.flatnonzero((table["label"] == 0) & (best > 0) & (chance.max(axis=1) >= THRESHOLD)):
        kind = int(best[k]) - 1
        if out and last == k - 1 and table["chained"][k] and out[-1][2] == kind:
            out[-1] = (out[-1][0], int(table["end"][k]), kind, min(out[-1][3], float(chance[k, kind + 1])))
        else:
            out.append((int(table["start"][k]), int(table["end"][k]), kind, float(chance[k, kind + 1])))
        last = k
    return out


def find_personal_data(docs: DataFrame, train_rows: int = TRAIN_ROWS, train_sites: int = TRAIN_SITES) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, base, score>>) of each row of docs(doc_id, text, ...), repeated rows included; spans by start, then kind; code points, end exclusive.

    Base spans, of score 1, are those of the patterns. The others are found by a field over the tokens that hold a digit or @ (others can't be part of a span): neighbours share potentials, and so do
    tokens of one document with the same letters and digits or the same last seven digits, however far apart. Base spans are evidence for the rest, so that a part of a number repeated
    elsewhere gets its label. The field is fitted on the base spans of at most `train_rows` different texts, those of the least hash, and `train_sites` tokens of each; all rows are searched, in one pass.

    Null and empty texts have no spans; very long texts are searched whole, each in one task; of texts of one hash one is learned from; an empty table gives no rows; other columns are ignored.
    """
    field = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, train_rows, train_sites)))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))

    def spans_of(texts: list[str | None]) -> list[list[dict]]:
        base = [base_spans(t) if t else [] for t in texts]
        tables = [sites(t, b) if t else np.empty(0, SITE) for t, b in zip(texts, base, strict=True)]
        out = [[(a, b, k, True, 1.0) for a, b, k in spans] for spans in base]
        at = [k for k, t in enumerate(tables) if (t["label"] == 0).any()]
        if at:
            sizes = [len(tables[k]) for k in at]
            chance = infer(np.concatenate([tables[k] for k in at]), np.repeat(np.arange(len(at)), sizes), field.value)
            for k, part in zip(at, np.split(chance, np.cumsum(sizes)[:-1]), strict=True):
                out[k] += [(a, b, kind, False, score) for a, b, kind, score in _added(tables[k], part)]
        return [[{"kind": KINDS[k], "start": a, "end": b, "base": own, "score": s} for a, b, k, own, s in sorted(spans, key=lambda x: (x[0], x[2], x[1]))] for spans in out]

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                yield pa.record_batch([batch.column(0)[a:b], pa.array(spans_of(texts[a:b]), kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean, score: double>>")
