"""The text operators against brute force on small tables with nulls, empties, repeats and clashing extra columns."""

import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from sparktide.llm import bwt, components, conversations, decontaminate, language, licenses, pieces, quality, simhash, suffix_dedup, token_counts, token_files

# Extra columns whose names clash with those the operators use inside.
SCHEMA = "doc_id long, text string, th long, fp long, n_words long, start long, anchor string, lang string, label string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, "a", None, "x") for i, t in rows], SCHEMA).repartition(3)


def odd_texts(seed, alphabet, count=120):
    r = random.Random(seed)
    rows = [(None, None), (None, "a b c d e"), (1, ""), (2, " \n\t "), (3, "x"), (3, "x"), (4, "y " * 3000), (5, "é" * 5000)]
    return rows + [(10 + k, "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))) for k in range(count)]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(5, 5), (None, 3), (7, None)]
    parent = list(range(301))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: find(x) for x in range(301) if find(x) != x}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("dense", [None, 3])
def test_simhash(spark, dense):
    r, rows = random.Random(2), odd_texts(2, ["a ", "b ", "C "], 20)
    for k in range(8):
        base = [r.choice("one two three Four five six".split()) + str(r.randint(0, 9)) for _ in range(80)]
        for j in range(25):
            words = list(base)
            words[r.randrange(80)] = r.choice("uvw")
            rows.append((100 * (k + 1) + j, " ".join(words)))
    marks = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= 4:
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    want = Counter((i, m, low.get(find(k))) for k, ((i, _), m) in enumerate(zip(rows, marks, strict=True)))
    got = simhash.near_duplicates(documents(spark, rows), dense=dense).collect()
    assert Counter((x.doc_id, x.fp % (1 << 64), x.component_id) for x in got) == want
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_simhash_plan_adds_up():
    cost, thresholds = simhash.allocate([1e9, 10.0, 10.0], [20, 22, 22], 1e4, 4)
    assert sum(thresholds) == 4 - 3 + 1 and thresholds[0] == min(thresholds)
    groups = simhash.group_bits(np.eye(64), 5)
    assert sorted(b for g in groups for b in g) == list(range(64))


def test_licenses(spark):
    rows = odd_texts(3, ["mit ", "License ", "GNU ", "general ", "public ", "Apache", "-license ", "cc-", "BY ", "é", "1 "])
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = licenses.scan_licenses(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by_text = Counter((x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in got)
    want = Counter()
    for i, t in rows:
        words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        want[(i, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))] += 1
    assert by_text == want
    assert all(0 <= x.score <= 1 and set(x.base_labels.split(",")) - {""} <= set(x.labels.split(",")) for x in got)
    assert len(licenses.rules()) > 300
    n, base, found = licenses.scan("Licensed under the Apache License, Version 2.0")
    assert [d[2] for d in found] == ["apache-2.0"] and base == [(3, 5, "apache")]
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


def all_rules(text):
    """scan() with every rule run, whatever words the text has."""
    words = licenses._WORD.findall(text.encode().lower())
    joined = b" " + b" ".join(words) + b" "
    found = {(joined.count(b" ", 0, m.start()) - 1, joined.count(b" ", 0, m.end()), r.label, r.name, r.priority) for r in licenses.rules() for m in r.pattern.finditer(joined)}
    taken = []
    for d in sorted(found, key=lambda d: (-d[4], d[0] - d[1], d[0], d[2], d[3])):
        if not any(t[0] <= d[0] and d[1] <= t[1] for t in taken):
            taken.append(d)
    return sorted(taken)


def test_license_containment():
    found = licenses.scan("licensed under the MIT License Version and the Apache License, Version 2.0 all rights reserved")[2]
    assert {"mit", "apache-2.0", "proprietary"} <= {d[2] for d in found}
    inner = [(0, 9, "a", "1", 90), (2, 5, "b", "2", 80), (7, 12, "c", "3", 70), (0, 9, "d", "4", 60), (11, 12, "e", "5", 95)]
    assert [d[2] for d in sorted(licenses._standing(inner, 12))] == ["a", "c", "e"]  # c overlaps a and holds e, which ranks above it
    assert len(licenses.SENTENCES) > 150 and all(licenses.rules()[k].priority >= licenses.rules()[k + 1].priority for k in range(len(licenses.rules()) - 1))


def test_license_keywords_within_words():
    texts = {
        "Licensed under GPLv3 or later": "gpl-3", "GNU LGPLv2.1": "lgpl-2.1", "AGPLv3 only": "agpl-3", "under MPLv2": "mpl-2.0", "EPLv2": "epl-2.0", "licensed under Apache2": "apache-2.0",
        "CreativeML OpenRAIL-M": "rail", "an OpenRAIL license": "rail", "Beerware License": "beerware", "FreeBSD License": "bsd-2-clause", "CDDLv1.1": "cddl-1.1", "EUPLv1.2": "eupl-1.2",
        "noncommercial use only": "non-commercial", "GPL 3": "gpl-3",
    }
    for text, label in texts.items():
        found = licenses.scan(text)[2]
        assert found == all_rules(text) and label in {d[2] for d in found}, text
    r = random.Random(31)
    names = " ".join(texts).split() + [p for f in licenses.FAMILIES for p in re.sub(r"[^a-z0-9 ]", "", f[2]).split()]
    for _ in range(300):
        text = " ".join(r.choice(names) for _ in range(r.randint(1, 12)))
        assert licenses.scan(text)[2] == all_rules(text), text


def brute_statistics(i, text):
    text = text or ""
    words = WORDS.findall(text)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    times, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if times[g] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics_and_rules(spark):
    rows = odd_texts(4, ["a ", "b ", "cé ", "\n", "日🤗", "#", "|", " ", "\r\n", "\x0b"])
    stats = quality.statistics(documents(spark, rows))
    got = Counter(tuple(x) for x in stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == Counter(brute_statistics(*x) for x in rows)
    r = random.Random(5)
    bad = lambda k: k % 3 == 0
    docs = [(k, " ".join(f"w{r.randint(0, 10**6)}" + ("##" if bad(k) else "") for _ in range(60))) for k in range(300)]
    labels = spark.createDataFrame([(k, 0 if bad(k) else 1, 0) for k in range(200)] + [(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    judged = {x.doc_id: x.kept for x in quality.judge(documents(spark, docs), labels).collect()}
    assert all(judged[k] for k in range(300) if not bad(k))
    assert sum(judged[k] for k in range(300) if bad(k)) <= 2
    assert quality.judge(documents(spark, []), labels.limit(0)).count() == 0


@pytest.mark.parametrize("alphabet", [["a", "th", " ", "  ", "\n", "'s", ".,", "é", "日", "🤗", "12", "<|endoftext|>", "\x1c", "▁", "<s>", "\x00"]])
def test_tokens(spark, alphabet):
    import sentencepiece
    from tokenizers import Tokenizer

    rows = odd_texts(6, alphabet)
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = documents(spark, rows)
    got = Counter((x.doc_id, bytes(x.ids), x.decoded) for x in pieces.encode_decode(docs, path).collect())
    coded = [(i, library.encode(t or "", add_bos=True, add_eos=True)) for i, t in rows]
    assert got == Counter((i, np.array(e, "<u4").tobytes(), library.decode(e)) for i, e in coded)
    counts = Counter(tuple(x) for x in token_counts.token_counts(docs, path, size=20).collect())
    assert counts == Counter((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, start, want = Tokenizer.from_file(path), 0, []
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.token_files(spark, docs, path).collect()), key=lambda x: x[1]) == want
    empty = documents(spark, [])
    assert token_files.token_files(spark, empty, path).count() == 0


def test_merged_transforms():
    for seed in range(60):
        r = random.Random(seed)
        length, alphabet = r.choice([1, 2, 4, 8]), r.choice([b"ab", b"abcd"])
        strings = [bytes(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 9))]
        times = np.array([r.choice([1, 1, 2]) for _ in strings])
        count = Counter()
        for s, n in zip(strings, times, strict=True):
            for k in range(len(s) - length + 1):
                count[s[k : k + length]] += int(n)
        bytes_as_symbols = lambda data, valid, gram: np.where(valid, data.astype(np.int64) + 1, 0)
        keep, bwt.gram_symbols = bwt.gram_symbols, bytes_as_symbols
        try:
            got = bwt.repeated_starts(strings, times, length, r.randint(1, 4), 1)
        finally:
            bwt.gram_symbols = keep
        assert [x.tolist() for x in got] == [[k for k in range(len(s) - length + 1) if count[s[k : k + length]] > 1] for s in strings]


@pytest.mark.parametrize("hot", [2000, 2])
def test_suffix_dedup(spark, hot):
    r = random.Random(8)
    words = ["".join(r.choice("abcé") for _ in range(r.randint(2, 7))) for _ in range(60)]
    bases = [" ".join(r.choice(words) for _ in range(r.randint(60, 300))) for _ in range(12)]
    rows = [(None, None), (1, ""), (2, "a" * 1500), (3, "ab" * 900), (3, "ab" * 900), (None, "xyz" * 300)]
    for k in range(80):
        text = r.choice(bases)[r.randint(0, 200) :]
        at = r.randint(0, len(text))
        rows.append((10 + k, text[:at] + (r.choice(words) if k % 2 else "") + text[at:] + r.choice(bases)[: r.randint(0, 300)]))
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[k : k + 400] for k in range(len(b) - 399))
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if count[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum())
        want[(i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    assert Counter(map(tuple, suffix_dedup.removal_report(documents(spark, rows), hot_strings=hot).collect())) == want
    assert suffix_dedup.removal_report(documents(spark, [])).count() == 0


def brute_containment(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    out = set()
    for j, q in items:
        w = word.findall((q or "").lower())
        n = min(5, len(w))
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        for i, t in rows:
            v = word.findall((t or "").lower())
            shared = own & {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            if own and j is not None and len(shared) >= 0.8 * len(own):
                out.add((i, j, len(shared), len(own)))
    return out


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_decontamination(spark, broadcast):
    r = random.Random(9)
    items = [(k, " ".join(r.choice("one two three four five six seven".split()) for _ in range(n))) for k, n in enumerate([1, 3, 4, 5, 6, 12, 20, 33, 60])]
    items += [(None, "one two"), (90, None), (91, ""), (92, "... !")]
    rows = odd_texts(9, ["one ", "two ", "Three, ", "four "], 30)
    for k in range(60):
        words = r.choice(items[:9])[1].split()
        if r.random() < 0.5:
            words[r.randrange(len(words))] = "changed"
        rows.append((500 + k, "x y z. " + " ".join(words) + "! " + "tail " * 50))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, h long")
    got = decontaminate.contained_items(documents(spark, rows), bench, broadcast_rows=broadcast).collect()
    want = brute_containment([x for x in rows if x[0] is not None], items)
    assert {(x.doc_id, x.item_id, x.n_shared, x.n_item) for x in got if x.doc_id is not None} == want
    assert decontaminate.contained_items(documents(spark, []), bench).count() == 0
    assert decontaminate.contained_items(documents(spark, rows), bench.limit(0)).count() == 0


def test_conversations(spark):
    rows = [
        (1, 0, "user", "Hello there.\n\nHow are you?"), (1, 1, "assistant", "> how  are YOU?\nFine."), (1, 2, "user", ">> How are you?\n> Fine.\nGood."),
        (1, 3, "user", "> nobody said this\nOdd."), (1, 4, "user", None), (2, 0, "user", "> Fine.\nnot here"), (None, 1, "user", "> x"), (2, None, "user", ""), (1, 4, "user", None),
    ]
    df = spark.createDataFrame([(*x, 7) for x in rows], "conv_id long, turn long, role string, text string, level long")
    got = Counter((x.conv_id, x.turn, x.text, x.parent_turn, x.root_turn, x.n_quoted) for x in conversations.link_quotations(df).collect())
    assert got == Counter([
        (1, 0, "Hello there.\n\nHow are you?", None, 0, 0), (1, 1, "Fine.", 0, 0, 1), (1, 2, "Good.", 1, 0, 2), (1, 3, "Odd.", None, 3, 1),
        (1, 4, "", None, 4, 0), (2, 0, "not here", None, 0, 1), (None, 1, "", None, 1, 1), (2, None, "", None, None, 0), (1, 4, "", None, 4, 0),
    ])
    assert conversations.link_quotations(df.limit(0)).count() == 0


@pytest.mark.parametrize("width", [65_536, 2])
def test_conversations_against_sql(spark, tmp_path, monkeypatch, width):
    """Excerpts of whole lines, re-wrapped paragraphs and nested quotes, linked as the query's SQL and a brute-force search do."""
    import duckdb

    from sparktide.llm import queries

    monkeypatch.setattr(conversations, "WIDTH", width)
    r, rows, own = random.Random(17), [], {}
    for conv in range(12):
        texts = []
        for turn in range(9):
            lines, level = [], r.randint(0, 2)
            if texts and r.random() < 0.8:
                source = r.choice(texts).split("\n")
                a = r.randrange(len(source))
                lines += ["> " * (level + 1) + x.upper() for x in source[a : a + r.randint(1, 4)]]
            mine = [" ".join(r.choice("alpha beta gamma delta".split()) for _ in range(r.randint(1, 3))) if r.random() < 0.8 else "" for _ in range(r.randint(1, 6))]
            texts.append("\n".join(mine))
            rows.append((conv, turn, "user", "\n".join(lines + mine), 1))
    rows += [(1, 3, "user", "> alpha", 1), (None, 0, "user", "> x", 1), (0, None, None, None, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, hash long")
    got = conversations.link_quotations(df).collect()
    df.toPandas().to_parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    names = ["conv_id", "turn", "role", "text", "parent_turn", "root_turn", "n_quoted"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL['op5_conversations']})").fetchall()
    assert Counter(tuple(x[n] for n in names) for x in got) == Counter(want)
    clean = lambda t: [" ".join(x.lower().split()) for x in t.split("\n") if x.strip()]
    linked = {(x.conv_id, x.turn): x.parent_turn for x in got}
    for conv, turn, _, text, _ in rows[:108]:
        quoted = [re.sub(r"^(> )+", "", x) for x in (text or "").split("\n") if x.startswith(">")]
        if (conv, turn) != (1, 3) and clean("\n".join(quoted)):
            q = clean("\n".join(quoted))
            earlier = [(t, clean("\n".join(x for x in s.split("\n") if not x.startswith(">")))) for c, t, _, s, _ in rows[:108] if c == conv and t < turn]
            assert linked[(conv, turn)] == max(t for t, ls in earlier if any(ls[k : k + len(q)] == q for k in range(len(ls))))


def test_long_texts(spark):
    """Texts of about 1 MB with and without spaces, in all operators whose work could grow faster than a text."""
    import sentencepiece

    r = random.Random(23)
    letters = "".join(r.choice("etaoinshrdlu") for _ in range(1_000_000))
    words = " ".join(f"mit license {r.randint(0, 99999)}" for _ in range(50_000))
    rows = [(1, letters), (2, words), (3, "ab" * 500_000)]
    docs, path = documents(spark, rows), public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = {i: np.array(library.encode(t, add_bos=True, add_eos=True), "<u4").tobytes() for i, t in rows}
    got = {x.doc_id: bytes(x.ids) for x in pieces.encode_decode(docs, path).collect()}
    assert got == want
    assert {x.doc_id: x.n_tokens for x in token_counts.token_counts(docs, path).collect()} == {i: len(x) // 4 - 2 for i, x in want.items()}
    scanned = {x.doc_id: (x.n_words, x.n_base) for x in licenses.scan_licenses(docs).select("doc_id", "n_words", "n_base").collect()}
    assert scanned == {1: (1, 0), 2: (150_000, 50_000), 3: (1, 0)}
    removed = {x.doc_id: x.n_removed for x in suffix_dedup.removal_report(docs).collect()}
    assert removed == {1: 0, 2: 0, 3: 1_000_000}
    assert len({x.component_id for x in simhash.near_duplicates(docs).collect()}) == 3
    assert all(x.n_tokens > 100_000 for x in token_files.token_files(spark, docs, public_tokenizers.path("byte_bpe_50k.json")).collect())


def test_piece_merges(spark):
    """Segments merged at once and one by one, against the library, also where a merge makes a pair of smaller rank."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, r = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(29)
    for alphabet in (["a"], ["an", "na", "ana", "nan"], list("etaoinshrdlu"), ["=", "-", "=="], ["é", "日", "本", "a"]):
        texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 200))) for _ in range(60)]
        want = [np.array(library.encode(t), "<u4").tobytes() for t in texts]
        keep = pieces.LONG
        for pieces.LONG in (keep, 4):
            pieces.load.cache_clear()
            assert pieces.encode_texts(path, texts) == want
        pieces.LONG = keep


def test_worker_memory(monkeypatch):
    """What a worker holds of a task's chunk of strings and of its words stays small beside an executor's heap, and dropped words don't change ids."""
    import sentencepiece

    path, r = public_tokenizers.path("piece_bpe_32k.model"), random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(r.choices(letters, k=6)) for _ in range(500)) for _ in range(600)]
    pieces.load.cache_clear()
    model, seen = pieces.load(path)

    def peak(body):
        tracemalloc.start()
        try:
            body()
            return tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    assert peak(lambda: [len(pieces.encode_texts(path, texts[a:b])) for a, b in pieces.slices(texts)]) < 50
    for length, unit in ((400, "u1"), (51, "<u8")):
        strings = [np.random.default_rng(k // 2).integers(0, 250, 800).astype(unit).tobytes() for k in range(suffix_dedup.CHUNK // 800)]
        assert peak(lambda: bwt.repeated_starts(strings, np.ones(len(strings), int), length, gram=bwt.gram_size(length), unit=unit)) < 40  # noqa: B023
    assert [len(x) for x in simhash.slices(pa.record_batch([pa.array(range(2500))], names=["x"]))] == [1000, 1000, 500]
    monkeypatch.setattr(pieces, "CACHE_WORDS", 700)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    seen.clear()
    for k in (0, 1, 0, 2):  # the second and later texts find some of their words, and more than the cache takes
        text = " ".join([texts[k], texts[k + 1][:700]])
        assert pieces.encode_texts(path, [text, None]) == [np.array(library.encode(text), "<u4").tobytes(), b""]
    assert len(seen) <= 700


def test_language(spark):
    r = random.Random(10)
    words = {"en": "the of and thing house".split(), "de": "der und ist straße haus".split(), "fr": "le été où maison très".split()}
    text = lambda lang, n=40: " ".join(r.choice(words[lang]) for _ in range(n))
    rows = [(k, text(lang), lang) for k in range(150) for lang in [r.choice(list(words))]] + [(None, None, "en"), (900, "", None), (901, "12 .", "de"), (902, text("de"), None)]
    docs = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, lang string, score double").repartition(3)
    got = {x.doc_id: x for x in language.train_and_identify(docs).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:150]) and got[902].lang_pred == "de"
    assert {got[None].lang_pred, got[900].lang_pred, got[901].lang_pred} == {"und"}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(150))
    both = text("en", 80) + " " + text("fr", 60)
    found = language.identify(spark.createDataFrame([(1, both)], "doc_id long, text string"), language.train(docs)).first()
    assert found.lang_pred == "en" and set(found.languages) == {"en", "fr"}
    assert language.train_and_identify(docs.limit(0)).count() == 0
    long_text = text("de", 250_000)
    assert language.identify(spark.createDataFrame([(1, long_text)], "doc_id long, text string"), language.train(docs)).first().lang_pred == "de"


def test_many_languages(spark, monkeypatch):
    """More languages than any block holds: the same answers as by one block, and as by brute force over all."""
    r = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k}": ["".join(r.choice(letters) for _ in range(5)) for _ in range(4)] for k in range(1500)}
    rows = [(k, " ".join(r.choice(w) for _ in range(12)), lang) for k, (lang, w) in enumerate(words.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    whole = {x.doc_id: tuple(x) for x in language.identify(docs, language.train(docs)).collect()}
    assert all(whole[k][1] == lang for k, _, lang in rows)
    monkeypatch.setattr(language, "BLOCK_COUNTS", 10_000)
    model = language.train(docs)
    assert model.blocks > 3
    assert {x.doc_id: tuple(x) for x in language.identify(docs, model).collect()} == whole
    blocks = [language.load(model, k) for k in range(model.blocks)]
    at, n = language.trigrams(rows[7][1])
    fits = {}
    for block in blocks:
        for k, name in enumerate(block.names):
            own = dict(zip(np.repeat(np.arange(language.BUCKETS), np.diff(block.start))[block.language == k].tolist(), block.chance[block.language == k].tolist(), strict=True))
            fits[name] = sum(c * np.log(own.get(b, block.unseen[k])) for b, c in zip(at.tolist(), n.tolist(), strict=True))
    found = [(fit, name) for block in blocks for name, fit in zip(*block.contenders(at, n.astype(float))[:2], strict=True)]
    assert sorted((f for f, _ in found), reverse=True)[:16] == pytest.approx(sorted(fits.values(), reverse=True)[:16]) and max(found)[1] == "l7"


def test_no_language_is_left_out(spark, monkeypatch):
    """Shares over all of 60 near-equal languages, and a set of more than 16, as by brute force: laid out, from entries, held or a block at a time."""
    r = random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyz"
    common = ["".join(r.choice(letters) for _ in range(5)) for _ in range(30)]
    own = ["".join(r.choice(letters) for _ in range(6)) for _ in range(60)]
    rows = [(k, " ".join(common * 3 + [own[k]] * r.randint(150, 250)), f"l{k:02}") for k in range(60)]
    asked = [(100, " ".join(common)), (101, " ".join(own[10:30] * 40)), (102, own[7] + " " + own[59] * 3), (103, "1"), (104, None)]
    docs, ask = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(asked, "doc_id long, text string")
    table = np.zeros((60, language.BUCKETS))
    for k, text, _ in rows:
        at, n = language.trigrams(text)
        table[k, at] += n
    table = (table + language.SMOOTHING) / (table.sum(axis=1, keepdims=True) + language.SMOOTHING * language.BUCKETS)
    want = {}
    for i, text in asked[:3]:
        at, n = language.trigrams(text)
        shares = np.full(60, 1 / 60)
        for _ in range(language.ROUNDS):
            shares = shares * (table[:, at] @ (n / (shares @ table[:, at]))) / n.sum()
        want[i] = shares
    for counts, held, laid_out in ((1 << 21, 1 << 22, 32), (1 << 21, 1 << 22, 64), (1 << 21, 100, 32), (500, 1 << 22, 32), (500, 100, 32)):
        monkeypatch.setattr(language, "BLOCK_COUNTS", counts)
        model = language.train(docs)
        assert (model.blocks > 2) == (counts == 500)
        monkeypatch.setattr(language, "HELD", held)
        monkeypatch.setattr(language, "LAID_OUT", laid_out)
        languages = language.Languages([language.load(model, k) for k in range(model.blocks)])
        for i, text in asked[:3]:
            at, n = language.trigrams(text)
            shares, chosen = language.mixture(languages, at, n.astype(float))
            assert shares == pytest.approx(want[i], rel=1e-9)
            assert i != 101 or {languages.names[k] for k in chosen} == {f"l{k:02}" for k in range(10, 30)}
        monkeypatch.undo()
        monkeypatch.setattr(language, "BLOCK_COUNTS", counts)
        got = {x.doc_id: x for x in language.identify(ask, language.train(docs)).collect()}
        assert all(got[i].score == pytest.approx(want[i][int(got[i].lang_pred[1:])], rel=1e-9) for i in (100, 101, 102))
        assert len(got[101].languages) == 20 and got[103].lang_pred == got[104].lang_pred == "und"


def test_simhash_of_nothing_is_quick(spark):
    plan = simhash.plan_partitions(spark.createDataFrame([], "fp long"), 4)
    assert sum(len(list(itertools.combinations(bits, k))) for _, t, bits in plan for k in range(t + 1)) < 500


def test_texts_of_a_megabyte(spark):
    """Operators on one very long text, whole."""
    r = random.Random(12)
    words = [f"w{r.randint(0, 5000)}" for _ in range(170_000)]
    text = " ".join(words)
    assert len(text) > 900_000
    docs = spark.createDataFrame([(1, text), (2, "w1 w2 w3")], "doc_id long, text string")
    got = {x.doc_id: x for x in quality.statistics(docs).collect()}
    assert (got[1].n_words, got[1].word_chars, got[1].n_repeat_words) == brute_statistics(1, text)[1:3] + (brute_statistics(1, text)[5],)
    item = " ".join(words[90_000:90_040])
    found = decontaminate.contained_items(docs, spark.createDataFrame([(7, item), (8, "w1 w2 w3"), (9, "no such item at all here")], "item_id long, text string")).collect()
    assert (1, 7, 36, 36) in {tuple(x)[:4] for x in found} and (2, 8) in {tuple(x)[:2] for x in found}
    lines = "\n".join(" ".join(words[k : k + 8]) for k in range(0, 160_000, 8))
    quote = "\n".join("> " + x for x in lines.split("\n")[5_000:5_003])
    linked = {x.turn: x for x in conversations.link_quotations(spark.createDataFrame([(1, 0, "a", lines), (1, 1, "b", quote + "\nyes"), (1, 2, "a", "> never said\nno")], "conv_id long, turn long, role string, text string")).collect()}
    assert linked[1].parent_turn == 0 and linked[1].text == "yes" and linked[2].parent_turn is None and linked[0].text == lines
    assert licenses.scan(text + " Licensed under the Apache License, Version 2.0")[2][-1][2] == "apache-2.0"


def test_short_texts_are_not_probed(spark):
    """Items of all sizes in texts that hold just enough of them, or just too little."""
    r = random.Random(13)
    items, docs = [], []
    for k in range(120):
        words = [f"i{k}x{j}" for j in range(r.randint(1, 60))]
        items.append((k, " ".join(words)))
        n = max(1, len(words) - 4)
        for short in (0, 1):  # as few shingles in a row as 0.8 of them needs, and one less
            docs.append((2 * k + short, " ".join(words[: -(-8 * n // 10) - short + len(words) - n])))
    got = {tuple(x)[:2] for x in decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for i, text in docs:
        w, item = text.split(), items[i // 2][1].split()
        size = min(5, len(item))
        own = {tuple(item[j : j + size]) for j in range(len(item) - size + 1)}
        if len(own & {tuple(w[j : j + size]) for j in range(len(w) - size + 1)}) >= 0.8 * len(own) - 1e-9:
            want.add((i, i // 2))
    assert got == want
