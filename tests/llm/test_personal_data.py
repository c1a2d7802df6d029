"""Personal data: base patterns against plain regular expressions, message passing against enumeration, labels of repeated tokens."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from sparktide.llm import personal_data, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute_base(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), m.end(), order))
    return sorted(out, key=lambda s: (s[0], s[2]))


@pytest.mark.parametrize("alphabet", ["a1.@-", "0123456789 -.", "+1(2) .-5", "ab@.é+_ 7\n", "04 -"])
def test_base_patterns(alphabet):
    r = random.Random(alphabet)
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        assert personal_data.base_spans(text) == brute_base(text), text


def test_long_texts_take_linear_time():
    began = time.time()
    for text in ("a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "@" * 1_000_000, "a@" * 500_000, "+1" * 500_000, "+1 " + "(" * 1_000_000, "1 " * 500_000, "a@b." * 250_000):
        personal_data.sites(text, personal_data.base_spans(text)[:1000])
    assert time.time() - began < 90


def test_messages_on_a_tree():
    r, n = np.random.default_rng(4), len(personal_data.KINDS) + 1
    field = personal_data.Field()
    field.unary[:], field.chain[:], field.skip[:] = r.normal(size=(personal_data.BUCKETS, n)) / 3, r.normal(size=(n, n)), r.normal(size=(2, n))
    rows = np.zeros(4, personal_data.SITE)
    rows["slots"] = r.integers(0, personal_data.BUCKETS, (4, personal_data.SLOTS))
    rows["chained"], rows["same"], rows["label"] = [0, 1, 0, 0], [9, 8, 7, 9], [0, 0, 0, 4]  # 0 - 1 by place, 0 - 3 by token, 2 in the other row
    row = np.array([0, 0, 1, 0])
    rows, row = rows[[0, 1, 3, 2]], row[[0, 1, 3, 2]]
    got = personal_data.infer(rows, row, field, rounds=60)
    unary = field.unary[rows["slots"].astype(int)].sum(axis=1)
    want = np.zeros((4, n))
    for y in itertools.product(range(n), repeat=4):
        if y[2] != 4:
            continue
        score = sum(unary[k, y[k]] for k in (0, 1, 3)) + field.chain[0, y[0]] + field.chain[y[0], y[1]] + field.chain[y[1], 0] + field.chain[0, y[3]] + field.chain[y[3], 0]
        score += field.skip[0, y[0]] if y[0] == y[2] else 0
        for k in range(4):
            want[k, y[k]] += np.exp(score)
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-6)


def texts(seed=6):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abdeilnorst") for _ in range(r.randint(2, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    out = []
    for k in range(300):
        number = "".join(r.choice("0123456789") for _ in range(16))
        kinds = [f"+1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}", f"{word()}.{r.randint(10, 99)}@mail{r.randint(1, 9)}.example.com", ".".join(str(r.randint(1, 255)) for _ in range(4)), number, "version 2.0", "section 3."]
        held = r.choice(kinds)
        out.append(" ".join([some(5), held, some(4), r.choice([held, r.choice(kinds)]), some(3)]))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark, tmp_path):
    seen = "ring +1 (974) 555-3436 nor late, ask 555-3436 alone, then 2.0 or 3."
    rows = list(enumerate(texts())) + [(1000, seen), (None, None), (None, seen), (1001, ""), (1002, "no data here"), (1002, "no data here"), (1003, "é\U0001f600 x@y.zz")]
    table = spark.createDataFrame([(*x, "s", 1, "k") for x in rows], "doc_id long, text string, sites string, start long, kind string").repartition(3)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_personal_data(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    line = lambda spans: ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, b, k in spans)
    want = {}
    for i, text in rows:
        want.setdefault(i, []).append(sorted(brute_base(text), key=lambda s: (s[0], s[2])))
    for x in got:
        base = next(b for b in want[x.doc_id] if sha(line(b)) == x.base_sha256)
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == kind for _, _, k in base) for kind in range(4)]
        assert set(line(base).split(",")) <= set(x.spans.split(","))
    added = {x.doc_id: set(x.spans.split(",")) - set(line(next(b for b in want[x.doc_id] if sha(line(b)) == x.base_sha256)).split(",")) for x in got}
    assert f"phone:{seen.rindex('555')}:{seen.rindex('555') + 8}" in added[1000]  # a part of a number found elsewhere in the text
    assert not any(a for i, a in added.items() if i not in (1000, None) and not brute_base(dict(rows)[i]))  # nothing in texts without personal data
    again = queries.op11_personal_data(spark, str(tmp_path)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op11_personal_data(spark, str(tmp_path)).count() == 0
