import hashlib
import random
import re

from panelcast.llm import pii

SHAPE = "doc_id long, text string, start string, kind string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 16 <= len(digits) <= 19 and plain_luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def run(spark, rows, **limits):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SHAPE)
    names = pii.KINDS
    out = pii.find(df, **limits).collect()
    return sorted(((r["doc_id"], [(names[k], s, e) for k, s, e in r["base"]], [(names[k], s, e) for k, s, e in r["spans"]], (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"])) for r in out), key=str)


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(4)
    bits = ["a@b.c_d@e.f", "x@y", "x@@y.z", "é1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "000255.01.1.0", "1.2.3", "+1 (377) 555-0271", "+123", "+1  ", "++49 30 1234567.",
            "4539 1488 0343 6467", "4539-1488-0343-6467", "4539148803436467", "4539148803436468", "4539  1488", " - ", "-", "\n", "\U0001f600", "ü", "..", "a.b@c-d.e-f.", "1", "9", "@", "%", "+", "(", " "]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "\n", "."]) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    texts += ["", None, "12345678901234567890" * 3, "aaaa", "a@b.c" * 5, "+" + "1 " * 9]
    got = run(spark, enumerate(texts))
    assert len(got) == len(texts)
    for i, base, spans, counts in got:
        assert base == plain(texts[i]), texts[i]
        assert counts == tuple(sum(k == kind for k, _, _ in base) for kind in PLAIN)
        assert set(base) <= set(spans)


def test_very_long_runs_need_no_stack_and_linear_time(spark):
    texts = ["7 " * 300_000, "a" * 1_000_000 + "@", "1" * 1_000_000, "+1" + " " * 500_000, "1." * 300_000, "@" * 300_000, "a@b" + ".c" * 300_000, "x1" * 300_000]
    want = [[], [], [], [], [("ip", at, at + 7) for at in range(0, 600_000, 8)], [], [("email", 0, 600_003)], []]
    assert [g[1] for g in run(spark, enumerate(texts))] == want  # the plain patterns would take hours on some of them


def test_contexts_reveal_unseen_identifiers(spark):
    seeds = [(i, f"call us at phone number: +49 30 555{i:04d} thanks a lot {i}") for i in range(6)]
    hidden = [(50, "Please use phone number: 030-555-7777 thanks a lot."), (51, "write phone number: 12 thanks a lot")]
    second = [(60 + i, f"his secret hotline 030-555-77{i:02d} rings daily now") for i in range(4)] + [(70, "the number phone number: 030-555-7700 thanks a lot"),
              (71, "phone number: 030-555-7701 thanks a lot"), (72, "phone number: 030-555-7702 thanks a lot"), (73, "phone number: 030-555-7703 thanks a lot")]
    third = [(80, "your secret hotline 0171-999-1234 rings daily now")]
    clean = [(90 + i, f"order of the {i}000000{i} items and of the 77{i} rest") for i in range(5)] + [(99, "plain words only")]
    rows = seeds + hidden + second + third + clean
    text = dict(rows)
    added = {i: [text[i][s:e] for _, s, e in spans if (_, s, e) not in base] for i, base, spans, _ in run(spark, rows)}
    assert added[50] == ["030-555-7777"] and added[51] == []
    assert added[70] == ["030-555-7700"] and added[60] == ["030-555-7700"]  # accepted at 70, known wherever it occurs
    assert added[80] == ["0171-999-1234"]  # by a context learnt from values of the first round
    assert all(not added[i] for i, _ in clean + seeds)


def test_frequent_contexts_and_copies_reveal_nothing(spark):
    common = [(i, f"and of the +49 30 555{i:04d} or of the people") for i in range(6)] + [(20 + i, "some of the people or of the town") for i in range(30)]
    copies = [(100 + i, "my line is +49 30 1234567 always") for i in range(40)] + [(200, "my line is 030 7654321 always"), (201, "and of the 030 1112223 or of the")]
    assert all(base == spans for _, base, spans, _ in run(spark, common + copies))


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None), (None, "a@b.c"), (None, "a@b.c"), (2, "a@b.c"), (2, "x 1.2.3.4"), (2, "")]
    got = run(spark, rows)
    assert len(got) == 6 and sum(b == [("email", 0, 5)] for _, b, _, _ in got) == 3
    assert run(spark, []) == []


def test_query_over_a_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = pii.op13_pii(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(joined(base).split(",")) <= set(r["spans"].split(","))
