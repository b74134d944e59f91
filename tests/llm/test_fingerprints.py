import hashlib
import random
import re
from collections import Counter

import numpy as np

from panelcast.llm.fingerprints import SAMPLES, fingerprints


def weights(text):
    return Counter(w for w in re.split("[\x20\x09-\x0d]+", text) if w)


def jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def edited(rows):
    out = {}
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        out[i] = t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]
    return out


def test_against_exact_similarity(spark):
    rng = random.Random(5)
    pool = [f"w{k}" for k in range(40)] + ["é", "漢字", "🤖"]
    rows = [(3 * i - 50, " ".join(rng.choices(pool, weights=range(1, 44), k=rng.randrange(1, 120)))) for i in range(400)]
    rows += [(-9000, ""), (-8999, "\n \t"), (10_000_000, rows[5][1]), (10_000_001, "one"), (10_000_002, "big " * 200_000)]
    df = spark.createDataFrame([*[(*r, 1, "x") for r in rows], (None, "lost", 1, "x")], "doc_id long, text string, id int, part string").repartition(4)
    got = {r.doc_id: r for r in fingerprints(df).collect()}
    rows.sort(key=lambda r: -r[0])
    changed, texts = edited(rows), dict(rows)
    assert set(got) == set(texts)
    errors = []
    for k, (i, t) in enumerate(rows):
        r, follower = got[i], rows[(k + 1) % len(rows)][0]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed[i].encode()).hexdigest()
        assert len(r.fingerprint) == (6 * SAMPLES if weights(t) else 0)
        for value, other in ((r.near_edited, changed[i]), (r.near_next, texts[follower])):
            a, b = weights(t), weights(other)
            want = jaccard(a, b) if a or b else 1.0
            errors.append(value - want)
        assert (r.near_next == 1) == (r.fingerprint == got[follower].fingerprint)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 1.3 * 0.5 / SAMPLES**0.5
    assert got[10_000_000].fingerprint == got[3 * 5 - 50].fingerprint


def test_small_tables(spark):
    df = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (7, None)], "doc_id long, text string")
    got = fingerprints(df).collect()
    assert len(got) == 3 and len({r.fingerprint for r in got if r.doc_id == 5}) == 1
    one = fingerprints(df.where("doc_id = 7")).collect()
    assert one[0].near_edited == one[0].near_next == 1.0 and one[0].fingerprint == ""
    assert fingerprints(df.limit(0)).count() == 0
    far = spark.createDataFrame([(-9 * 10**18, "a b"), (9 * 10**18, "c d e f")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints(far).collect()}
    assert {i: r.edited_sha256 for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in edited([(9 * 10**18, "c d e f"), (-9 * 10**18, "a b")]).items()}
