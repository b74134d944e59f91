import random
import re

import numpy as np

from panelcast.llm.passages import band_keys, remove_passages, repeated_passages, shared_blocks

WORD = re.compile("[^\x20\x09-\x0d]+")


def common_runs(rows, size):
    """Exact windows of ``size`` words that an earlier document has: document -> word positions."""
    first, out = {}, {}
    for i, t in sorted(rows):
        w = [x.lower() for x in WORD.findall(t or "")]
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if first.setdefault(key, i) < i:
                out.setdefault(i, set()).update(range(k, k + size))
    return out


def made(seed=6):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [fresh(rng.randrange(50, 130)) for _ in range(8)]
    rows = []
    for i in range(120):
        words = fresh(rng.randrange(0, 90))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words += [*rng.choice(passages), *fresh(rng.randrange(1, 90))]
        rows.append((i * 3, "".join(w + rng.choice([" ", "\n", "  "]) for w in words)))
    return rows, passages


def test_exact_passages_are_found_whole_and_nothing_else(spark):
    rows, passages = made()
    rows += [(1000, None), (1001, ""), (1002, "For " * 20000), (1003, "é For " + "For " * 30000), (1004, " ".join(passages[0][:49]))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, other string").repartition(4)
    found = repeated_passages(df)
    got = {}
    texts = dict(rows)
    for r in found.collect():
        spans = [m.span() for m in WORD.finditer(texts[r.doc_id])]
        inside = [k for k, (a, b) in enumerate(spans) if r.start <= a < r.end]
        assert len(inside) == r.n_words >= 50 and r.kept_id < r.doc_id and r.component_id <= r.kept_id
        got.setdefault(r.doc_id, set()).update(inside)
    want = common_runs([r for r in rows if r[0] != 1003], 50)
    assert {k: v for k, v in got.items() if k != 1003} == want
    assert 1003 in got
    left = {r.doc_id: r for r in remove_passages(df, found).collect()}
    assert len(left) == len(rows) and left[1000].text is None and left[0].other == "x"
    assert common_runs([(i, r.text) for i, r in left.items() if i != 1003], 60) == {}
    for i, t in rows:
        if i not in got:
            assert left[i].text == t


def test_near_passages_and_blocks(spark):
    rng = random.Random(7)
    base = [f"p{k}" for k in range(120)]
    near = list(base)
    near[40], near[80] = "x", "y"
    fill = [f"f{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(1, " ".join(fill[:60] + base + fill[60:90])), (2, " ".join(fill[100:130] + near + fill[130:200])), (3, " ".join(fill[200:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeated_passages(df).collect()
    assert [(r.doc_id, r.n_words, r.kept_id) for r in got] == [(2, 120, 1)]
    x = np.arange(100, dtype=np.uint64)
    assert shared_blocks(x, x + np.uint64(1000), [(3, 3)], 10) == []
    assert repeated_passages(df.limit(0)).count() == 0


def test_exact_passages_past_a_holder_of_a_part(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], set()
    for n in (50, 55, 60, 70):
        for _ in range(10):
            whole, i = fresh(n), len(rows)
            part, edited = whole[(n - 45) // 2 :][:45], list(whole)
            edited[n // 3], edited[2 * n // 3] = "x", "y"
            for held in (part, edited, whole, whole):
                rows.append((len(rows), " ".join(fresh(80) + held + fresh(60))))
            want.add((i + 3, i + 2, n))
    # A key that comes again within a paragraph, and text with a period: the common part is far from the first place.
    phrase, tail = fresh(10), fresh(50)
    listed = [w for _ in range(8) for w in [*phrase, *fresh(15)]]
    i = len(rows)
    rows += [(i, " ".join(listed[:40] + fresh(70))), (i + 1, " ".join(fresh(40) + listed)), (i + 2, " ".join(fresh(9) + listed))]
    rows += [(i + 3, "tick tock " * 300 + " ".join(tail)), (i + 4, "one tick tock tock " + "tick tock " * 400 + " ".join(fresh(60) + tail))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = repeated_passages(df).collect()
    got = {}
    for r in found:
        spans = [m.span() for m in WORD.finditer(rows[r.doc_id][1])]
        got.setdefault(r.doc_id, set()).update(k for k, (a, b) in enumerate(spans) if r.start <= a < r.end)
    for k, places in common_runs(rows, 50).items():
        assert places <= got.get(k, set()), (k, sorted(places - got.get(k, set())))
    assert want <= {(r.doc_id, r.kept_id, r.n_words) for r in found}


def test_recall_of_short_passages_with_an_edit():
    rng = np.random.default_rng(9)
    fresh = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    for n in (50, 55, 60):
        for added in (0, 1):
            met = 0
            for _ in range(300):
                base = fresh(n)
                near = np.r_[base[: n // 2], fresh(1), base[n // 2 + 1 - added :]]
                x, y = np.r_[fresh(90), near, fresh(80)], np.r_[fresh(120), base, fresh(50)]
                (key, at, _), (other, other_at, _) = band_keys(x, 50), band_keys(y, 50)
                place = dict(zip(other.tolist(), other_at.tolist(), strict=True))
                hits = [(i, place[k]) for k, i in zip(key.tolist(), at.tolist(), strict=True) if k in place]
                met += shared_blocks(x, y, hits, 50) == [(90, 90 + n + added, 120, 120 + n)]
            assert met > 0.99 * 300, (n, added, met)


def test_blocks_reach_over_gaps_from_one_hit():
    x = np.arange(1000, 1200, dtype=np.uint64)
    y = np.r_[x[:30], np.uint64(1), x[31:70], x[72:100], np.arange(110, dtype=np.uint64)]
    for hit in ((3, 3), (40, 40), (90, 88)):
        assert shared_blocks(x, y, [hit], 50) == [(0, 100, 0, 98)]
    # Far pieces make the whole chain unlike: its longest similar part counts.
    parts = np.r_[x[:60], np.arange(5, dtype=np.uint64), x[65:70], np.arange(6, dtype=np.uint64), x[76:81]]
    assert shared_blocks(x, parts, [(0, 0)], 50) == shared_blocks(x, parts, [(66, 66)], 50) == [(0, 60, 0, 60)]
    tick = np.tile(np.arange(3, dtype=np.uint64), 2000)
    assert shared_blocks(tick, tick[:3000], [(0, 0), (5998, 1)], 50)


def test_edited_passages_past_a_holder_of_a_part(spark):
    rng = random.Random(10)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], {}
    for n in (50, 55, 60, 80):
        for _ in range(75):
            whole, i = fresh(n), len(rows)
            edited = list(whole)
            edited[n // 2] = "x"
            for held in (whole[5 : n - 5], whole, edited):
                rows.append((len(rows), " ".join(fresh(60) + held + fresh(40))))
            want[(i + 2, i + 1)] = n
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # Of 60 words the part has 50, which count as found themselves; of shorter ones only the whole passage does.
    gone = {}
    for r in repeated_passages(df).collect():
        spans = [m.span() for m in WORD.finditer(rows[r.doc_id][1])]
        gone.setdefault(r.doc_id, set()).update(k for k, (a, b) in enumerate(spans) if r.start <= a < r.end)
    for n in (50, 55, 60, 80):
        own = [i for (i, _), size in want.items() if size == n]
        edge = 5 if n >= 60 else 0
        met = sum(set(range(60 + edge, 60 + n - edge)) <= gone.get(i, set()) for i in own)
        assert met >= 0.98 * len(own), (n, met)
