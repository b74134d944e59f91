import random
import re
from collections import defaultdict

import pytest

from panelcast.llm.components import connected_components
from panelcast.llm.minhash import near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(texts, size, percent=80):
    """Component of each document from all pairs that share a shingle."""
    sets = {}
    for i, t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    done = set()
    for ids in holders.values():
        for p, a in enumerate(ids):
            for b in ids[:p]:
                if (b, a) not in done:
                    done.add((b, a))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("size", [4, 5])
def test_matches_brute_force(spark, size):
    rng = random.Random(size)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 20, 60, 200]))]
        chain = base
        for k in range(25):
            chain = edited(rng, chain, max(1, len(base) // 60))
            texts.append(" ".join(chain if k % 2 else edited(rng, base, k * len(base) // 400)))
    texts += ["", None, "  \n", "One Two", "one two", "one two three", texts[0], texts[0].upper(), "long " * 60_000]
    rng.shuffle(texts)
    rows = [(i * 7, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, key string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, size=size).collect()}
    assert got == brute(rows, size)


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e")], "doc_id long, text string")
    got = near_duplicates(df).collect()
    assert [(r.doc_id, r.component_id) for r in got] == [(5, 5), (5, 5)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(1049, 2000), (7, 7), (None, 3), (2000, 1049)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys([*range(1000, 1050), 2000], 1000)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_block_comparison_allows_for_shared_hash_bits():
    import numpy as np
    import pyarrow as pa

    from panelcast.llm.minhash import BANDS, block_pairs

    def side(first, count, size, values):
        keys = [np.arange(BANDS, dtype=np.uint32).tobytes()] * count
        sets = [np.repeat(values + 1000 * k, 2).astype(np.uint32).tobytes() for k in range(count)]
        ids = list(range(first, first + count))
        return pa.table({"id": ids, "n": [size] * count, "band": [0] * count, "c": ids, "main": [-1] * count, "keys": keys, "set": sets})

    for count in (2, 6):  # compared one by one, and as a matrix
        got = block_pairs(side(0, count, 100, np.arange(50)), side(100, count, 100, np.arange(50)), 80)
        assert got.tolist() == [[k, k] for k in range(count)]
        assert not len(block_pairs(side(0, count, 50, np.arange(50)), side(100, count, 50, np.arange(50) + 25), 80))
