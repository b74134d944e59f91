import re
from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_minhash import brute as brute_near
from tests.llm.test_passages import WORD, common_runs

COLUMNS = corpus_pipeline.COLUMNS


def test_stages_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{folder}/documents.parquet").select(*COLUMNS)
    odd = [(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "123 !?", None, "s", 6)]
    docs = real.unionByName(spark.createDataFrame(odd, real.schema)).cache()
    stage = {name: fn for name, fn in corpus_pipeline.STAGES}

    one = stage["language_id"](spark, docs, folder).cache()
    assert one.columns == COLUMNS
    before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in one.collect()}
    assert {9001, 9002, 9003}.isdisjoint(after) and all(before[i] == t for i, t in after.items())
    assert all(len(before[i] or "") < 40 or not re.search(r"[^\W\d_]", before[i]) for i in before.keys() - after.keys())

    two = stage["line_dedup"](spark, one, folder).cache()
    want = {i: t for i, t, _, gone in brute_lines(list(after.items())) if not gone or t.strip(" ")}
    got = {r.doc_id: r for r in two.collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())

    three = stage["near_dedup"](spark, two, folder).cache()
    parts = brute_near(list(want.items()), 5)
    kept = {r.doc_id: r.text for r in three.collect()}
    assert kept == {i: t for i, t in want.items() if parts[i][1] == i}

    four = stage["substring_dedup"](spark, three, folder).cache()
    left = {r.doc_id: r.text for r in four.collect()}
    runs = common_runs(list(kept.items()), 8)  # a near passage has runs of eight words at least
    assert all(left[i] == t for i, t in kept.items() if i not in runs)
    still = common_runs(list(left.items()), 60)
    assert sum(map(len, still.values())) <= 0.02 * sum(len(WORD.findall(t)) for t in kept.values())

    five = stage["best_fit_packing"](spark, four, folder).collect()
    held = defaultdict(list)
    for r in five:
        held[r.sequence_id].append((r.offset, r.length))
    assert {r.doc_id for r in five} == set(left)
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048


def test_empty_input(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*COLUMNS).where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
