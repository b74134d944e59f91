import itertools
import math

import numpy as np
import public_tokenizers as vocabularies
from pyspark.sql import functions as F

from panelcast.llm.langid import Lattice, expected_counts, predict, public_pieces, train, word_likelihoods
from panelcast.llm.registry import QUERIES


def brute(word, pieces, probs):
    """All segmentations of a word, one by one."""
    total, uses = 0.0, dict.fromkeys(pieces, 0.0)
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, last = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                parts.append(word[last:i])
                last = i
        parts.append(word[last:])
        if all(p in probs for p in parts):
            p = math.prod(probs[x] for x in parts)
            total += p
            for x in parts:
                uses[x] += p
    return total, {k: v / total for k, v in uses.items()}


def test_forward_and_expected_counts_match_enumeration():
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"b c", b"abc", b" ab", b"ca", "é".encode()]
    rng = np.random.default_rng(0)
    probs = np.vstack([rng.random((len(pieces), 2)), np.zeros((1, 2))])
    lattice = Lattice.of(pieces)
    words = [b"abcab", b"a", "caé".encode(), b"zzz"]
    got = word_likelihoods(words, lattice, probs)
    uses = expected_counts(words, np.array([[1, 0], [2, 1], [0, 3], [1, 1]], float), lattice, probs)
    want = np.zeros_like(uses)
    for i, (word, counts) in enumerate(zip(words, [(1, 0), (2, 1), (0, 3), (1, 1)], strict=True)):
        for j in range(2):
            total, each = brute(b" " + word, pieces, dict(zip(pieces, probs[:, j], strict=False)))
            assert math.isclose(got[i, j], math.log(total))
            want[:, j] += counts[j] * np.array([each[p] for p in pieces])
    np.testing.assert_allclose(uses, want, atol=1e-12)


def test_edge_rows(spark):
    pieces = public_pieces(vocabularies.path("piece_bpe_32k.model"))
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "de"), (4, "12 345 !", "en"), (5, "the dog " * 30000, None), (6, "x" * 5000, ""), (2, "die und der", "de")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, lang string, score string")
    model = train(df, pieces)
    assert model.languages == ["de", "en"]
    got = {(r.doc_id, r.lang_pred) for r in predict(df, model).collect()}
    assert {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "en")} <= got and len(got) == 6
    empty = df.limit(0)
    assert predict(df, train(empty, pieces)).where("lang_pred <> 'und' or score <> 0").count() == 0
    assert predict(empty, model).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op7_language_id"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right = seen.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).head()[0]
    assert got.count() == docs.count() and right > 0.97
