import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelcast.llm.registry import QUERIES
from panelcast.llm.toxicity import COORDINATES, Ftrl, features, score, train


def test_features_are_words_pairs_and_skips():
    got = list(features(pa.array(["The cat, the CAT", "", None, "cat the"])))
    assert len(got[0]) == 6  # the, cat | the cat, cat the | the the, cat cat
    assert len(got[1]) == len(got[2]) == 0
    assert set(got[3]) < set(got[0])


def test_ftrl_matches_plain_formula():
    rng = np.random.default_rng(0)
    model, z, n = Ftrl(alpha=0.5, l1=0.5), {}, {}
    for _ in range(60):
        at, y = rng.choice(8, 3, replace=False), int(rng.random() < 0.5)
        model.learn(at, y)
        keys, w = [*at.tolist(), COORDINATES], {}
        for k in keys:
            l1 = 0 if k == COORDINATES else 0.5
            zk = z.get(k, 0.0)
            w[k] = 0 if abs(zk) <= l1 else -(zk - np.sign(zk) * l1) / ((1 + np.sqrt(n.get(k, 0.0))) / 0.5 + 1)
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for k in keys:
            old = n.get(k, 0.0)
            z[k] = z.get(k, 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / 0.5 * w[k]
            n[k] = old + g * g
    for k in z:
        assert abs(model.z[k] - z[k]) < 1e-4 and abs(model.n[k] - n[k]) < 1e-4


def test_edge_rows(spark):
    rows = [(i, f"good word {i}", 0) for i in range(60)] + [(100 + i, f"bad word {i}", 1) for i in range(60)] + [(7, None, None), (8, "", 0), (9, "bad " * 40000, 1)]
    df = spark.createDataFrame([(*r, 3.0) for r in rows], "doc_id long, text string, toxic int, score double")
    docs, labels = df.select("doc_id", "text", "score"), df.select("doc_id", "toxic", F.lit("x").alias("text"))
    weights = train(docs, labels)
    got = {r.doc_id: r.score for r in score(df, weights).collect()}
    assert got[103] > 0.5 > got[3] and 0 <= got[7] <= 1 and got[8] <= 0.6
    assert score(df, train(docs.limit(0), labels)).where("score <> 0").count() == 0
    assert train(docs, labels.limit(0)) == {}
    assert score(df.limit(0), weights).count() == 0


def test_held_out_ranking(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op10_toxicity"](spark, folder).toPandas()
    seen = got.merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    seen = seen[seen["held_out"]]
    ranks, y = seen["score"].rank(), seen["toxic"]
    auc = (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    assert auc > 0.95
    assert seen[seen["predicted"] == 1]["toxic"].mean() > 0.9
