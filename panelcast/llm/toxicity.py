"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashes of its distinct words, word pairs and pairs
with one word between (runs of letters, digits and non-ASCII bytes; ASCII
letters lowered). Training is online: every coordinate has its own rate from its
gradient history, and the L1 term keeps a coordinate at zero until its summed
gradient is large, so few weights remain. The learner is sequential, so it works
through a bounded labelled sample in one task; with more ``shards`` these learn
apart and their weights are averaged. Only non-zero weights come back.

Null and empty texts score the base rate. Labels that are null teach nothing;
a document with several labels counts once for each. Without labels every score
is 0. Only id and text are read for a score, so other columns may have any
names. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.langid import is_held_out
from panelcast.llm.registry import query, table
from panelcast.llm.words import LOWER, NOT_ALNUM, mix, slices, span_hashes, text_buffers, word_spans

#: Number of hash coordinates.
COORDINATES = 1 << 22
_PAIR, _SKIP = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Distinct coordinates of each text in turn."""
    data, offsets = text_buffers(column)
    mask = np.uint64(COORDINATES - 1)
    for a, b in slices(offsets):
        cut = LOWER[data[offsets[a] : offsets[b]]]
        start, end, row = word_spans(cut, offsets[a : b + 1] - offsets[a], NOT_ALNUM)
        word = span_hashes(cut, start, end)
        cuts = np.searchsorted(row, np.arange(b - a + 1))
        for i in range(b - a):
            w = word[cuts[i] : cuts[i + 1]]
            pairs, skips = mix(w[:-1] * _PAIR + w[1:]), mix(w[:-2] * _SKIP + w[2:])
            yield np.unique((np.concatenate([w, pairs, skips]) & mask).astype(np.int64))


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal state; coordinate ``COORDINATES`` is the intercept and has no L1 term."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0

    def __post_init__(self):
        self.z = np.zeros(COORDINATES + 1, np.float32)
        self.n = np.zeros(COORDINATES + 1, np.float32)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == COORDINATES, 0, self.l1)
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, COORDINATES)
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + gradient * gradient

    def nonzero(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.append(np.flatnonzero(np.abs(self.z[:-1]) > self.l1), COORDINATES)
        return at, self.weights(at)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_rows: int = 20_000, shards: int = 1, passes: int = 6, settings: dict[str, float] | None = None,
) -> dict[int, float]:
    """Weights by coordinate, from the texts of ``docs`` and the labels of ``labels`` with the same id.

    ``max_rows`` is the documented bound on the labelled sample: the label rows with the
    smallest hashes are used. That bound lets the sample be broadcast, so texts without
    a sampled label never move. Each of the ``shards`` tasks keeps the coordinates of its share.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    chosen = rows.orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").withColumn("h", F.xxhash64(F.xxhash64("id"), "label"))
    sample = sample.repartition(shards, F.pmod("h", F.lit(shards))).sortWithinPartitions("h")
    settings = settings or {}

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kept, rows = Ftrl(**settings), [], 0
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for at, label in zip(features(batch.column(0)), labels, strict=True):
                model.learn(at, label)
                kept.append((at.astype(np.int32), label))
            rows += len(labels)
        for _ in range(passes - 1):
            for at, label in kept:
                model.learn(at, label)
        if rows:
            at, weight = model.nonzero()
            yield pa.record_batch([pa.array(at), pa.array(weight.astype(float) * rows), pa.array(np.full(len(at), rows))], names=["at", "weight", "n"])

    got = sample.select("text", "label").mapInArrow(learned, "at bigint, weight double, n bigint")
    got = got.groupBy("at").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).toPandas()
    if got.empty:
        return {}
    total = got["n"].max()  # every shard returns the intercept
    return dict(zip(got["at"].tolist(), (got["weight"] / total).tolist(), strict=True))


def score(docs: DataFrame, weights: dict[int, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score``, the probability of label 1. Weights are few (L1), at most ``COORDINATES``, and broadcast."""
    state = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(COORDINATES, np.float32)
        own = state.value
        bias = own.get(COORDINATES)
        for at, weight in own.items():
            if at < COORDINATES:
                dense[at] = weight
        for batch in batches:
            sums = np.array([dense[at].sum(dtype=float) for at in features(batch.column(1))])
            out = np.zeros(batch.num_rows) if bias is None else 1 / (1 + np.exp(-np.clip(sums + bias, -30, 30)))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(scored, f"`{id_col}` {kind}, score double")


@query("op10_toxicity")
def op10_toxicity(spark, folder: str) -> DataFrame:
    """Toxicity of every document; every fifth hash class of ids is held out from learning."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    held_out = is_held_out("doc_id", 5, 0)
    weights = train(docs, labels.where(~held_out))
    scores = score(docs, weights)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
