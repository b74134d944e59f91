"""Training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage is a function of (spark, docs, folder) and works on all rows its
predecessor kept; all but the last return the columns of documents. ``n_chars``
follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import langid, lines, minhash, packing, passages
from panelcast.sources.stage import write_stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a letter go, and those whose best language has under half of the probability.

    The model learns from the labelled rows of the stage's own input. Each row is judged by its own text,
    in one pass, whatever its id; rows with a null id are judged alike.
    """
    import public_tokenizers as vocabularies

    pieces = langid.public_pieces(vocabularies.path("piece_bpe_32k.model"))
    model = langid.train(docs, pieces)
    if not model.languages:  # nothing to tell languages apart by: only texts without a letter go
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = langid.predict(docs.select(*COLUMNS), model, keep=COLUMNS)
    return found.where("lang_pred <> 'und' and score >= 0.5").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines of windows that occur earlier go, and documents of which nothing is left."""
    cut = lines.remove_repeated_lines(docs)
    return _documents(cut.where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0)))


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id; rows with a null id stay."""
    found = minhash.near_duplicates(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has go, and documents of which nothing is left."""
    found = passages.repeated_passages(docs)
    cut = passages.remove_passages(docs.withColumn("n_chars", F.length("text")), found)
    return _documents(cut.where((F.length("text") == F.col("n_chars")) | (F.length(F.trim("text")) > 0) | F.col("text").isNull()))


def best_fit_packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 ids."""
    import public_tokenizers as vocabularies

    return packing.pack(packing.tokenise(docs, vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: Language models, MinHash and packing cannot be stated in SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = write_stage(stage(spark, docs, folder), f"pipeline-{name}")
    return docs
