"""Reading named tables and clean CSV extracts; writing partitioned result tables."""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.text import null_tokens
from panelcast.sources.stage import input_version

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """``Tables(spark, folder).orders`` reads ``folder/orders.parquet`` lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def version(self) -> str:
        """The folder with a digest of its files, so that stage tables of changed input are built anew."""
        return f"{self.folder}@{input_version(self.spark, self.folder)}"

    def __getattr__(self, name: str) -> DataFrame:
        return self.scan(name)

    def scan(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        if name not in TABLES:
            raise FileNotFoundError(f"unknown table: {name}")
        df = self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))
        return df.select(*columns) if columns else df


def clean_header(name: str) -> str:
    return name.strip().upper()


def clean_text(df: DataFrame) -> DataFrame:
    """Upper-case headers, every column as text, missing-value tokens as null."""
    return df.select(*[null_tokens(F.col(f"`{c}`").cast("string")).alias(clean_header(c)) for c in df.columns])


def scan_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = clean_text(spark.read.csv(path, header=True, inferSchema=False, nullValue=""))
    return df.select(*columns) if columns else df


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    have = set(df.columns)
    return next((c for c in candidates if c in have), None)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """One folder per partition value; rows of one value go to few files without a single hot writer."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def clean_column_names(df: DataFrame) -> DataFrame:
    """Blanks and hyphens in pivoted headers become underscores."""
    return df.toDF(*[c.replace(" ", "_").replace("-", "_") for c in df.columns])
