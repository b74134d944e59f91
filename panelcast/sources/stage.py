"""Stage tables between pipeline steps.

Each step of the benchmark (panel, task matrices, folds, predictions) is written
once as Parquet in the shared folder named by ``spark.checkpoint.dir`` and read
back by every later step. That keeps plans short, survives lost executors and
gives later scans column pruning and file statistics.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_BUILT: dict[tuple, str] = {}


def stage_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; in local mode a temporary one where none is configured."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        key = (sc.applicationId, "", "folder")
        if key not in _BUILT:
            _BUILT[key] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        folder = _BUILT[key]
    return folder.rstrip("/")


def store_folder(spark: SparkSession, source: str) -> str:
    """A folder for a store that belongs to a versioned input; runs of other applications find it again."""
    return f"{stage_folder(spark)}/store-{hashlib.md5(source.encode()).hexdigest()}"


def input_version(spark: SparkSession, folder: str) -> str:
    """Digest of names, sizes and times of the Parquet files below a folder; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    rows = files.select("path", "modificationTime", "length").collect()  # one row per input file
    return hashlib.md5(repr(sorted(map(tuple, rows))).encode()).hexdigest()


def write_stage(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Frees disk between the steps of a long job: removes tables of ``write_stage`` that no later step reads, and has
    Spark's cleaner drop the shuffles of finished steps, whose results are written, at once instead of at the driver's next collection."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    own = f"/{sc.applicationId}/"
    for folder in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        if own in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    jvm.java.lang.System.gc()


def staged(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stage table of ``source``, built on first use in this application.

    ``source`` names the input and its version, ``name`` the table with its arguments.
    """
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _BUILT:
        df = build()
        path = f"{stage_folder(spark)}/{key[0]}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        _BUILT[key] = path
    return spark.read.parquet(_BUILT[key])


def forget() -> None:
    """Build stage tables anew on next use, e.g. after the input changed or to time a query cold."""
    for key in [k for k in _BUILT if k[2] != "folder"]:
        del _BUILT[key]
