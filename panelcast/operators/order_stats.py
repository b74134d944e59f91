"""Exact order statistics whose largest task stays bounded when one key holds most rows.

Every helper first checks the largest key with a map-side combined count. If all
keys are small, a plain window or the built-in exact percentile does the work in
one shuffle. Otherwise sorting a whole key inside one task would not hold: ties
are collapsed into counts, every key is cut into value buckets whose edges come
from a deterministic bottom-k hash sample, the window runs inside one bucket at a
time, and bucket offsets are added afterwards. Both ways give the same result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000
#: Rows that one task should sort; larger keys are cut into enough buckets of this size.
BUCKET_ROWS = 500_000


def has_hot_key(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> bool:
    """Whether some key has more rows than one task should sort."""
    return not df.groupBy(*keys).count().where(F.col("count") > hot_rows).isEmpty()


def bucket_count(df: DataFrame) -> int:
    """Power of two: at least twice the shuffle width, and enough for buckets of about BUCKET_ROWS.

    Edges of 2**20 buckets (8 MB) still fit in a row; beyond 5e11 rows the buckets grow instead, and their sort spills.
    """
    wanted = max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // BUCKET_ROWS)
    return 1 << min(20, max(4, (wanted - 1).bit_length()))


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null, as in grouping; the left keys stay."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys], F.lit(True))
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def split_points(counts: DataFrame, keys: Sequence[str], value: str, n: int) -> DataFrame:
    """One row: ``n - 1`` ascending edges from the rows with the smallest hashes.

    The sample depends on the data only, so a recomputed stage sees the same edges.
    """
    hashed = counts.select(F.col(value).alias("v"), F.xxhash64(*keys, value).alias("h"))
    sample = hashed.orderBy("h", "v").limit(8 * n)
    probs = F.array(*[F.lit(i / n) for i in range(1, n)])
    return sample.agg(F.percentile("v", probs).alias("edges"))


def with_bucket(df: DataFrame, value: str, edges: DataFrame, n: int, out: str = "_bucket") -> DataFrame:
    """Add the number of edges that are <= value, found by binary search."""
    df = df.withColumn("_edges", edges.scalar()).withColumn(out, F.lit(0))
    step = n // 2
    while step:
        at = F.get("_edges", F.col(out) + F.lit(step - 1))
        df = df.withColumn(out, F.col(out) + F.when(F.col(value) >= at, step).otherwise(0))
        step //= 2
    return df.drop("_edges")


def running_sums(
    df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column], hot: bool | None = None
) -> DataFrame:
    """Per (keys, value): each sum, its total over smaller values (``*_before``) and over the key (``*_total``).

    ``hot`` is the known answer of :func:`has_hot_key`, when the caller has it.
    """
    keys = list(keys)
    names = list(sums)
    if hot is None:
        hot = has_hot_key(df, keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    )
    if not hot:
        whole = Window.partitionBy(*keys)
        smaller = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(
            *keys, value, *names,
            *[F.coalesce(F.sum(s).over(smaller), F.lit(0)).alias(f"{s}_before") for s in names],
            *[F.sum(s).over(whole).alias(f"{s}_total") for s in names],
        )
    n = bucket_count(df)
    cut = with_bucket(counts, value, split_points(counts, keys, value, n), n)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = cut.select("*", *[F.sum(s).over(inside).alias(f"_{s}_in") for s in names])
    # At most one row per (key, bucket) from here on.
    per_bucket = cut.groupBy(*keys, "_bucket").agg(*[F.sum(s).alias(s) for s in names])
    ordered = Window.partitionBy(*keys).orderBy("_bucket")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_bucket.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_{s}_off") for s in names],
        *[F.sum(s).over(whole).alias(f"{s}_total") for s in names],
    )
    joined = join_same(rows, offsets, [*keys, "_bucket"])
    return joined.select(
        *keys,
        value,
        *names,
        *[(F.col(f"_{s}_off") + F.col(f"_{s}_in") - F.col(s)).alias(f"{s}_before") for s in names],
        *[f"{s}_total" for s in names],
    )


def average_ranks(
    df: DataFrame, keys: Sequence[str], value: str, out: str, hot: bool | None = None
) -> DataFrame:
    """Average-tie rank of every distinct value inside its key, plus the key size ``n``."""
    runs = running_sums(df, keys, value, {"cnt": F.lit(1)}, hot)
    rank = F.col("cnt_before") + (F.col("cnt") + 1) / 2
    return runs.select(*keys, value, rank.alias(out), F.col("cnt_total").alias("n"))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    hot_rows: int = HOT_ROWS,
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles per key; null values are skipped, ``weight`` counts repeats.

    Keys up to ``hot_rows`` rows use the built-in exact aggregate; larger keys (at
    most rows / hot_rows of them) go through :func:`running_sums`.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, value, *([weight] if weight else []))
    times = F.col(weight) if weight else F.lit(1)
    quantiles = [F.percentile(value, q, times).alias(name) for name, q in probs.items()]
    hot = rows.groupBy(*keys).count().where(F.col("count") > hot_rows).select(*keys)
    if hot.isEmpty():
        return rows.groupBy(*keys).agg(*quantiles)
    cold = join_same(rows, hot, keys, "left_anti").groupBy(*keys).agg(*quantiles)
    runs = running_sums(join_same(rows, hot, keys, "left_semi"), keys, value, {"cnt": times}, hot=True)
    picks, final = [], []
    for name, q in probs.items():
        pos = (F.col("cnt_total") - 1) * F.lit(float(q))
        frac = pos - F.floor(pos)
        for end, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (F.col("cnt_before") <= at) & (at < F.col("cnt_before") + F.col("cnt"))
            picks.append(F.max(F.when(here, F.col(value))).alias(f"{name}_{end}"))
        picks.append(F.max(frac).alias(f"{name}_frac"))
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        final.append((lo + (hi - lo) * F.col(f"{name}_frac")).alias(name))
    warm = runs.groupBy(*keys).agg(*picks).select(*keys, *final)
    return cold.unionByName(warm)


def number_in_order(
    df: DataFrame, keys: Sequence[str], order: str, tie: str, out: str = "pos", hot: bool | None = None
) -> DataFrame:
    """0-based position by an md5 hex column inside each key, without sorting a key in one task.

    Hex prefixes of a hash are equally full, so they serve as ready-made range buckets.
    """
    keys = list(keys)
    if hot is None:
        hot = has_hot_key(df, keys)
    if not hot:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(order, tie)) - 1)
    chars = -(-(bucket_count(df).bit_length() - 1) // 4)
    cut = df.withColumn("_bucket", F.substring(order, 1, chars))
    rn = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(order, tie))
    per_bucket = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off")
    )
    numbered = join_same(cut.withColumn("_rn", rn), offsets, [*keys, "_bucket"])
    return numbered.withColumn(out, F.col("_off") + F.col("_rn") - 1).drop("_bucket", "_rn", "_off")
