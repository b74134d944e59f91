"""Long and wide layouts, duplicate collapsing, assay pivots and interval logs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import NumericType

from panelcast import spec
from panelcast.functions.text import loose_number, simple_visit
from panelcast.operators import cleaning
from panelcast.operators.order_stats import BUCKET_ROWS, HOT_ROWS, exact_quantiles, join_same


def to_long(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    cols = [F.col(m).cast("double").alias(m) for m in measures]
    return df.select(*keys, *cols).unpivot(list(keys), list(measures), "measure", "value")


def median_per(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return exact_quantiles(df, keys, value, {value: 0.5})


def _bucket_medians(table: pa.Table, keys: Sequence[str], measures: Sequence[str], shape: pa.Schema) -> pa.Table:
    """Medians of whole keys, all measures of a key from one sort order each; nulls are passed over."""
    table = table.combine_chunks()
    code = np.zeros(len(table), dtype=np.int64)
    for k in keys:
        coded = table[k].dictionary_encode(null_encoding="encode").combine_chunks()
        _, code = np.unique(code * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)
    parts = []
    for m in measures:
        column = table[m].combine_chunks()
        there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        value, of = column.fill_null(0.0).to_numpy(zero_copy_only=False)[there], code[there]
        order = np.lexsort((value, of))
        value, of = value[order], of[order]
        start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.r_[start, len(of)])
        lo, hi = value[start + (size - 1) // 2], value[start + size // 2]
        columns = [table[k].take(pa.array(there[order][start])) for k in keys]
        parts.append(pa.table([*columns, pa.array([m] * len(start), pa.string()), pa.array(np.where(lo == hi, lo, 0.5 * lo + 0.5 * hi))], names=shape.names))
    return pa.concat_tables(parts).cast(shape)


def medians_of(df: DataFrame, keys: Sequence[str], measures: Sequence[str], hot_rows: int = HOT_ROWS, sized: DataFrame | None = None) -> DataFrame:
    """(keys, measure, value): :func:`median_per` of several measures of the same rows, which move once and are not copied per measure.

    Keys are dealt by their hash into buckets of about BUCKET_ROWS / 2 rows that hold them whole; with a key of more than
    ``hot_rows`` rows the long way is taken, which cuts keys into value buckets. ``sized`` is a cheaper table that has at
    least the rows of ``df`` per first key.
    """
    keys = list(keys)
    sizes = (df.groupBy(*keys) if sized is None else sized.groupBy(keys[0])).count().agg(F.max("count"), F.sum("count")).first()
    if (sizes[0] or 0) > hot_rows:
        return median_per(to_long(df, keys, measures), [*keys, "measure"])
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * (sizes[1] or 0) // BUCKET_ROWS)
    rows = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures])
    shape = rows.select(*keys, F.lit("").alias("measure"), F.lit(0.0).alias("value")).schema
    arrow = to_arrow_schema(shape)
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    return dealt.groupBy("_bucket").applyInArrow(lambda table: _bucket_medians(table, keys, measures, arrow), shape)


def pivot_values(df: DataFrame, keys: Sequence[str], feature: str, names: Sequence[str], value: str = "value") -> DataFrame:
    """Long to wide for a known list of features; the input holds one row per (keys, feature)."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(feature) == n, F.col(value))).alias(n) for n in names])


def observed_names(df: DataFrame, feature: str, most: int = 10_000) -> list[str]:
    """The distinct features in order, to become columns; more than ``most`` is an error rather than a wider table."""
    names = [r[0] for r in df.select(feature).where(F.col(feature).isNotNull()).distinct().orderBy(feature).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} values of {feature} cannot become columns")
    return names


def mixed_dedup(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: the median of every column in which any value parses as a number, else the first value by ``order``.

    Parsed values of all columns are counted in one pass, and the plan is built from the counts. Nulls are passed over,
    null keys group together.
    """
    keys = list(keys)
    columns = [c for c in df.columns if c not in {*keys, order}]
    kinds = {c: df.schema[c].dataType for c in columns}
    parsed = {c: F.col(c).cast("double") if isinstance(k, NumericType) else loose_number(F.col(c).cast("string")) for c, k in kinds.items()}
    seen = df.agg(F.lit(0), *[F.count(v).alias(c) for c, v in parsed.items()]).first()
    numbers = [c for c in columns if seen[c]]
    texts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns if not seen[c]]
    out = df.groupBy(*keys).agg(*texts) if texts else df.select(*keys).distinct()
    if numbers:
        long = df.select(*keys, *[parsed[c].alias(c) for c in numbers]).unpivot(keys, numbers, "measure", "value")
        medians = pivot_values(median_per(long.where("value is not null"), [*keys, "measure"]), keys, "measure", numbers)
        out = join_same(out, medians, keys, "left")
    return out.select(*keys, *columns)


def calendar_rows(raw: DataFrame, ident: str, event: str) -> DataFrame:
    """Raw rows with their calendar ``visit``; screening stands for a missing baseline."""
    df = raw.withColumn("visit", simple_visit(F.col(event)))
    df = df.where(F.col("visit").isin([*spec.VISIT_ORDER, "SC"]))
    return cleaning.sc_to_bl(df, ident, "visit").where(F.col("visit").isin(spec.VISIT_ORDER))


def load_longitudinal(
    raw: DataFrame, ident: str, event: str, measures: Sequence[str], state: str | None = None
) -> DataFrame:
    """Raw visit rows to one median per (entity, visit, measure).

    Visit mapping, calendar filter, screening-to-baseline, state policy, then the exact median.
    """
    df = calendar_rows(raw, ident, event)
    if state:
        df = cleaning.keep_off_state(df, state)
    return median_per(to_long(df, [ident, "visit"], measures), [ident, "visit", "measure"])


def active_intervals(visits: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Log entries running at a visit: started by then and not stopped before (open stop counts)."""
    rows = visits.join(log, list(keys))
    return rows.where(
        (F.col("start_ym") <= F.col("visit_ym"))
        & (F.col("stop_ym").isNull() | (F.col("stop_ym") >= F.col("visit_ym")))
    )


def dose_totals(active: DataFrame, keys: Sequence[str], dose: Column, factor: Column) -> DataFrame:
    """Numeric doses plus each factor times their sum: s * (1 + sum of factors)."""
    numeric = F.coalesce(F.sum(dose), F.lit(0.0))
    return active.groupBy(*keys).agg(
        numeric.alias("ld_numeric"),
        (numeric * F.coalesce(F.sum(factor), F.lit(0.0))).alias("formula_contrib"),
    )
