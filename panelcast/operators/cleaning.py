"""Row and column cleaning rules for visit tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from panelcast import spec
from panelcast.functions.text import canonical_visit, loose_code, loose_number, state_tag, sum_all, to_number, tokens
from panelcast.sources.tables import first_present


def standardise_ids(df: DataFrame) -> DataFrame:
    """First present id and event candidates become PATNO and EVENT_ID, in front; PATNO is trimmed."""
    ident = first_present(df, spec.ID_CANDIDATES)
    event = first_present(df, spec.EVENT_CANDIDATES)
    front = []
    if ident:
        front.append(F.trim(F.col(ident).cast("string")).alias("PATNO"))
    if event:
        front.append(F.col(event).alias("EVENT_ID"))
    rest = [c for c in df.columns if c not in (ident, event)]
    return df.select(*front, *rest)


def keep_columns(df: DataFrame, keep: Sequence[str], strict: bool = False) -> DataFrame:
    """Project the keep-list columns that exist.

    With fewer than two matches everything is kept, or an error raised when ``strict``.
    """
    have = [c for c in keep if c in df.columns]
    if strict and (len(have) < 2 or not {"PATNO", "EVENT_ID"} <= set(have)):
        raise ValueError(f"need PATNO, EVENT_ID and the keep list; found {have}")
    return df.select(*have) if len(have) >= 2 else df


def filter_events(df: DataFrame, pattern: str, event: str = "EVENT_ID") -> DataFrame:
    """Keep rows whose canonical code matches; the stored code stays as it was."""
    return df.where(canonical_visit(F.col(event)).rlike(pattern))


def _baseline_split(df: DataFrame, ident: str, event: str):
    with_bl = df.where(F.col(event) == "BL").select(ident).distinct()
    is_sc = F.coalesce(F.col(event) == "SC", F.lit(False))
    return df.where(~is_sc), df.where(is_sc), with_bl


def drop_sc_if_bl(df: DataFrame, ident: str = "PATNO", event: str = "EVENT_ID") -> DataFrame:
    """Screening rows go when the entity has a baseline row. Only screening rows are shuffled."""
    rest, screening, with_bl = _baseline_split(df, ident, event)
    return rest.unionByName(screening.join(with_bl, ident, "left_anti"))


def sc_to_bl(df: DataFrame, ident: str = "PATNO", event: str = "EVENT_ID") -> DataFrame:
    """Screening becomes baseline for entities without a baseline row."""
    rest, screening, with_bl = _baseline_split(df, ident, event)
    flagged = screening.join(with_bl.withColumn("_bl", F.lit(True)), ident, "left")
    moved = flagged.withColumn(event, F.when(F.col("_bl").isNull(), "BL").otherwise(F.col(event)))
    return rest.unionByName(moved.drop("_bl"))


def keep_off_state(df: DataFrame, state: str) -> DataFrame:
    return df.where((F.col(state) == "OFF") | F.col(state).isNull())


def best_state_rows(df: DataFrame, keys: Sequence[str], state: str) -> DataFrame:
    """Rows of the best-ranked state per key (ON, then OFF, then UNK), with ``state_rank``."""
    tag = state_tag(F.col(state))
    ranked = df.withColumn("state_rank", F.when(tag == "ON", 0).when(tag == "OFF", 1).otherwise(2))
    best = ranked.groupBy(*keys).agg(F.min("state_rank").alias("state_rank"))
    return ranked.join(best, [*keys, "state_rank"], "left_semi")


def sentinel_to_null(df: DataFrame, prefixes: Sequence[str] = ("NP1", "NP3"), names: Sequence[str] = ("NHY",)) -> DataFrame:
    """The not-rated sentinel becomes null, before any derived score."""
    cols = {
        c: F.nullif(F.col(c), F.lit(spec.SENTINEL).cast(df.schema[c].dataType))
        for c in df.columns
        if c.startswith(tuple(prefixes)) or c in names
    }
    return df.withColumns(cols) if cols else df


def drop_admin_columns(df: DataFrame, names: Sequence[str] = tuple(spec.ADMIN_COLUMNS)) -> DataFrame:
    return df.drop(*names)


def coerce_numeric(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_number(F.col(c)) for c in df.columns if c not in keys})


def encode_sex_text(c: Column) -> Column:
    t = F.upper(F.trim(c))
    return F.when(t.isin("M", "MALE", "1"), 1.0).when(t.isin("F", "FEMALE", "2"), 0.0)


def encode_sex_number(df: DataFrame, column: str, out: str) -> DataFrame:
    """{0,1} stays, {1,2} becomes {1,0}, other codings stay; chosen from the values seen."""
    c = F.col(column)
    seen = df.agg(
        F.coalesce(F.bool_and(c.isin(0, 1)), F.lit(True)).alias("zero_one"),
        F.coalesce(F.bool_and(c.isin(1, 2)), F.lit(True)).alias("one_two"),
    )
    recode = seen.select(~F.col("zero_one") & F.col("one_two")).scalar()
    swapped = F.when(c == 1, 1.0).when(c == 2, 0.0)
    return df.withColumn(out, F.when(recode, swapped).otherwise(c.cast("double")))


def encode_sex(df: DataFrame, column: str, out: str) -> DataFrame:
    """The rule follows the column: words and codes of a text column, else the values seen in a numeric one."""
    if isinstance(df.schema[column].dataType, StringType):
        return df.withColumn(out, encode_sex_text(F.col(column)))
    return encode_sex_number(df, column, out)


def encode_status(df: DataFrame, definition: str, age: str, cohort: str = "COHORT", drop: Sequence[str] = ("ENROLL_STATUS", "EVENT_ID")) -> DataFrame:
    """``IS_PD`` from the definition's words, age and cohort as numbers; the definition and ``drop`` go.

    Columns that are not there are passed over; without a definition ``IS_PD`` is null.
    """
    t = F.upper(F.trim(F.col(definition))) if definition in df.columns else F.lit(None).cast("string")
    cols = {"IS_PD": F.when(t.contains("PARKINSON"), 1.0).when(t.contains("HEALTHY"), 0.0)}
    if cohort in df.columns:
        cols[cohort] = to_number(F.col(cohort))
    if age in df.columns:
        cols[age] = loose_number(F.col(age).cast("string"))
    return df.withColumns(cols).drop(definition, *drop)


def keep_codes(df: DataFrame, keys: Sequence[str], codes: Sequence[str], code: str) -> DataFrame:
    """Rows whose ``code`` is wanted; without that column the keys and wanted columns; without any of these all of it.

    Codes and names are compared by their letters and digits. ``codes`` is a list of the specification.
    """
    wanted = df.sparkSession.createDataFrame([(c,) for c in codes], "code string").select(loose_code(F.col("code")).alias("_code")).distinct()
    if code in df.columns:
        rows = df.withColumn("_code", loose_code(F.col(code).cast("string")))
        return rows.join(F.broadcast(wanted), "_code", "left_semi").drop("_code")
    plain = {re.sub("[^A-Z0-9]+", "", c.strip().upper()) for c in codes}
    named = [c for c in df.columns if c not in keys and re.sub("[^A-Z0-9]+", "", c.strip().upper()) in plain]
    return df.select(*keys, *named) if named else df


def one_hot_tokens(df: DataFrame, text: str, names: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    """With text present: every name 0, then 1 for named tokens. Without: the parsed own value stays."""
    own = names if isinstance(names, Mapping) else {n: to_number(F.col(n)) for n in names}
    has = F.trim(F.coalesce(F.col(text), F.lit(""))) != ""
    found = tokens(F.col(text))
    cols = {
        n: F.when(has, F.array_contains(found, n).cast("double")).otherwise(value) for n, value in own.items()
    }
    return df.withColumns(cols)


def unknown_token_text(df: DataFrame, text: str, names: Sequence[str]) -> DataFrame:
    """Non-empty texts none of whose tokens is a known name."""
    known = F.array(*[F.lit(n) for n in names])
    clean = F.upper(F.trim(F.col(text)))
    return df.where((clean != "") & ~F.arrays_overlap(tokens(F.col(text)), known)).select(clean.alias("text")).distinct()


def numeric_columns(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """Columns with at least one numeric value; one aggregate row reaches the driver."""
    others = [c for c in df.columns if c not in keys]
    row = df.agg(*[F.count(to_number(F.col(c))).alias(c) for c in others]).first()
    return [c for c in others if row[c] > 0]


def repair_temperature(c: Column) -> Column:
    """Fahrenheit above 90 converts first; implausible readings of the converted scale become null."""
    t = F.when(c > 90, (c - 32) * 5.0 / 9.0).otherwise(c)
    return F.when(((t > 42) & (t <= 90)) | (t > 100), None).otherwise(t)


def repair_height(c: Column) -> Column:
    return F.when((c > 50) & (c < 100), c * 2.54).when(c <= 50, None).otherwise(c)


SUPINE = ["SYSSUP", "DIASUP", "HRSUP"]
STANDING = ["SYSSTND", "DIASTND", "HRSTND"]


def zero_vitals_to_null(df: DataFrame) -> DataFrame:
    """All six zero: not measured. Standing all zero beside a real supine reading: standing not measured."""

    def zero(c: str) -> Column:
        return F.coalesce(F.col(c) == 0, F.lit(False))

    def every(cols: Sequence[str]) -> Column:
        return reduce(lambda a, b: a & b, [zero(c) for c in cols])

    supine_seen = ~reduce(lambda a, b: a & b, [F.col(c).isNull() for c in SUPINE])
    blank_standing = every(STANDING) & supine_seen & ~every(SUPINE)
    none = every(SUPINE + STANDING)
    df = df.withColumn("_none", none).withColumn("_stand", blank_standing)
    cols = {c: F.when(F.col("_none"), None).otherwise(F.col(c)) for c in SUPINE}
    cols |= {c: F.when(F.col("_none") | F.col("_stand"), None).otherwise(F.col(c)) for c in STANDING}
    return df.withColumns(cols).drop("_none", "_stand")


def add_derived(df: DataFrame, modality: str) -> DataFrame:
    """Sub-scores, flags and unit repairs of one wide longitudinal modality."""
    have = set(df.columns)
    if modality == "updrs3":
        for name, items in (
            ("TREMOR_SUBSCORE", spec.TREMOR_ITEMS),
            ("BRADY_SUBSCORE", spec.BRADY_ITEMS),
            ("PIGD_SUBSCORE", spec.PIGD_ITEMS),
        ):
            parts = [F.col(c) for c in items if c in have]
            if parts:
                df = df.withColumn(name, sum_all(parts))
    elif modality == "moca":
        recall = sorted(c for c in have if c.startswith("MCAREC"))
        if recall:
            df = df.withColumn("DELAYED_RECALL_SUM", sum_all([F.col(c) for c in recall]))
        if "MCATOT" in have:
            df = df.withColumn("MCI_FLAG", (F.col("MCATOT") < spec.IMPAIRMENT_CUTOFF).cast("double"))
    elif modality == "vital_signs":
        if "TEMPC" in have:
            df = df.withColumn("TEMPC", repair_temperature(F.col("TEMPC")))
        if "HTCM" in have:
            df = df.withColumn("HTCM", repair_height(F.col("HTCM")))
        if set(SUPINE + STANDING) <= have:
            df = zero_vitals_to_null(df)
        for out, lying, up in (("ORTHO_SYS_DROP", "SYSSUP", "SYSSTND"), ("ORTHO_DIA_DROP", "DIASUP", "DIASTND")):
            if {lying, up} <= have:
                df = df.withColumn(out, F.col(lying) - F.col(up))
    return df


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The whole row smallest in ``order`` per key, as a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in rest])
