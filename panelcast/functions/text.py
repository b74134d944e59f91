"""Column expressions that clean messy identifiers, visit codes and numeric text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelcast.spec import NA_TOKENS

_PLAIN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_NUM = r"[+-]?\d+(?:\.\d+)?"
_RANGE = rf"^({_NUM})\s*[-–]\s*({_NUM})$"


def null_tokens(c: Column) -> Column:
    """Missing-value tokens become null."""
    return F.when(c.isin(NA_TOKENS), None).otherwise(c)


def to_number(c: Column) -> Column:
    """Plain decimal text to double, anything else to null (no Java suffixes, no NaN)."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(_PLAIN), t.try_cast("double"))


def canonical_visit(c: Column) -> Column:
    """Trim, upper-case, resolve synonyms and zero-pad ``V<n>`` codes."""
    t = F.upper(F.trim(c))
    digits = F.regexp_extract(t, r"^V(\d+)([A-Z]*)$", 1)
    suffix = F.regexp_extract(t, r"^V(\d+)([A-Z]*)$", 2)
    padded = F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits)
    return (
        F.when(t.isin("SCREENING", "SC"), "SC")
        .when(t.isin("BASELINE", "V00", "V0", "VISIT 0", "VISIT0", "BL"), "BL")
        .when(t.rlike(r"^V\d+[A-Z]*$"), F.concat(F.lit("V"), padded, suffix))
        .otherwise(t)
    )


def simple_visit(c: Column) -> Column:
    """The benchmark path's case-sensitive three-entry mapping."""
    return F.when(c == "SCREENING", "SC").when(c.isin("BASELINE", "V00"), "BL").otherwise(c)


def loose_code(c: Column) -> Column:
    """Upper-case letters and digits only."""
    return F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9]+", "")


def _unsigned_text(c: Column) -> Column:
    t = F.regexp_replace(F.trim(c), ",", ".")
    return F.regexp_replace(t, r"^[<>]=?\s*", "")


def _midpoint(t: Column) -> Column:
    lo, hi = F.regexp_extract(t, _RANGE, 1), F.regexp_extract(t, _RANGE, 2)
    return (lo.try_cast("double") + hi.try_cast("double")) * 0.5


def loose_number(c: Column) -> Column:
    """Range midpoint, else the first number found anywhere."""
    t = F.trim(_unsigned_text(c))
    first = F.regexp_extract(t, f"({_NUM})", 1)
    return F.when(t.rlike(_RANGE), _midpoint(t)).otherwise(F.nullif(first, F.lit("")).try_cast("double"))


def strict_number(c: Column) -> Column:
    """Only a whole number or range; a range with a signed end is ambiguous and becomes null."""
    t = _unsigned_text(c)
    signed_end = t.rlike(r"^[+-]?\d+(?:\.\d+)?\s*[-–]\s*-") | t.rlike(r"^-.*\d\s*[-–]\s*[+]?\d")
    return (
        F.when(t.rlike(_RANGE) & ~signed_end, _midpoint(t))
        .when(t.rlike(f"^{_NUM}$"), t.try_cast("double"))
    )


def lod_number(c: Column) -> Column:
    """Below-detection text ``<x`` becomes x / sqrt(2)."""
    t = F.trim(c)
    limit = F.regexp_extract(t, r"^<\s*([0-9.]+)$", 1)
    return F.when(limit != "", limit.try_cast("double") / F.sqrt(F.lit(2.0))).otherwise(to_number(t))


def month_year(c: Column) -> Column:
    """``MM/YYYY`` to the integer YYYYMM; a blank is accepted as the first month digit."""
    month = F.trim(F.substring(c, 1, 2)).try_cast("int")
    year = F.substring(c, 4, 4).try_cast("int")
    ok = c.rlike(r"^[ \d]\d/\d{4}$") & month.between(1, 12)
    return F.when(ok, year * 100 + month).cast("int")


def dose_factor(c: Column) -> Column:
    """``LD x 0.33`` to 0.33; numbers and unreadable formulas to null."""
    u = F.upper(c)
    bare = F.trim(F.replace(F.replace(u, F.lit("LD"), F.lit("")), F.lit("X"), F.lit("")))
    return F.when(u.contains("LD") & u.contains("X"), to_number(bare))


def state_tag(c: Column) -> Column:
    """ON wins over OFF whenever the text contains it; blank or other text is UNK."""
    t = F.coalesce(F.upper(F.trim(c)), F.lit(""))
    return F.when(t.contains("ON"), "ON").when(t.contains("OFF"), "OFF").otherwise("UNK")


def allele_counts(c: Column) -> dict[str, Column]:
    """Counts of alleles 2, 3 and 4 among the first two found; null when fewer than two."""
    found = F.regexp_extract_all(F.upper(F.trim(c)), F.lit("E?([234])"), F.lit(1))
    pair = F.slice(found, 1, 2)

    def count(digit: str) -> Column:
        hits = F.size(F.filter(pair, lambda x: x == digit)).cast("double")
        return F.when(F.size(found) >= 2, hits)

    return {d: count(d) for d in "234"}


def tokens(c: Column) -> Column:
    """Tokens split on separators and blanks, raw and stripped to letters and digits."""
    parts = F.split(F.upper(F.trim(c)), r"[;,|/]+|\s+")
    clean = F.transform(parts, lambda x: F.regexp_replace(x, "[^A-Z0-9]+", ""))
    return F.array_distinct(F.filter(F.concat(parts, clean), lambda x: x != ""))


def sum_all(columns: list[Column]) -> Column:
    """Row sum that is null as soon as one part is null."""
    return reduce(lambda a, b: a + b, columns)
