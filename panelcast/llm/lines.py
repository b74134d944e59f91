"""Line de-duplication by overlapping windows of three lines.

Each run of three neighbouring lines is hashed (128 bits). A window whose hash
occurs elsewhere is repeated; every occurrence but the first, in the order of
(id, line number), covers its lines. Covered positions of a document are merged
and those lines removed. The text moves once, for the join with the covered
positions; windows are combined before they are shuffled by hash, and a popular
window only meets its own first occurrence.

Only DataFrame functions are used. A text with fewer than three lines, an empty
text and a null text have no window and stay as they are. Windows of blank lines
alone do not count. Rows with a null id stay as they are; rows that share an
id share their place, so none of them counts as later than another, and each
loses the lines that are covered at its id. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.registry import query, table
from panelcast.sources.stage import write_stage

SIZE = 3


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, also where lambdas use it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``pos`` (first line, from 0) and the two hash halves of every window."""
    def window(lines, i):
        own = [F.element_at(lines, i + k) for k in range(1, SIZE + 1)]
        solid = F.length(F.trim(F.concat(*own))) > 0
        return F.when(solid, F.struct(i.alias("pos"), F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit("second"), *own).alias("h2")))

    def each(lines):
        last = F.size(lines) - SIZE
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: window(lines, i)))

    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.explode(bound(F.split(text_col, "\n", -1), each)).alias("w"))
    return rows.where("w is not null").select("id", "w.pos", "w.h1", "w.h2")


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``covered``: the line numbers of later occurrences of repeated windows."""
    all_windows = write_stage(windows(docs, id_col, text_col), "line-windows")
    repeated = all_windows.groupBy("h1", "h2").agg(F.min(F.struct("id", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = write_stage(repeated.drop("n"), "line-repeats")
    later = all_windows.join(repeated, ["h1", "h2"]).where(F.struct("id", "pos") > F.col("first"))
    spans = later.groupBy("id").agg(F.collect_set("pos").alias("at"))
    lines = F.flatten(F.transform("at", lambda p: F.array(*[p + k for k in range(SIZE)])))
    return spans.select("id", F.array_distinct(lines).alias("covered"))


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without covered lines, with ``n_lines`` and ``n_removed`` (0 for null text).

    The two counts replace columns of the same name.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    covered = covered_lines(docs, id_col, text_col).select(F.col("id").alias("_id"), "covered")
    kept = docs.select(*[F.col(f"`{c}`") for c in names]).join(covered, F.col(id_col) == F.col("_id"), "left")

    def without(lines):
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "covered")
        text = F.array_join(F.transform(left, lambda i: F.element_at(lines, i + 1)), "\n")
        gone = F.size(F.filter("covered", lambda i: i < F.size(lines)))
        return F.struct(text.alias("text"), F.size(lines).alias("n"), gone.alias("gone"))

    kept = kept.withColumn("_cut", F.when(F.col("covered").isNotNull() & F.col(text_col).isNotNull(), bound(F.split(text_col, "\n", -1), without)))
    whole = F.when(F.col(text_col).isNull(), 0).otherwise(F.length(text_col) - F.length(F.translate(text_col, "\n", "")) + 1)
    cut = F.when(F.col("_cut").isNull(), F.col(text_col)).otherwise(F.col("_cut.text"))
    out = [(cut.alias(c) if c == text_col else F.col(f"`{c}`")) for c in names]
    return kept.select(*out, F.coalesce("_cut.n", whole).alias("n_lines"), F.coalesce("_cut.gone", F.lit(0)).alias("n_removed"))


SQL_LINES = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, p AS pos, l[p + 1] || chr(10) || l[p + 2] || chr(10) || l[p + 3] AS win
  FROM d, unnest(range(greatest(len(l) - 2, 0))) AS t(p) WHERE length(trim(l[p + 1] || l[p + 2] || l[p + 3])) > 0
),
later AS (
  SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS rn FROM w) WHERE rn > 1
),
covered AS (SELECT doc_id, list_distinct(flatten(list([pos, pos + 1, pos + 2]))) AS c FROM later GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN c IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(len(l)), lambda i: NOT list_contains(c, i)), lambda i: l[i + 1]), chr(10)), '') END AS text,
  CAST(coalesce(len(l), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(c), 0) AS INTEGER) AS n_removed
FROM d LEFT JOIN covered USING (doc_id)
"""


@query("op9_line_dedup", SQL_LINES)
def op9_line_dedup(spark, folder: str) -> DataFrame:
    """Every document without the lines of windows that occur earlier."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return remove_repeated_lines(docs).select("doc_id", "text", "n_lines", "n_removed")
