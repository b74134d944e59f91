"""Queries that clean identifiers, visit codes, states, codings and numeric text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast import spec
from panelcast.functions import text
from panelcast.operators import cleaning, reshape
from panelcast.plans.panel import SQL_RAW, SQL_TASKS, SQL_FOLDS, SQL_PANEL, ITEM_MEASURES, Panel
from panelcast.plans.registry import query, rnd
from panelcast.sources.tables import Tables, clean_column_names, clean_text

# --- messy inputs derived from the tables, in both dialects -----------------------


def messy_visit(code: Column, priority: Column) -> Column:
    return (
        F.when(priority == 1, F.concat(F.lit("  "), F.lower(code), F.lit(" ")))
        .when(priority == 2, F.regexp_replace(code, "^V0", "V"))
        .when(priority == 4, F.when(code == "BL", "Baseline").when(code == "SC", "screening").otherwise(F.concat(code, F.lit("A"))))
        .when((priority == 5) & (code == "BL"), "visit 0")
        .otherwise(code)
    )


SQL_MESSY = f"""{SQL_RAW},
messy AS (SELECT *, CASE WHEN PRIORITY = 1 THEN '  ' || lower(event_id) || ' '
  WHEN PRIORITY = 2 THEN regexp_replace(event_id, '^V0', 'V')
  WHEN PRIORITY = 4 THEN CASE event_id WHEN 'BL' THEN 'Baseline' WHEN 'SC' THEN 'screening' ELSE event_id || 'A' END
  WHEN PRIORITY = 5 AND event_id = 'BL' THEN 'visit 0' ELSE event_id END AS raw_event FROM raw_orders)"""


def sql_visit(c: str) -> str:
    t = f"upper(trim({c}))"
    return f"""CASE WHEN {t} IN ('SCREENING', 'SC') THEN 'SC'
      WHEN {t} IN ('BASELINE', 'V00', 'V0', 'VISIT 0', 'VISIT0', 'BL') THEN 'BL'
      WHEN regexp_matches({t}, '^V\\d+[A-Z]*$') THEN 'V' || CASE WHEN length(regexp_extract({t}, '^V(\\d+)', 1)) < 2 THEN '0' ELSE '' END
        || regexp_extract({t}, '^V(\\d+)([A-Z]*)$', 1) || regexp_extract({t}, '^V(\\d+)([A-Z]*)$', 2)
      ELSE {t} END"""


def messy_orders(t: Tables) -> DataFrame:
    o = Panel(t).raw_orders
    return o.withColumn("raw_event", messy_visit(F.col("event_id"), F.col("PRIORITY")))


def messy_numbers(t: Tables) -> DataFrame:
    v = F.col("value").cast("string")
    kind = F.col("event_type")
    raw = (
        F.when(kind == "view", F.concat(F.lit("<"), v))
        .when(kind == "error", F.replace(v, F.lit("."), F.lit(",")))
        .when(kind == "purchase", F.concat(v, F.lit("-"), F.col("user_id").cast("string")))
        .when(kind == "signup", F.concat(v, F.lit(" mg")))
        .otherwise(v)
    )
    return t.scan("events", ["event_id", "user_id", "event_type", "value", "props"]).withColumn("raw", raw)


SQL_NUMBERS = """nums AS (SELECT event_id, user_id, event_type, value, props, CASE event_type WHEN 'view' THEN '<' || CAST(value AS VARCHAR)
  WHEN 'error' THEN replace(CAST(value AS VARCHAR), '.', ',') WHEN 'purchase' THEN CAST(value AS VARCHAR) || '-' || CAST(user_id AS VARCHAR)
  WHEN 'signup' THEN CAST(value AS VARCHAR) || ' mg' ELSE CAST(value AS VARCHAR) END AS raw FROM events)"""
_N = r"[+-]?\d+(?:\.\d+)?"


def _sql_bare(c: str) -> str:
    return rf"regexp_replace(replace(trim({c}), ',', '.'), '^[<>]=?\s*', '')"


def _sql_mid(t: str) -> str:
    r = rf"^({_N})\s*[-–]\s*({_N})$"
    return f"(CAST(regexp_extract({t}, '{r}', 1) AS DOUBLE) + CAST(regexp_extract({t}, '{r}', 2) AS DOUBLE)) * 0.5"


def sql_loose(c: str) -> str:
    t = f"trim({_sql_bare(c)})"
    return rf"""CASE WHEN regexp_matches({t}, '^({_N})\s*[-–]\s*({_N})$') THEN {_sql_mid(t)}
      ELSE TRY_CAST(nullif(regexp_extract({t}, '({_N})', 1), '') AS DOUBLE) END"""


def sql_strict(c: str) -> str:
    t = _sql_bare(c)
    return rf"""CASE WHEN regexp_matches({t}, '^\d+(?:\.\d+)?\s*[-–]\s*\d+(?:\.\d+)?$') THEN {_sql_mid(t)}
      WHEN regexp_matches({t}, '^{_N}$') THEN CAST({t} AS DOUBLE) END"""


@query("clean_numeric_loose", f"""WITH {SQL_NUMBERS} SELECT event_id, round({sql_loose("raw")}, 6) AS value,
  round({sql_loose("props")}, 6) AS props_value FROM nums""")
def clean_numeric_loose(t: Tables) -> DataFrame:
    return messy_numbers(t).select(
        "event_id", rnd(text.loose_number(F.col("raw"))).alias("value"),
        rnd(text.loose_number(F.col("props"))).alias("props_value"),
    )


@query("clean_numeric_strict", f"""WITH {SQL_NUMBERS} SELECT event_id, round({sql_strict("raw")}, 6) AS value,
  CASE WHEN {sql_strict("raw")} IS NULL THEN 'rejected' ELSE 'ok' END AS parse_status FROM nums""")
def clean_numeric_strict(t: Tables) -> DataFrame:
    v = text.strict_number(F.col("raw"))
    return messy_numbers(t).select(
        "event_id", rnd(v).alias("value"), F.when(v.isNull(), "rejected").otherwise("ok").alias("parse_status")
    )


@query("clean_lod_substitution", f"""WITH {SQL_NUMBERS} SELECT event_id, round(CASE WHEN regexp_matches(raw, '^<\\s*([0-9.]+)$')
  THEN CAST(regexp_extract(raw, '^<\\s*([0-9.]+)$', 1) AS DOUBLE) / sqrt(2.0) ELSE TRY_CAST(raw AS DOUBLE) END, 6) AS value FROM nums""")
def clean_lod_substitution(t: Tables) -> DataFrame:
    return messy_numbers(t).select("event_id", rnd(text.lod_number(F.col("raw"))).alias("value"))


@query("clean_month_year", """WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN strftime(o_orderdate, '%m/%Y')
  WHEN 'F' THEN CAST(month(o_orderdate) AS VARCHAR) || '/' || year(o_orderdate) ELSE lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0') || '/' || year(o_orderdate) END AS raw FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(raw, '^\\d{2}/\\d{4}$') AND CAST(substr(raw, 1, 2) AS INT) BETWEEN 1 AND 12
  THEN CAST(CAST(substr(raw, 4, 4) AS INT) * 100 + CAST(substr(raw, 1, 2) AS INT) AS INT) END AS ym FROM x""")
def clean_month_year(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    year = F.year(d).cast("string")
    raw = (
        F.when(F.col("o_orderstatus") == "O", F.date_format(d, "MM/yyyy"))
        .when(F.col("o_orderstatus") == "F", F.concat(F.month(d).cast("string"), F.lit("/"), year))
        .otherwise(F.concat(F.lpad(F.dayofmonth(d).cast("string"), 2, "0"), F.lit("/"), year))
    )
    return t.scan("orders").select("o_orderkey", text.month_year(raw).alias("ym"))


@query("clean_dose_formula", """WITH x AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'LD x ' || CAST(l_discount AS VARCHAR)
  WHEN 'A' THEN CAST(l_quantity AS VARCHAR) ELSE '(150 + LD) x ' || CAST(l_tax AS VARCHAR) END AS raw, l_discount, l_quantity, l_returnflag FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 6) AS dose, round(sum(CASE WHEN l_returnflag = 'R' THEN l_discount END), 6) AS factor
FROM x GROUP BY l_returnflag""")
def clean_dose_formula(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    raw = (
        F.when(flag == "R", F.concat(F.lit("LD x "), F.col("l_discount").cast("string")))
        .when(flag == "A", F.col("l_quantity").cast("string"))
        .otherwise(F.concat(F.lit("(150 + LD) x "), F.col("l_tax").cast("string")))
    )
    df = t.scan("lineitem").select("l_returnflag", raw.alias("raw"))
    return df.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum(text.to_number(F.col("raw")))).alias("dose"),
        rnd(F.sum(text.dose_factor(F.col("raw")))).alias("factor"),
    )


# --- P: identifiers, visits, states -----------------------------------------------


@query("id_visit_standardise", f"WITH {SQL_MESSY} SELECT CAST(entity_id AS VARCHAR) AS PATNO, raw_event AS EVENT_ID, TOTAL FROM messy")
def id_visit_standardise(t: Tables) -> DataFrame:
    src = messy_orders(t).select(
        "TOTAL", F.col("raw_event").alias("VISCODE"), F.concat(F.lit(" "), F.col("entity_id").cast("string")).alias("SUBJECT_ID")
    )
    return cleaning.standardise_ids(src)


@query("keep_columns_soft", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def keep_columns_soft(t: Tables) -> DataFrame:
    return cleaning.keep_columns(t.scan("customer"), ["c_custkey", "c_acctbal", "c_mktsegment", "c_phone"])


@query("keep_columns_strict", f"WITH {SQL_MESSY} SELECT CAST(entity_id AS VARCHAR) AS PATNO, raw_event AS EVENT_ID, TOTAL FROM messy")
def keep_columns_strict(t: Tables) -> DataFrame:
    return cleaning.keep_columns(id_visit_standardise(t), ["PATNO", "EVENT_ID", "TOTAL", "NP3TOT"], strict=True)


@query("visit_canonicalise", f"WITH {SQL_MESSY} SELECT order_id, raw_event, {sql_visit('raw_event')} AS visit FROM messy")
def visit_canonicalise(t: Tables) -> DataFrame:
    return messy_orders(t).select("order_id", "raw_event", text.canonical_visit(F.col("raw_event")).alias("visit"))


@query("visit_map_simple", f"""WITH {SQL_MESSY} SELECT order_id, CASE raw_event WHEN 'SCREENING' THEN 'SC' WHEN 'BASELINE' THEN 'BL' WHEN 'V00' THEN 'BL'
  ELSE raw_event END AS visit FROM messy""")
def visit_map_simple(t: Tables) -> DataFrame:
    return messy_orders(t).select("order_id", text.simple_visit(F.col("raw_event")).alias("visit"))


@query("visit_filter", f"""WITH {SQL_MESSY} SELECT order_id, raw_event, regexp_matches({sql_visit('raw_event')}, '{spec.BASELINE_EVENTS}') AS baseline
  FROM messy WHERE regexp_matches({sql_visit('raw_event')}, '{spec.ALLOWED_EVENTS}')""")
def visit_filter(t: Tables) -> DataFrame:
    kept = cleaning.filter_events(messy_orders(t), spec.ALLOWED_EVENTS, "raw_event")
    base = text.canonical_visit(F.col("raw_event")).rlike(spec.BASELINE_EVENTS)
    return kept.select("order_id", "raw_event", base.alias("baseline"))


@query("drop_sc_if_bl", f"""WITH {SQL_RAW} SELECT order_id, entity_id, event_id FROM raw_orders
  WHERE event_id <> 'SC' OR entity_id NOT IN (SELECT entity_id FROM raw_orders WHERE event_id = 'BL')""")
def drop_sc_if_bl(t: Tables) -> DataFrame:
    o = Panel(t).raw_orders.select("order_id", "entity_id", "event_id")
    return cleaning.drop_sc_if_bl(o, "entity_id", "event_id")


@query("sc_to_bl", f"""WITH {SQL_RAW} SELECT order_id, entity_id, CASE WHEN event_id = 'SC' AND entity_id NOT IN
  (SELECT entity_id FROM raw_orders WHERE event_id = 'BL') THEN 'BL' ELSE event_id END AS event_id FROM raw_orders""")
def sc_to_bl(t: Tables) -> DataFrame:
    o = Panel(t).raw_orders.select("order_id", "entity_id", "event_id")
    return cleaning.sc_to_bl(o, "entity_id", "event_id")


@query("state_off_filter", f"WITH {SQL_RAW} SELECT order_id, state, TOTAL FROM raw_orders WHERE state = 'OFF' OR state IS NULL")
def state_off_filter(t: Tables) -> DataFrame:
    return cleaning.keep_off_state(Panel(t).raw_orders, "state").select("order_id", "state", "TOTAL")


_SQL_STATE = "CASE o_orderstatus WHEN 'O' THEN CASE WHEN o_orderpriority < '3' THEN ' on-med' ELSE 'NONE' END WHEN 'F' THEN 'Off state' ELSE '' END"


@query("state_priority", f"""WITH {SQL_RAW}, s AS (SELECT entity_id, event_id, TOTAL, PRIORITY, o.o_orderstatus,
    CASE WHEN upper({_SQL_STATE}) LIKE '%ON%' THEN 0 WHEN upper({_SQL_STATE}) LIKE '%OFF%' THEN 1 ELSE 2 END AS rk
  FROM raw_orders r JOIN orders o ON o.o_orderkey = r.order_id),
  b AS (SELECT *, min(rk) OVER (PARTITION BY entity_id, event_id) AS best FROM s)
SELECT entity_id, event_id, round(median(TOTAL), 4) AS TOTAL, median(PRIORITY) AS PRIORITY,
  CAST(max(rk = 0) AS DOUBLE) AS PDSTATE_USED_ON, CAST(max(rk = 1) AS DOUBLE) AS PDSTATE_USED_OFF, CAST(max(rk = 2) AS DOUBLE) AS PDSTATE_USED_UNK
FROM b WHERE rk = best GROUP BY entity_id, event_id""")
def state_priority(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    raw_state = (
        F.when(status == "O", F.when(F.col("o_orderpriority") < "3", " on-med").otherwise("NONE"))
        .when(status == "F", "Off state").otherwise("")
    )
    states = t.scan("orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"]).select(
        F.col("o_orderkey").alias("order_id"), raw_state.alias("raw_state")
    )
    keys = ["entity_id", "event_id"]
    rows = Panel(t).raw_orders.drop("state").join(states, "order_id")
    kept = cleaning.best_state_rows(rows, keys, "raw_state")
    medians = reshape.median_per(reshape.to_long(kept, keys, ["TOTAL", "PRIORITY"]), [*keys, "measure"])
    wide = reshape.pivot_values(medians, keys, "measure", ["TOTAL", "PRIORITY"])
    used = kept.groupBy(*keys).agg(F.min("state_rank").alias("r"))
    flags = [(F.col("r") == i).cast("double").alias(f"PDSTATE_USED_{n}") for i, n in enumerate(("ON", "OFF", "UNK"))]
    return wide.join(used, keys).select(*keys, rnd("TOTAL", 4).alias("TOTAL"), "PRIORITY", *flags)


@query("sentinel_to_null", """SELECT l_orderkey, l_linenumber, nullif(NP3A, 101) AS NP3A, nullif(NHY, 101) AS NHY, MCATOT FROM (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN 101.0 ELSE l_quantity END AS NP3A,
    CASE WHEN l_returnflag = 'R' THEN 101.0 ELSE l_linenumber END AS NHY, CASE WHEN l_linestatus = 'O' THEN 101.0 ELSE l_quantity END AS MCATOT FROM lineitem)""")
def sentinel_to_null(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    src = t.scan("lineitem").select(
        "l_orderkey", "l_linenumber", F.when(q > 45, 101.0).otherwise(q).alias("NP3A"),
        F.when(F.col("l_returnflag") == "R", 101.0).otherwise(F.col("l_linenumber").cast("double")).alias("NHY"),
        F.when(F.col("l_linestatus") == "O", 101.0).otherwise(q).alias("MCATOT"),
    )
    return cleaning.sentinel_to_null(src)


@query("coerce_numeric", f"WITH {SQL_NUMBERS} SELECT event_id, TRY_CAST(raw AS DOUBLE) AS raw, TRY_CAST(event_type AS DOUBLE) AS event_type FROM nums")
def coerce_numeric(t: Tables) -> DataFrame:
    return cleaning.coerce_numeric(messy_numbers(t).select("event_id", "raw", "event_type"), ["event_id"])


@query("drop_admin_columns", f"WITH {SQL_RAW} SELECT order_id, TOTAL FROM raw_orders")
def drop_admin_columns(t: Tables) -> DataFrame:
    o = Panel(t).raw_orders.select("order_id", "TOTAL", F.col("event_id").alias("EVENT_ID"), F.col("state").alias("PDSTATE"))
    return cleaning.drop_admin_columns(o)


@query("cohort_filter", f"WITH {SQL_PANEL} SELECT order_id, entity_id FROM raw_orders WHERE entity_id IN (SELECT entity_id FROM cohort)")
def cohort_filter(t: Tables) -> DataFrame:
    p = Panel(t)
    return p.raw_orders.join(p.cohort, "entity_id", "left_semi").select("order_id", "entity_id")


@query("encode_sex", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0.0 WHEN 'O' THEN 1.0 END AS sex_text,
  CASE o_orderstatus WHEN 'F' THEN 1.0 ELSE 0.0 END AS sex_number FROM orders""")
def encode_sex(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    src = t.scan("orders").select(
        "o_orderkey", F.when(s == "F", "female").when(s == "O", " m ").otherwise("x").alias("txt"),
        F.when(s == "F", 1).otherwise(2).alias("num"),
    )
    out = cleaning.encode_sex(cleaning.encode_sex(src, "txt", "sex_text"), "num", "sex_number")
    return out.select("o_orderkey", "sex_text", "sex_number")


@query("encode_status", """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1.0 WHEN 'FURNITURE' THEN 0.0 END AS IS_PD,
  c_acctbal AS ENROLL_AGE, CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(c_nationkey AS DOUBLE) END AS COHORT FROM customer""")
def encode_status(t: Tables) -> DataFrame:
    seg = F.col("c_mktsegment")
    src = t.scan("customer").select(
        "c_custkey",
        F.when(seg == "BUILDING", " Parkinson's Disease").when(seg == "FURNITURE", "Healthy Control").otherwise("Prodromal").alias("COHORT_DEFINITION"),
        F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")).alias("ENROLL_AGE"),
        F.when(seg == "MACHINERY", "unknown").otherwise(F.col("c_nationkey").cast("string")).alias("COHORT"),
        F.lit("enrolled").alias("ENROLL_STATUS"), F.lit("SC").alias("EVENT_ID"),
    )
    return cleaning.encode_status(src, "COHORT_DEFINITION", "ENROLL_AGE")


@query("allele_counts", """WITH f AS (SELECT p_partkey, regexp_extract_all(upper(trim(p_brand)), 'E?([234])', 1) AS a FROM part)
SELECT p_partkey, """ + ", ".join(
    f"CASE WHEN len(a) >= 2 THEN CAST(len(list_filter(a[1:2], lambda x: x = '{d}')) AS DOUBLE) END AS e{d}" for d in "234"
) + " FROM f")
def allele_counts(t: Tables) -> DataFrame:
    counts = text.allele_counts(F.col("p_brand"))
    return t.scan("part").select("p_partkey", *[c.alias(f"e{d}") for d, c in counts.items()])


_GENES = ["RED", "BLUE", "SMALL", "RING", "WIDGET"]
_SQL_PART_TEXT = "CASE WHEN p_type = 'ECONOMY' THEN '' WHEN p_type = 'SMALL' THEN replace(p_name, ' ', ';') ELSE p_name END"


def _part_text() -> Column:
    kind, name = F.col("p_type"), F.col("p_name")
    return F.when(kind == "ECONOMY", "").when(kind == "SMALL", F.replace(name, F.lit(" "), F.lit(";"))).otherwise(name)


@query("token_one_hot", f"""WITH p AS (SELECT p_partkey, p_size, {_SQL_PART_TEXT} AS txt FROM part)
SELECT p_partkey, {", ".join(f"CASE WHEN txt <> '' THEN CAST(list_contains(regexp_split_to_array(upper(txt), '[;,|/]+|\\s+'), '{g}') AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END AS {g}" for g in _GENES)} FROM p""")
def token_one_hot(t: Tables) -> DataFrame:
    src = t.scan("part").select("p_partkey", "p_size", _part_text().alias("txt"))
    own = {g: F.col("p_size").cast("double") for g in _GENES}
    return cleaning.one_hot_tokens(src, "txt", own).drop("p_size", "txt")


@query("token_unknown_report", f"""WITH p AS (SELECT {_SQL_PART_TEXT} AS txt FROM part)
SELECT DISTINCT upper(txt) AS text FROM p WHERE txt <> '' AND NOT list_has_any(regexp_split_to_array(upper(txt), '[;,|/]+|\\s+'), {_GENES!r})""")
def token_unknown_report(t: Tables) -> DataFrame:
    return cleaning.unknown_token_text(t.scan("part").select(_part_text().alias("txt")), "txt", _GENES)


@query("numeric_columns_only", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS C_NATIONKEY, CAST(c_acctbal AS VARCHAR) AS C_ACCTBAL FROM customer")
def numeric_columns_only(t: Tables) -> DataFrame:
    src = clean_text(t.scan("customer").drop("c_custkey")).columns
    df = t.scan("customer").select("c_custkey", *[F.col(c.lower()).cast("string").alias(c) for c in src])
    return df.select("c_custkey", *cleaning.numeric_columns(df, ["c_custkey"]))


@query("code_list_filter", "SELECT event_id, event_type FROM events WHERE upper(event_type) IN ('CLICK', 'VIEW', 'PURCHASE')")
def code_list_filter(t: Tables) -> DataFrame:
    return cleaning.keep_codes(t.scan("events", ["event_id", "event_type"]), ["event_id"], ["Cli-ck", "VIEW ", "purchase"], "event_type")


def assay_rows(t: Tables) -> DataFrame:
    """Line items dressed as a long assay table (entity, sample type, event, test, raw value)."""
    flag, line, tax = F.col("l_returnflag"), F.col("l_linenumber"), F.col("l_tax")
    kind = F.when(flag == "A", "csf sample").when(flag == "N", "Plasma EDTA").otherwise("Serum")
    event = F.when(line == 1, "Baseline").when(line == 2, "BL").when(line == 3, "Screening").otherwise("V04")
    test = F.when(tax < 0.03, "NFL").when(tax < 0.06, "CSF Alpha-synuclein").otherwise("Other")
    price = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    raw = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("<"), price)).otherwise(price)
    return t.scan("lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("entity_id"), kind.alias("type"), event.alias("event"),
        test.alias("test"), raw.alias("raw"),
    )


SQL_ASSAY = """assay AS (SELECT l_orderkey, l_linenumber, l_suppkey AS entity_id,
  CASE l_returnflag WHEN 'A' THEN 'csf sample' WHEN 'N' THEN 'Plasma EDTA' ELSE 'Serum' END AS type,
  CASE l_linenumber WHEN 1 THEN 'Baseline' WHEN 2 THEN 'BL' WHEN 3 THEN 'Screening' ELSE 'V04' END AS event,
  CASE WHEN l_tax < 0.03 THEN 'NFL' WHEN l_tax < 0.06 THEN 'CSF Alpha-synuclein' ELSE 'Other' END AS test,
  CASE l_linestatus WHEN 'O' THEN '<' ELSE '' END || CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) AS VARCHAR) AS raw FROM lineitem)"""
SQL_ASSAY_WHERE = "regexp_matches(type, '(?i)CSF|Cerebrospinal') AND regexp_matches(event, '(?i)^BL$|Baseline|Screen') AND test IN ('NFL', 'CSF Alpha-synuclein')"


def baseline_assays(df: DataFrame, kind: str, tests: list[str]) -> DataFrame:
    return df.where(F.col("type").rlike(kind) & F.col("event").rlike(spec.ASSAY_BASELINE) & F.col("test").isin(tests))


CSF = "(?i)CSF|Cerebrospinal"
PLASMA = "(?i)Plasma"
ASSAY_TESTS = ["NFL", "CSF Alpha-synuclein"]


@query("assay_type_event_filter", f"WITH {SQL_ASSAY} SELECT l_orderkey, l_linenumber, test FROM assay WHERE {SQL_ASSAY_WHERE}")
def assay_type_event_filter(t: Tables) -> DataFrame:
    return baseline_assays(assay_rows(t), CSF, ASSAY_TESTS).select("l_orderkey", "l_linenumber", "test")


def unit_key(code: Column, unit: Column) -> Column:
    return F.concat_ws("__", code, F.nullif(F.trim(unit), F.lit("")))


@query("unit_qualified_key", """SELECT event_id, CASE WHEN value > 50 THEN event_type || '__mg' ELSE event_type END AS feature FROM events""")
def unit_qualified_key(t: Tables) -> DataFrame:
    v = F.col("value")
    unit = F.when(v > 50, "mg").when(v > 20, "")
    return t.scan("events").select("event_id", unit_key(F.col("event_type"), unit).alias("feature"))


@query("clean_column_name", """SELECT user_id, max(value) FILTER (event_type = 'click') AS evt_click_x, max(value) FILTER (event_type = 'view') AS evt_view_x
  FROM events GROUP BY user_id""")
def clean_column_name(t: Tables) -> DataFrame:
    ev = t.scan("events").groupBy("user_id").agg(
        *[F.max(F.when(F.col("event_type") == k, F.col("value"))).alias(f"evt {k}-x") for k in ("click", "view")]
    )
    return clean_column_names(ev)


@query("vital_unit_repair", """WITH c AS (SELECT event_id, CASE WHEN value > 90 THEN (value - 32) * 5.0 / 9.0 ELSE value END AS t, value AS h FROM events)
SELECT event_id, round(CASE WHEN (t > 42 AND t <= 90) OR t > 100 THEN NULL ELSE t END, 6) AS TEMPC,
  round(CASE WHEN h > 50 AND h < 100 THEN h * 2.54 WHEN h <= 50 THEN NULL ELSE h END, 6) AS HTCM FROM c""")
def vital_unit_repair(t: Tables) -> DataFrame:
    v = t.scan("events").select("event_id", F.col("value").alias("TEMPC"), F.col("value").alias("HTCM"))
    out = cleaning.add_derived(v, "vital_signs")
    return out.select("event_id", rnd("TEMPC").alias("TEMPC"), rnd("HTCM").alias("HTCM"))


_VITALS_SQL = """v AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_returnflag = 'R' THEN 0.0 WHEN l_linenumber = 1 THEN NULL ELSE l_quantity + 90 END AS SYSSUP,
  CASE WHEN l_returnflag = 'R' THEN 0.0 WHEN l_linenumber = 1 THEN NULL ELSE l_quantity + 50 END AS DIASUP,
  CASE WHEN l_returnflag = 'R' THEN 0.0 WHEN l_linenumber <= 2 THEN NULL ELSE l_quantity + 40 END AS HRSUP,
  CASE WHEN l_linestatus = 'O' THEN 0.0 ELSE l_quantity + 80 END AS SYSSTND, CASE WHEN l_linestatus = 'O' THEN 0.0 ELSE l_quantity + 45 END AS DIASTND,
  CASE WHEN l_linestatus = 'O' THEN 0.0 ELSE l_quantity + 60 END AS HRSTND FROM lineitem),
f AS (SELECT *, coalesce(SYSSUP = 0 AND DIASUP = 0 AND HRSUP = 0, false) AS sz, SYSSTND = 0 AND DIASTND = 0 AND HRSTND = 0 AS tz,
  coalesce(SYSSUP, DIASUP, HRSUP) IS NOT NULL AS seen FROM v),
z AS (SELECT l_orderkey, l_linenumber, CASE WHEN NOT (sz AND tz) THEN SYSSUP END AS SYSSUP, CASE WHEN NOT (sz AND tz) THEN DIASUP END AS DIASUP,
  CASE WHEN NOT (sz AND tz) THEN HRSUP END AS HRSUP, CASE WHEN NOT (tz AND (sz OR seen)) THEN SYSSTND END AS SYSSTND,
  CASE WHEN NOT (tz AND (sz OR seen)) THEN DIASTND END AS DIASTND, CASE WHEN NOT (tz AND (sz OR seen)) THEN HRSTND END AS HRSTND FROM f)"""


def vitals(t: Tables) -> DataFrame:
    q, line = F.col("l_quantity"), F.col("l_linenumber")
    zero, off = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    cols = {n: F.when(zero, 0.0).when(line > cut, q + add) for n, cut, add in (("SYSSUP", 1, 90), ("DIASUP", 1, 50), ("HRSUP", 2, 40))}
    cols |= {n: F.when(off, 0.0).otherwise(q + add) for n, add in (("SYSSTND", 80), ("DIASTND", 45), ("HRSTND", 60))}
    return t.scan("lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in cols.items()])


@query("zero_vitals_to_null", f"WITH {_VITALS_SQL} SELECT * FROM z")
def zero_vitals_to_null(t: Tables) -> DataFrame:
    return cleaning.zero_vitals_to_null(vitals(t))


@query("derived_subscores", f"""WITH {_VITALS_SQL}, w AS (SELECT l_orderkey, {", ".join(f"max(l_quantity) FILTER (l_linenumber = {i}) AS i{i}" for i in (1, 2, 3))},
  min(l_quantity) AS MCATOT FROM lineitem GROUP BY l_orderkey),
 d AS (SELECT l_orderkey, max(SYSSUP - SYSSTND) AS sys_drop, max(DIASUP - DIASTND) AS dia_drop FROM z GROUP BY l_orderkey)
SELECT l_orderkey, i1 + i2 + i3 AS PIGD_SUBSCORE, i1 + i2 AS DELAYED_RECALL_SUM, CAST(MCATOT < 26 AS DOUBLE) AS MCI_FLAG, sys_drop, dia_drop
FROM w JOIN d USING (l_orderkey)""")
def derived_subscores(t: Tables) -> DataFrame:
    li = t.scan("lineitem", ["l_orderkey", "l_linenumber", "l_quantity"])
    item = {i: F.max(F.when(F.col("l_linenumber") == i, F.col("l_quantity"))) for i in (1, 2, 3)}
    wide = li.groupBy("l_orderkey").agg(
        *[item[i].alias(c) for i, c in zip((1, 2, 3), spec.PIGD_ITEMS)], item[1].alias("MCAREC1"), item[2].alias("MCAREC2"),
        F.min("l_quantity").alias("MCATOT"),
    )
    wide = cleaning.add_derived(cleaning.add_derived(wide, "updrs3"), "moca")
    drops = cleaning.add_derived(vitals(t), "vital_signs").groupBy("l_orderkey").agg(
        F.max("ORTHO_SYS_DROP").alias("sys_drop"), F.max("ORTHO_DIA_DROP").alias("dia_drop")
    )
    return wide.join(drops, "l_orderkey").select("l_orderkey", "PIGD_SUBSCORE", "DELAYED_RECALL_SUM", "MCI_FLAG", "sys_drop", "dia_drop")


@query("baseline_preferred_row", f"""WITH {SQL_RAW} SELECT entity_id, event_id, order_id, TOTAL FROM raw_orders WHERE event_id IN ('SC', 'BL')
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY CASE event_id WHEN 'BL' THEN 0 ELSE 1 END, order_id) = 1""")
def baseline_preferred_row(t: Tables) -> DataFrame:
    rows = Panel(t).raw_orders.where(F.col("event_id").isin("SC", "BL")).select("entity_id", "event_id", "order_id", "TOTAL")
    rank = F.when(F.col("event_id") == "BL", 0).otherwise(1)
    return cleaning.first_per_key(rows, ["entity_id"], rank, F.col("order_id"))


@query("raw_target_copies", f"""WITH {SQL_TASKS} SELECT v.task_key, p.entity_id, '__raw__' || p.visit || '__' || p.measure AS name, v.months, round(p.value, 4) AS value
  FROM task_visits v JOIN panel p ON p.visit = v.visit AND p.modality = v.target_modality AND p.measure = v.target_measure WHERE v.rule = 'level'""")
def raw_target_copies(t: Tables) -> DataFrame:
    p = Panel(t)
    names = F.broadcast(p.grid.where("rule = 'level'").select("task_key", "target_measure"))
    name = F.concat(F.lit("__raw__"), F.concat_ws("__", "visit", "target_measure"))
    return p.history.join(names, "task_key").select("task_key", "entity_id", name.alias("name"), "months", rnd("value", 4).alias("value"))


@query("feature_missing_filter", f"""WITH {SQL_FOLDS}, tr AS (SELECT f.task_key, k.fold, f.entity_id FROM folds f, (SELECT unnest(range(5)) AS fold) k
    WHERE f.seed = 0 AND f.fold <> k.fold),
  n AS (SELECT task_key, fold, count(*) AS n_train FROM tr GROUP BY ALL),
  c AS (SELECT task_key, fold, feature, count(value) AS n_value FROM tr JOIN features USING (task_key, entity_id) GROUP BY ALL)
SELECT task_key, CAST(fold AS INT) AS fold, feature, round(1 - n_value / n_train, 6) AS missing FROM c JOIN n USING (task_key, fold)
WHERE 1 - n_value / n_train < 0.9""")
def feature_missing_filter(t: Tables) -> DataFrame:
    from panelcast.operators import asks
    from panelcast.operators.normalise import missing_fractions

    p, seed = Panel(t), spec.CV_SEEDS[0]
    if p.side_by_side:
        miss = asks.missing(p.dealt_asks, p.panel, p.static, p.grid, p.name_list, p.asks, p.train_summary, seed)
    else:
        miss = missing_fractions(p.features, p.all_folds.where(F.col("seed") == seed))
    return miss.where(F.col("missing") < spec.MAX_MISSING).select("task_key", "fold", "feature", rnd("missing").alias("missing"))


@query("modality_columns", f"""WITH {SQL_TASKS}, m AS (SELECT DISTINCT task_key, feature, split_part(feature, '__', 1) AS modality FROM features)
SELECT a.task_key, a.modality AS dropped_modality, a.n AS n_dropped_features, t.n - a.n AS n_kept
FROM (SELECT task_key, modality, count(*) AS n FROM m GROUP BY ALL) a JOIN (SELECT task_key, count(*) AS n FROM m GROUP BY ALL) t USING (task_key)""")
def modality_columns(t: Tables) -> DataFrame:
    names = Panel(t).feature_cells.select("task_key", "feature")
    names = names.withColumn("dropped_modality", F.split("feature", "__")[0])
    per = names.groupBy("task_key", "dropped_modality").agg(F.count(F.lit(1)).alias("n_dropped_features"))
    total = names.groupBy("task_key").agg(F.count(F.lit(1)).alias("n"))
    return per.join(total, "task_key").select(
        "task_key", "dropped_modality", "n_dropped_features", (F.col("n") - F.col("n_dropped_features")).alias("n_kept")
    )


@query("nan_to_zero", f"WITH {SQL_PANEL} SELECT entity_id, visit, " + ", ".join(
    f"coalesce(round(max(value) FILTER (measure = '{m}'), 4), 0.0) AS {m}" for m in ["TOTAL", *ITEM_MEASURES]) + " FROM panel GROUP BY entity_id, visit")
def nan_to_zero(t: Tables) -> DataFrame:
    names = ["TOTAL", *ITEM_MEASURES]
    wide = reshape.pivot_values(Panel(t).panel, ["entity_id", "visit"], "measure", names)
    return wide.select("entity_id", "visit", *[F.coalesce(rnd(n, 4), F.lit(0.0)).alias(n) for n in names])
