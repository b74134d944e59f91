"""Calendar, targets, regimes and modality families as plain records.

Fixed values: visit codes and months, item lists, thresholds, seeds and grids are
given by the data format and the study design and must be exactly these.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: visit calendar -------------------------------------------------
VISIT_MONTHS = {
    "SC": -1, "BL": 0, "V01": 3, "V02": 6, "V03": 9, "V04": 12, "V05": 18,
    "V06": 24, "V07": 30, "V08": 36, "V09": 42, "V10": 48, "V11": 54, "V12": 60,
}
VISIT_ORDER = ["BL", "V02", "V04", "V06", "V08", "V10", "V12"]
HORIZONS = ["V04", "V06", "V08", "V10"]
ALLOWED_EVENTS = "^(SC|BL|V02|V04|V05|V06|V07|V08|V09|V10|V12)$"
BASELINE_EVENTS = "^(SC|BL)$"

# --- fixed values: cross-validation and test design -------------------------------
CV_SEEDS = [0, 42, 123, 2024, 7]
N_FOLDS = 5
N_INNER_FOLDS = 3
N_STRATA = 5
WINSOR = (0.005, 0.995)
Z_CLIP = 8.0
MAX_MISSING = 0.9
MAX_ORDINAL_LEVELS = 12
N_PERMUTATIONS = 5000
N_BOOTSTRAP = 2000
ALPHA = 0.05
TEST_SEED = 42
WORSEN_THRESHOLD = 5
IMPAIRMENT_CUTOFF = 26
MIN_N_WARNING = 50

# --- fixed values: columns of the source extract ----------------------------------
NA_TOKENS = ["", "NA", "NaN", "nan", "N/A", "NULL", "null", ".", " "]
ID_CANDIDATES = ["PATNO", "SUBJECT", "SUBJECT_ID", "ID"]
EVENT_CANDIDATES = [
    "EVENT_ID", "EVENTID", "EVENT", "VISIT", "VISIT_ID", "VISITID",
    "VISCODE", "VISITCODE", "CLINICAL_EVENT",
]
ADMIN_COLUMNS = [
    "REC_ID", "EVENT_ID", "PAG_NAME", "INFODT", "ORIG_ENTRY", "LAST_UPDATE",
    "NUPSOURC", "PDSTATE", "PDTRTMNT", "HRPOSTMED", "HRDBSON", "HRDBSOFF",
    "PDMEDYN", "DBSYN", "ONOFFORDER", "OFFEXAM", "OFFNORSN", "DBSOFFYN",
    "DBSOFFTM", "ONEXAM", "ONNORSN", "HIFUYN", "DBSONYN", "DBSONTM",
    "PDMEDDT", "PDMEDTM", "EXAMDT", "EXAMTM",
]
SENTINEL = 101
TREMOR_ITEMS = [
    "NP3PTRMR", "NP3PTRML", "NP3KTRMR", "NP3KTRML", "NP3RTARU",
    "NP3RTALU", "NP3RTARL", "NP3RTALL", "NP3RTALJ", "NP3RTCON",
]
PIGD_ITEMS = ["NP3GAIT", "NP3FRZGT", "NP3PSTBL"]
BRADY_ITEMS = [
    "NP3FTAPR", "NP3FTAPL", "NP3HMOVR", "NP3HMOVL", "NP3PRSPR", "NP3PRSPL",
    "NP3TTAPR", "NP3TTAPL", "NP3LGAGR", "NP3LGAGL", "NP3BRADY",
]
ASSAY_BASELINE = "(?i)^BL$|Baseline|Screen"

# --- fixed values: hyper-parameter grids ------------------------------------------
GRIDS = {
    "ridge": {"alpha": [10 ** (-2 + 7 * i / 14) for i in range(15)]},
    "elastic_net": {
        "alpha": [10 ** (-2 + 5 * i / 10) for i in range(11)],
        "l1_ratio": [0.1, 0.5, 0.9, 0.95, 1.0],
    },
    "random_forest": {
        "n_estimators": [200, 500, 800, 1000],
        "max_depth": [8, 12, 16, None],
        "min_samples_leaf": [1, 3, 5, 10],
    },
    "boosted_trees": {
        "n_estimators": [200, 500, 800, 1000],
        "max_depth": [3, 4, 6, 8],
        "learning_rate": [0.005, 0.01, 0.05, 0.1],
    },
    "logistic_regression": {"C": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]},
}
N_RANDOM_SEARCH = 15
FIXED_PARAM_KEYS = [
    "random_state", "verbosity", "max_iter", "n_jobs", "class_weight",
    "scale_pos_weight", "tree_method", "device", "subsample",
    "colsample_bytree", "max_features",
]
REGIME_PAIRS = [
    ("rolling", "baseline_only"),
    ("baseline_plus_12m", "baseline_only"),
    ("rolling", "baseline_plus_12m"),
]


@dataclass(frozen=True)
class TargetSpec:
    name: str
    domain: str
    modality: str
    measure: str
    task_type: str = "regression"
    rule: str = "level"  # level | worsen | rank
    threshold: float = 0.0
    min_patients: int = 60

    @property
    def primary_metric(self) -> str:
        return {"regression": "r2", "classification": "auprc", "ranking": "spearman"}[self.task_type]


@dataclass(frozen=True)
class RegimeSpec:
    name: str
    visits: tuple[str, ...] | None  # None: every visit before the horizon
    multimodal: bool = True


REGIMES = [
    RegimeSpec("baseline_only", ("BL",), multimodal=False),
    RegimeSpec("baseline_multimodal", ("BL",)),
    RegimeSpec("baseline_plus_12m", ("BL", "V02", "V04")),
    RegimeSpec("rolling", None),
]

# The star-schema panel: customers followed over order years.
ORDER_TARGETS = [
    TargetSpec("order_total", "value", "orders", "TOTAL"),
    TargetSpec("item_price", "value", "lineitem", "PRICE"),
    TargetSpec("item_quantity", "volume", "lineitem", "QUANTITY"),
    TargetSpec("item_discount", "terms", "lineitem", "DISCOUNT"),
    TargetSpec("total_worsen", "milestone", "orders", "TOTAL", "classification", "worsen", 50000.0),
    TargetSpec("low_quantity", "milestone", "lineitem", "LOW_QUANTITY", "classification"),
    TargetSpec("total_rank", "value", "orders", "TOTAL", "ranking", "rank"),
]
COHORT_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]


def calendar(spark: SparkSession) -> DataFrame:
    """calendar(visit, months, ord): the seven analysis visits."""
    rows = [(v, VISIT_MONTHS[v], i) for i, v in enumerate(VISIT_ORDER)]
    return spark.createDataFrame(rows, "visit string, months int, ord int").coalesce(1)


def task_grid(spark: SparkSession, targets=None, regimes=None, horizons=None) -> DataFrame:
    """One row per valid (target, regime, horizon): the horizon lies after the last history visit.

    The three tables have the size of the specification, so the product is one partition of broadcast loops.
    """
    target = spark.createDataFrame(
        [(t.name, t.domain, t.modality, t.measure, t.task_type, t.rule, float(t.threshold), t.min_patients, t.primary_metric) for t in targets or ORDER_TARGETS],
        "target string, domain string, target_modality string, target_measure string, task_type string, rule string, threshold double, min_patients int, primary_metric string",
    )
    regime = spark.createDataFrame(
        [(r.name, list(r.visits) if r.visits else None, r.multimodal, max([VISIT_MONTHS[v] for v in r.visits or []], default=0)) for r in regimes or REGIMES],
        "regime string, regime_visits array<string>, multimodal boolean, history_months int",
    )
    horizon = spark.createDataFrame([(h, VISIT_MONTHS[h]) for h in horizons or HORIZONS], "horizon string, horizon_months int")
    grid = target.coalesce(1).crossJoin(F.broadcast(regime.coalesce(1))).crossJoin(F.broadcast(horizon.coalesce(1)))
    grid = grid.where("horizon_months > history_months").drop("history_months")
    return grid.select(F.concat_ws("__", "target", "regime", "horizon").alias("task_key"), *grid.columns)
