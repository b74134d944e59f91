"""Tasks of one (target, horizon) beside each other: one row per entity serves all its regimes.

An ask is a (target, horizon) of the grid; its tasks differ only in the visits and modalities they may look at. An entity's
values are gathered once, everything about its tasks is computed from that row, and a row per task exists only in views.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from panelcast import spec
from panelcast.models import naive
from panelcast.operators import normalise, resample, tasks
from panelcast.operators.fold_metrics import SCORES, fold_means, pair_scores, ranks_in_order
from panelcast.operators.folds import task_strata
from panelcast.operators.order_stats import average_ranks, number_in_order

#: Features whose presence fits into one word of an entity.
BITS = 62
#: Bits of a task's fold; the folds of an ask's tasks in one seed are packed into one long.
PACK = 4


def ask_list(grid: DataFrame) -> list[dict]:
    """One record per (target, horizon), numbered in order, with its tasks in key order: a list of the specification's size."""
    visits: dict[str, set] = {}
    for r in tasks.history_visits(grid).select("task_key", "visit").collect():
        visits.setdefault(r.task_key, set()).add(r.visit)
    asks: dict[tuple, dict] = {}
    for i, r in enumerate(grid.orderBy("task_key").collect()):
        ask = asks.setdefault((r.target, r.horizon), {**r.asDict(), "tasks": []})
        ask["tasks"].append((i, r.task_key, r.task_type, r.multimodal, visits.get(r.task_key, set()), r.min_patients))
    return [ask | {"ask_no": n} for n, (_, ask) in enumerate(sorted(asks.items()))]


def width(asks: Sequence[dict]) -> int:
    return max((len(a["tasks"]) for a in asks), default=0)


def _slots(asks: Sequence[dict]) -> dict[tuple, int]:
    """The place of every asked (modality, measure)'s first visit in an entity's array of past values."""
    return {m: i * len(spec.VISIT_ORDER) for i, m in enumerate(sorted({(a["target_modality"], a["target_measure"]) for a in asks}))}


def feature_names(panel: DataFrame, static: DataFrame) -> DataFrame:
    """(code, feature, modality, visit, measure): every feature that occurs, in name order; undated ones have no visit."""
    dated = panel.select("modality", "visit", "measure").distinct()
    fixed = static.select("modality", F.lit(None).cast("string").alias("visit"), "measure").distinct()
    found = [(r.modality, r.visit, r.measure) for r in dated.unionByName(fixed).collect()]  # names of columns
    named = sorted((("__".join(x for x in f if x is not None), *f) for f in found), key=lambda f: (f[0], str(f)))
    rows = [(i, *f) for i, f in enumerate(named)]
    return panel.sparkSession.createDataFrame(rows, "code int, feature string, modality string, visit string, measure string").coalesce(1)


def entity_rows(panel: DataFrame, static: DataFrame, names: Sequence, asks: Sequence[dict]) -> DataFrame:
    """(entity_id, past, repeats, word_0 ...): an entity's values of the asked measures as an array in calendar order, its
    features as bits, and whether a feature occurs twice. A null value counts as a feature but not as measured.
    """
    first, visits = _slots(asks), {v: i for i, v in enumerate(spec.VISIT_ORDER)}
    codes = []
    for r in names:
        start = first.get((r.modality, r.measure)) if r.visit is not None else None
        slot = start + visits[r.visit] if start is not None and r.visit in visits else None
        codes.append((r.modality, r.visit, r.measure, r.code // BITS, 1 << r.code % BITS, slot))
    shape = "modality string, visit string, measure string, word int, bit bigint, slot int"
    lookup = panel.sparkSession.createDataFrame(codes, shape).coalesce(1)
    dated = panel.join(F.broadcast(lookup.where("visit is not null")), ["modality", "visit", "measure"])
    fixed = static.join(F.broadcast(lookup.where("visit is null").drop("visit")), ["modality", "measure"])
    cols = ["entity_id", "word", "bit", "slot", "value"]
    words = [F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(0)).alias(f"word_{w}") for w in range(_words(names))]
    size = len(first) * len(visits)
    past = [F.max(F.when(F.col("slot") == i, F.col("value"))).alias(f"_{i}") for i in range(size)]
    rows = dated.select(*cols).unionByName(fixed.select(*cols)).groupBy("entity_id").agg(F.count(F.lit(1)).alias("_n"), *words, *past)
    bits = sum((F.bit_count(f"word_{w}") for w in range(len(words))), F.lit(0))
    array = F.array(*[f"_{i}" for i in range(size)]) if size else F.array().cast("array<double>")
    return rows.select("entity_id", array.alias("past"), (F.col("_n") > bits).alias("repeats"), *[f"word_{w}" for w in range(len(words))])


def _words(names: Sequence) -> int:
    return max(1, -(-len(names) // BITS))


def _sees(task: tuple, name, modality: str) -> bool:
    _, _, _, multimodal, visits, _ = task
    return (multimodal or name.modality == modality) and name.visit in visits if name.visit is not None else multimodal


def _ask_entities(table: pa.Table, rules: Sequence[dict], shape: pa.Schema) -> pa.Table:
    """Rows of :func:`asked_rows` for some entities, with the change in place of its rank."""
    column = table["past"].combine_chunks().flatten()
    known = column.is_valid().to_numpy(zero_copy_only=False).reshape(len(table), -1)
    past = column.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(table), -1)
    words = [table[n].to_numpy() for n in table.column_names if n.startswith("word_")]
    parts = []
    for r in rules:
        base, at = r["base"], r["at"]
        if r["rule"] == "level":
            y, there = past[:, at], known[:, at]
        else:
            y, there = past[:, at] - past[:, base], known[:, at] & known[:, base] & (at != base)
        if r["rule"] == "worsen":
            y = ((y >= r["threshold"]) | np.isnan(y)).astype(float)  # as in Spark, NaN is above all numbers
        rows = np.flatnonzero(there)
        bits, lasts = np.zeros(len(rows), dtype=np.int32), []
        for j, (masks, seen) in enumerate(zip(r["masks"], r["seen"])):
            hit = np.zeros(len(rows), dtype=bool)
            for word, mask in zip(words, masks):
                hit |= (word[rows] & mask) != 0
            bits |= hit.astype(np.int32) << j
            last, had = np.full(len(rows), np.nan), np.zeros(len(rows), dtype=bool)
            for i in seen:
                mine = known[rows, base + i]
                last, had = np.where(mine, past[rows, base + i], last), had | mine
            lasts.append(pa.array(last, mask=~had))
        lasts += [pa.nulls(len(rows), pa.float64())] * (sum(n.startswith("last_") for n in shape.names) - len(lasts))
        own = table.take(pa.array(rows))
        out = {n: own[n] for n in own.column_names if n != "past"} | {f"last_{j}": v for j, v in enumerate(lasts)}
        out |= {"ask_no": pa.array(np.full(len(rows), r["ask_no"], dtype=np.int32)), "y": pa.array(y[rows]), "bits": pa.array(bits)}
        parts.append(pa.table([out[n] for n in shape.names], names=shape.names).cast(shape))
    return pa.concat_tables(parts)


def asked_rows(entities: DataFrame, names: Sequence, asks: Sequence[dict]) -> DataFrame:
    """(ask_no, entity_id, y, repeats, word_0 ..., bits, last_0 ...): every target value with what its tasks see.

    Bit j of ``bits``: the entity has a feature of the ask's j-th task, whose latest value of the target's own measure is
    ``last_j``. A map over the entities, but for the ranks of changes.
    """
    most, words = width(asks), _words(names)
    first, visits = _slots(asks), {v: i for i, v in enumerate(spec.VISIT_ORDER)}
    rules = []
    for a in asks:
        base, masks = first[(a["target_modality"], a["target_measure"])], []
        for task in a["tasks"]:
            masks.append([0] * words)
            for r in names:
                if _sees(task, r, a["target_modality"]):
                    masks[-1][r.code // BITS] |= 1 << r.code % BITS
        seen = [sorted(visits[v] for v in task[4]) for task in a["tasks"]]
        own = {"base": base, "at": base + visits[a["horizon"]], "masks": masks, "seen": seen}
        rules.append(own | {k: a[k] for k in ("ask_no", "rule", "threshold")})
    cols = [F.lit(0).alias("ask_no"), "entity_id", F.lit(0.0).alias("y"), "repeats", *[f"word_{w}" for w in range(words)]]
    shape = entities.select(*cols, F.lit(0).alias("bits"), *[F.lit(None).cast("double").alias(f"last_{j}") for j in range(most)]).schema
    arrow = to_arrow_schema(shape)

    def of(own: list[dict]) -> DataFrame:
        def rows(batches):
            for batch in batches:
                if len(batch):
                    yield from _ask_entities(pa.Table.from_batches([batch]), own, arrow).to_batches()

        return entities.mapInArrow(rows, shape)

    plain, ranked = ([r for r in rules if (r["rule"] == "rank") is rank] for rank in (False, True))
    if not ranked:
        return of(plain)
    moved = of(ranked).withColumnRenamed("y", "delta")
    places = moved.join(average_ranks(moved, ["ask_no"], "delta", "y").drop("n"), ["ask_no", "delta"]).select(*shape.names)
    return of(plain).unionByName(places) if plain else places


def ask_table(spark, asks: Sequence[dict]) -> DataFrame:
    """(ask_no, target, horizon)."""
    return spark.createDataFrame([(a["ask_no"], a["target"], a["horizon"]) for a in asks], "ask_no int, target string, horizon string").coalesce(1)


def cells(asked: DataFrame, panel: DataFrame, static: DataFrame, grid: DataFrame, names: Sequence, asks: Sequence[dict]) -> DataFrame:
    """:func:`tasks.feature_cells` from :func:`asked_rows`: rows are counted by their pattern of features before features are told apart.

    Entities with a feature that occurs twice are counted by their rows.
    """
    spark, words = asked.sparkSession, [f"word_{w}" for w in range(_words(names))]
    where = ask_table(spark, asks)
    patterns = asked.where(~F.col("repeats")).groupBy("ask_no", *words).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y_sum"))
    shape = "feature string, modality string, visit string, word int, bit bigint"
    lookup = spark.createDataFrame([(r.feature, r.modality, r.visit, r.code // BITS, 1 << r.code % BITS) for r in names], shape).coalesce(1)
    own = F.lit(0).cast("bigint")
    for w, c in enumerate(words):
        own = F.when(F.col("word") == w, F.col(c)).otherwise(own)
    each = patterns.crossJoin(F.broadcast(lookup)).where(own.bitwiseAND(F.col("bit")) != 0)
    keys = ["target", "horizon", "feature", "modality", "visit"]
    counts = each.groupBy("ask_no", *keys[2:]).agg(F.sum("n").alias("n"), F.sum("y_sum").alias("y_sum"))
    counts = counts.join(F.broadcast(where), "ask_no").select(*keys, "n", "y_sum")
    out = tasks._seen_by_tasks(counts, grid).select("task_key", "feature", "modality", "visit", "n", "y_sum")
    again = asked.where("repeats")
    if again.isEmpty():
        return out
    values = again.join(F.broadcast(where), "ask_no").select("target", "horizon", "entity_id", "y")
    both = out.unionByName(tasks.feature_cells(panel, static, grid, values))
    return both.groupBy("task_key", "feature", "modality", "visit").agg(F.sum("n").alias("n"), F.sum("y_sum").alias("y_sum"))


def gate(asked: DataFrame, asks: Sequence[dict], min_total: int | None = None) -> DataFrame:
    """Rows whose ``bits`` keep only tasks that pass the size gate, as in :func:`tasks.size_gate`."""
    sizes = asked.groupBy("ask_no").agg(*[F.count_if(F.col("bits").bitwiseAND(F.lit(1 << j)) != 0).alias(f"n_{j}") for j in range(width(asks))])
    found = {r.ask_no: r for r in sizes.collect()}  # one row per ask
    keep = []
    for a in asks:
        need = [2 * task[5] if min_total is None else min_total for task in a["tasks"]]
        own = found.get(a["ask_no"])
        keep.append((a["ask_no"], sum(1 << j for j, n in enumerate(need) if own and own[f"n_{j}"] and own[f"n_{j}"] >= n)))
    kept = asked.sparkSession.createDataFrame(keep, "ask_no int, _keep int").coalesce(1)
    rows = asked.join(F.broadcast(kept), "ask_no").withColumn("bits", F.col("bits").bitwiseAND(F.col("_keep")))
    return rows.where("bits <> 0").drop("_keep", "repeats", *[c for c in asked.columns if c.startswith("word_")])


def by_task(rows: DataFrame, asks: Sequence[dict], cols: Sequence[str]) -> DataFrame:
    """One row per task of rows that hold the tasks of an ask beside each other; ``cols`` are named <col>_0, <col>_1 ... there.

    Folds, if there are any, are unpacked.
    """
    each = F.array(*[F.struct(F.lit(j).alias("_j"), *[F.col(f"{c}_{j}").alias(c) for c in cols]) for j in range(width(asks))])
    folds = [c for c in rows.columns if c.startswith("fold_")]
    long = rows.select("ask_no", "entity_id", "y", "bits", *folds, F.inline(each)).where("shiftright(bits, _j) % 2 = 1")
    long = long.withColumns({c: _unpacked(c) for c in folds}).join(F.broadcast(task_table(rows.sparkSession, asks)), ["ask_no", "_j"])
    return long.select("task_no", "task_key", "task_type", "entity_id", "y", *cols, *folds)


def task_table(spark, asks: Sequence[dict]) -> DataFrame:
    """(ask_no, _j, task_no, task_key, task_type): the j-th task of every ask."""
    keys = [(a["ask_no"], j, *t[:3]) for a in asks for j, t in enumerate(a["tasks"])]
    return spark.createDataFrame(keys, "ask_no int, _j int, task_no int, task_key string, task_type string").coalesce(1)


def _unpacked(fold: str) -> Column:
    return F.expr(f"cast(shiftright({fold}, {PACK} * _j) % {1 << PACK} as int)")


def largest_ask(rows: DataFrame) -> int:
    return rows.groupBy("ask_no").count().agg(F.max("count")).first()[0] or 0


def _floats(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values with NaN for null, and which are null."""
    column = table[name].combine_chunks()
    return column.fill_null(np.nan).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def deal_ask(table: pa.Table, classes: set[int], seeds: Sequence[int], k: int, most: int, shape: pa.Schema) -> pa.Table:
    """Strata and folds of an ask's tasks, as in ``folds.deal_task``; tasks with the same entities are dealt once."""
    y, null = _floats(table, "y")
    y, bits = np.where(null, 0.0, y), table["bits"].to_numpy()
    is_class = table["ask_no"][0].as_py() in classes
    orders = [np.argsort(table[f"order_{s}"].to_numpy()) for s in seeds]
    out = {n: table[n] for n in shape.names if n in table.column_names}
    packed = [np.zeros(len(y), dtype=np.int64) for _ in seeds]
    done: list[tuple[np.ndarray, list]] = []
    for j in range(most):
        own = (bits >> j & 1).astype(bool)
        made = next((m for o, m in done if np.array_equal(o, own)), None)
        if made is None:
            stratum = np.full(len(y), -1, dtype=np.int32)
            stratum[own] = task_strata(y[own], null[own], is_class)
            values, made = np.unique(stratum[own]), [stratum]
            for order in orders:
                fold, sorted_ = np.zeros(len(y), dtype=np.int64), stratum[order]
                mine = own[order]
                for v in values:
                    rows = order[mine & (sorted_ == v)]
                    fold[rows] = np.arange(len(rows)) % k
                made.append(fold)
            done.append((own, made))
        out[f"stratum_{j}"] = pa.array(made[0], mask=~own)
        for into, fold in zip(packed, made[1:]):
            into |= fold << PACK * j
    out |= {f"fold_{s}": pa.array(p) for s, p in zip(seeds, packed)}
    return pa.table([out[n] for n in shape.names], names=shape.names).cast(shape)


def dealt(rows: DataFrame, entities: DataFrame, asks: Sequence[dict], seeds: Sequence[int], k: int = spec.N_FOLDS) -> DataFrame:
    """``rows`` of :func:`gate` with stratum_<j> of every task and fold_<seed>, the folds of its tasks packed.

    An entity is hashed and numbered once per seed; an ask moves once, whatever the number of its regimes.
    """
    most = width(asks)
    if k > 1 << PACK or most * PACK > 63:
        raise ValueError(f"{k} folds of {most} tasks do not fit into a long")
    each = entities.select("entity_id").withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    hashed = F.md5(F.concat_ws("|", F.col("seed"), F.col("entity_id")))
    numbered = number_in_order(each.withColumn("_h", hashed), ["seed"], "_h", "entity_id", "_pos")
    wide = numbered.groupBy("entity_id").agg(*[F.max(F.when(F.col("seed") == s, F.col("_pos"))).alias(f"order_{s}") for s in seeds])
    classes = {a["ask_no"] for a in asks if a["task_type"] == "classification"}
    extra = [F.lit(None).cast("int").alias(f"stratum_{j}") for j in range(most)]
    extra += [F.lit(0).cast("bigint").alias(f"fold_{s}") for s in seeds]
    shape = rows.select("*", *extra).schema
    arrow = to_arrow_schema(shape)
    return rows.join(wide, "entity_id").groupBy("ask_no").applyInArrow(lambda table: deal_ask(table, classes, seeds, k, most, arrow), shape)


def summary(rows: DataFrame, asks: Sequence[dict], seeds: Sequence[int]) -> DataFrame:
    """:func:`naive.dealt_summary` of rows of :func:`dealt`; sums are taken under numbers of tasks and folds."""
    names = [f"fold_{s}" for s in seeds]
    long = rows.select("ask_no", "y", naive.exact().alias("_s"), "bits", *names).select("*", F.explode(F.array(*[F.lit(j) for j in range(width(asks))])).alias("_j"))
    long = long.where("shiftright(bits, _j) % 2 = 1").withColumns({c: _unpacked(c) for c in names})
    sums = long.groupBy("ask_no", "_j", *names).agg(*naive.sums(F.col("_s")))
    return naive.summary_of(sums.join(F.broadcast(task_table(rows.sparkSession, asks)), ["ask_no", "_j"]), seeds)


def _in_order(v: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Places of the known values of ``v`` among ``own``, by value."""
    own = own[~np.isnan(v[own])]
    return own[np.argsort(v[own], kind="stable")]


def _fold(table: pa.Table, seed: int, j: int) -> np.ndarray:
    return table[f"fold_{seed}"].to_numpy() >> PACK * j & (1 << PACK) - 1


def _score_ask(table: pa.Table, keys: Mapping, means: Mapping[str, list], seen: set[str]) -> pa.Table:
    order, rows = _in_order(_floats(table, "y")[0], np.arange(len(table))), []
    y, bits = _floats(table, "y")[0][order], table["bits"].to_numpy()[order]
    place = np.empty(len(y), dtype=np.int64)
    for j, key in enumerate(keys[table["ask_no"][0].as_py()]):
        own = (bits >> j & 1).astype(bool)
        if not own.any() or key not in means:
            continue
        last, folds = _floats(table, f"last_{j}")[0][order], {}
        by_last = _in_order(last, np.flatnonzero(own))
        sorted_last = last[by_last]
        for seed, fold, train_mean in means[key]:
            mean = np.nan if train_mean is None else train_mean
            if seed not in folds:
                mine = np.where(own, _fold(table, seed, j)[order], -1)
                folds[seed] = mine, mine[by_last]
            at = np.flatnonzero(folds[seed][0] == fold)  # in the order of y
            if len(at) and not np.isnan(mean):
                rows.append((key, "population_mean", seed, fold, *pair_scores(y[at], np.full(len(at), mean))))
            if key not in seen:
                continue
            yhat = np.where(np.isnan(last[at]), mean, last[at])
            known = ~np.isnan(yhat)
            at, yhat = at[known], yhat[known]
            if not len(at):
                continue
            place[at] = np.arange(len(at))
            had = folds[seed][1] == fold
            guessed, cut = place[by_last[had]], np.searchsorted(sorted_last[had], mean)
            none = np.flatnonzero(np.isnan(last[at]))
            ranks = ranks_in_order(y[at], np.arange(len(at))), ranks_in_order(yhat, np.r_[guessed[:cut], none, guessed[cut:]])
            rows.append((key, "locf", seed, fold, *pair_scores(y[at], yhat, ranks)))
    names = [c.split()[0] for c in SCORES.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 5]
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _regression(rows: DataFrame, asks: Sequence[dict], seeds: Sequence[int], cols: Sequence[str], more: Sequence[str] = ()) -> tuple[DataFrame, dict]:
    keys = {a["ask_no"]: [t[1] for t in a["tasks"]] for a in asks if a["task_type"] == "regression"}
    names = [*more, *[f"{c}_{j}" for c in cols for j in range(width(asks))], *[f"fold_{s}" for s in seeds]]
    return rows.where(F.col("ask_no").isin(list(keys))).select("ask_no", "y", "bits", *names), keys


def ask_scores(rows: DataFrame, asks: Sequence[dict], summary: DataFrame, history_tasks: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """``fold_metrics.task_scores`` of rows of :func:`dealt`: an ask moves once, and a task's values are put in order once."""
    means, seen = fold_means(summary), {r.task_key for r in history_tasks.collect()}
    slim, keys = _regression(rows, asks, seeds, ["last"])
    return slim.groupBy("ask_no").applyInArrow(lambda table: _score_ask(table, keys, means, seen), SCORES)


def _context_ask(table: pa.Table, keys: Mapping, seeds: Sequence[int], k: int, probs: Sequence[float]) -> pa.Table:
    (y, _), bits, rows = _floats(table, "y"), table["bits"].to_numpy(), []
    for j, key in enumerate(keys[table["ask_no"][0].as_py()]):
        by_y = _in_order(y, np.flatnonzero(bits >> j & 1))
        for seed in seeds:
            folds = _fold(table, seed, j)[by_y]
            for fold in range(k):
                v = y[by_y[folds == fold]]
                if len(v):
                    spread = float(np.sqrt(np.mean((v - v.mean()) ** 2)))
                    rows.append((key, seed, fold, len(v), float(v.sum()), spread, float(v[-1] - v[0]), *[_quantile(v, q) for q in probs]))
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * (3 + len(probs))]
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f"c{i}" for i in range(len(kinds))])


def _quantile(ordered: np.ndarray, q: float) -> float:
    at = (len(ordered) - 1) * q
    lo, hi = int(np.floor(at)), int(np.ceil(at))
    return float(ordered[lo] if lo == hi or ordered[lo] == ordered[hi] else (hi - at) * ordered[lo] + (at - lo) * ordered[hi])


def target_spread(rows: DataFrame, asks: Sequence[dict], seeds: Sequence[int], probs: Mapping[str, float], k: int = spec.N_FOLDS) -> DataFrame:
    """(task_key, seed, fold, n, sum, std, range, quantiles ...) of y in every fold of the regression tasks; values of a task are sorted once."""
    slim, keys = _regression(rows, asks, seeds, [])
    names = ["task_key", "seed", "fold", "n", "sum", "std", "range", *probs]
    kinds = ["string", "int", "int", "bigint", *["double"] * (3 + len(probs))]
    wanted = list(probs.values())
    out = slim.groupBy("ask_no").applyInArrow(
        lambda table: _context_ask(table, keys, seeds, k, wanted), ", ".join(f"c{i} {t}" for i, t in enumerate(kinds))
    )
    return out.toDF(*names)


def _last_values(table: pa.Table, keys: Sequence[str], means: Mapping[str, list], seen: set[str]) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """{(task, seed): (y, last value or training mean)} of an ask's rows in their order, unknown pairs left out."""
    y, bits, out = _floats(table, "y")[0], table["bits"].to_numpy(), {}
    for j, key in enumerate(keys):
        if key not in seen or key not in means:
            continue
        own, last = (bits >> j & 1).astype(bool), _floats(table, f"last_{j}")[0]
        for seed in sorted({s for s, _, _ in means[key]}):
            by_fold = np.full(1 << PACK, np.nan)
            for s, fold, mean in means[key]:
                by_fold[fold] = mean if s == seed and mean is not None else by_fold[fold]
            yhat = np.where(np.isnan(last), by_fold[_fold(table, seed, j)], last)
            known = own & ~np.isnan(y) & ~np.isnan(yhat)
            if known.any():
                out[(key, seed)] = y[known], yhat[known]
    return out


def _bootstrap_ask(table: pa.Table, tasks_of: Mapping, means: Mapping[str, list], seen: set[str], score: resample.Scores, names: Sequence[str], edges: Sequence[int], seed: int, min_rows: int, columns: Sequence[str]) -> list[dict]:
    """``resample.drawn_rows`` of an ask's tasks and seeds for one block; equal values are drawn once, equal targets ranked once."""
    table = table.take(pa.array(np.argsort(table["order"].to_numpy()))).combine_chunks()
    pairs, ranks, out = _last_values(table, tasks_of[table["ask_no"][0].as_py()], means, seen), {}, []
    same: dict[bytes, list[tuple]] = {}
    for key, (y, yhat) in pairs.items():
        same.setdefault(hashlib.md5(y.tobytes() + b"|" + yhat.tobytes()).digest(), []).append(key)

    def scored(y: np.ndarray, yhat: np.ndarray):
        digest = hashlib.md5(y.tobytes()).digest()
        if digest not in ranks:
            ranks[digest] = resample.ranks_of(y)
        return score(y, yhat, ranks[digest])

    held: dict[tuple, tuple] = {}

    def flush() -> None:
        rows = resample.drawn_rows(held, scored, names, edges, table["_block"][0].as_py(), seed, min_rows, columns)
        for r in rows:
            mine = pairs[(r[columns[0]], r[columns[1]])]
            alike = same[hashlib.md5(mine[0].tobytes() + b"|" + mine[1].tobytes()).digest()]
            out.extend({**r, columns[0]: k[0], columns[1]: k[1]} for k in alike)
        held.clear()

    for key, *_ in same.values():
        if held and sum(len(v[2]) for v in held.values()) + len(pairs[key][0]) > resample.SHARED_ROWS:
            flush()
        held[key] = resample.coded(*pairs[key])
    if held:
        flush()
    return out


def bootstrap_last(
    rows: DataFrame, order: DataFrame, asks: Sequence[dict], summary: DataFrame, history_tasks: DataFrame, seeds: Sequence[int],
    score: resample.Scores, names: Sequence[str], n_boot: int = spec.N_BOOTSTRAP, seed: int = spec.TEST_SEED, min_rows: int = 10,
) -> DataFrame:
    """``resample.bootstrap_scores`` of the last value by (task_key, seed), from rows of :func:`dealt`: one row of an ask serves all its tasks
    and seeds. ``order`` is the place of an entity by the hash of ``seed``; it moves with its ask once for every block of repetitions.
    """
    means, seen = fold_means(summary), {r.task_key for r in history_tasks.collect()}
    slim, keys = _regression(rows.join(order, "entity_id"), asks, seeds, ["last"], ["order"])
    edges = resample.block_edges(n_boot, len(keys), 2 * rows.sparkSession.sparkContext.defaultParallelism)
    shape = StructType([StructField("task_key", StringType()), StructField("seed", IntegerType()), *resample.DRAWN])
    arrow = to_arrow_schema(shape)

    def drawn(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(_bootstrap_ask(table, keys, means, seen, score, names, edges, seed, min_rows, shape.names), schema=arrow)

    each = slim.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 2))))
    parts = each.repartition(4 * len(keys) * (len(edges) - 1), "ask_no", "_block").groupBy("ask_no", "_block").applyInArrow(drawn, shape)
    return resample.intervals(parts, ["task_key", "seed"])


def value_words(panel: DataFrame, static: DataFrame, names: Sequence) -> DataFrame:
    """(entity_id, twice, have_0 ...): an entity's features with a value as bits, and whether one of them has several."""
    codes = [(r.modality, r.visit, r.measure, r.code // BITS, 1 << r.code % BITS) for r in names]
    lookup = panel.sparkSession.createDataFrame(codes, "modality string, visit string, measure string, word int, bit bigint").coalesce(1)
    dated = panel.where("value is not null").join(F.broadcast(lookup.where("visit is not null")), ["modality", "visit", "measure"])
    fixed = static.where("value is not null").join(F.broadcast(lookup.where("visit is null").drop("visit")), ["modality", "measure"])
    words = [F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(0)).alias(f"have_{w}") for w in range(_words(names))]
    rows = dated.select("entity_id", "word", "bit").unionByName(fixed.select("entity_id", "word", "bit")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("_n"), *words)
    bits = sum((F.bit_count(f"have_{w}") for w in range(len(words))), F.lit(0))
    return rows.select("entity_id", (F.col("_n") > bits).alias("twice"), *[f"have_{w}" for w in range(len(words))])


def _held_counts(table: pa.Table, most: int, folds: int) -> list[tuple]:
    """(ask_no, task's place, fold, feature code, rows with a value) of some rows."""
    out, asked = [], table["ask_no"].to_numpy()
    words = np.column_stack([table[c].to_numpy() for c in table.column_names if c.startswith("have_")])
    have = (words[:, :, None] >> np.arange(BITS) & 1).reshape(len(words), -1).astype(np.float32)
    bits, packed = table["bits"].to_numpy(), table["fold"].to_numpy()
    for ask in np.unique(asked).tolist():
        at = np.flatnonzero(asked == ask)
        for j in range(most):
            own = at[bits[at] >> j & 1 > 0]
            fold = packed[own] >> PACK * j & (1 << PACK) - 1
            counts = (np.arange(folds)[:, None] == fold).astype(np.float32) @ have[own]
            out += [(ask, j, int(f), int(c), int(counts[f, c])) for f, c in zip(*np.nonzero(counts))]
    return out


def missing(
    rows: DataFrame, panel: DataFrame, static: DataFrame, grid: DataFrame, names: Sequence, asks: Sequence[dict], summary: DataFrame, seed: int, k: int = spec.N_FOLDS
) -> DataFrame:
    """``normalise.missing_fractions`` of one seed from rows of :func:`dealt`: values are counted by bits inside the tasks that hold the rows.

    Entities with a value that occurs several times are counted by their rows.
    """
    spark, have = rows.sparkSession, value_words(panel, static, names)
    most, where = width(asks), task_table(rows.sparkSession, asks)
    shape = "ask_no int, _j int, fold int, code int, c bigint"
    arrow = pa.schema([("ask_no", pa.int32()), ("_j", pa.int32()), ("fold", pa.int32()), ("code", pa.int32()), ("c", pa.int64())])

    def counted(batches):
        for batch in batches:
            if len(batch):
                found = _held_counts(pa.Table.from_batches([batch]), most, k)
                yield from pa.table([pa.array(c, t) for c, t in zip(list(zip(*found)) or [[]] * 5, arrow.types)], schema=arrow).to_batches()

    slim = rows.select("ask_no", "entity_id", "bits", F.col(f"fold_{seed}").alias("fold"))
    both = slim.join(have.where("not twice").drop("twice"), "entity_id").drop("entity_id")
    counts = both.mapInArrow(counted, shape).groupBy("ask_no", "_j", "fold", "code").agg(F.sum("c").alias("c"))
    features = {r.code: (r.feature, [(a["ask_no"], j) for a in asks for j, t in enumerate(a["tasks"]) if _sees(t, r, a["target_modality"])]) for r in names}
    seen = spark.createDataFrame([(ask, j, c, f) for c, (f, at) in features.items() for ask, j in at], "ask_no int, _j int, code int, feature string")
    counts = counts.join(F.broadcast(seen), ["ask_no", "_j", "code"]).join(F.broadcast(where), ["ask_no", "_j"]).select("task_key", "fold", "feature", "c")
    again = have.where("twice").select("entity_id")
    if not again.isEmpty():
        long = by_task(rows.join(again, "entity_id", "left_semi"), asks, []).select("task_key", "entity_id", F.col(f"fold_{seed}").alias("fold"))
        values = rows.join(again, "entity_id", "left_semi").join(F.broadcast(ask_table(spark, asks)), "ask_no").select("target", "horizon", "entity_id", "y")
        own = tasks.task_features(panel, static, grid, values).join(long, ["task_key", "entity_id"]).groupBy("task_key", "fold", "feature").agg(F.count("value").alias("c"))
        counts = counts.unionByName(own)
    held = counts.groupBy("task_key", "fold", "feature").agg(F.sum("c").alias("c"))
    total = held.groupBy("task_key", "feature").agg(F.sum("c").alias("tc"))
    sizes = summary.where(F.col("seed") == seed).select("task_key", "seed", "fold", "n_train")
    out = total.join(F.broadcast(sizes), "task_key").join(held, ["task_key", "fold", "feature"], "left")
    n = F.col("tc") - F.coalesce(F.col("c"), F.lit(0))
    return out.select("task_key", "seed", "fold", "feature", "n_train", n.alias("n_value"), (1 - n / F.col("n_train")).alias("missing")).where("n_value > 0")


#: Features that one Spark task puts in order and scales, for all regimes and folds of an ask.
COLUMNS = 8
NORMALISED = (
    "task_key string, seed int, fold int, feature string, kind string, mode double, lo double, hi double, median double, mean double, std double, kept boolean, "
    "is_test boolean, n bigint, s double, ss double, largest double"
)


def _normalise_ask(table: pa.Table, tasks_of: Mapping, columns: Mapping, seed: int, k: int) -> list[tuple]:
    """Rows of :func:`normalised` for some features of an ask."""
    flat = table["_x"].combine_chunks().flatten()
    x = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(table), -1)
    there, bits, out = flat.is_valid().to_numpy(zero_copy_only=False).reshape(x.shape), table["bits"].to_numpy(), []
    mine = [((bits >> j & 1).astype(bool), _fold(table, seed, j)) for j in range(len(tasks_of))]
    sizes = [[int((own & (fold == f)).sum()) for f in range(k)] for own, fold in mine]
    for c, (feature, seen) in columns.items():
        v, known = x[:, c], there[:, c]
        at = np.flatnonzero(known)
        at = at[np.argsort(v[at], kind="stable")]
        for j in seen:
            own, fold = mine[j]
            rows, ordered = np.flatnonzero(own), at[own[at]]
            for f in range(k):
                n_train = len(rows) - sizes[j][f]
                values = v[ordered[fold[ordered] != f]]
                if not sizes[j][f] or not len(values):
                    continue
                s, test, kept = normalise.value_stats(values), fold[rows] == f, normalise.is_kept(len(values), n_train)
                continuous = "mean" in s
                kind = "continuous" if continuous else "binary" if np.isin(values[[0, -1]], (0.0, 1.0)).all() and np.isin(values, (0.0, 1.0)).all() else "ordinal"
                stats = (tasks_of[j], seed, f, feature, kind, *(float(s[n]) if n in s else None for n in ("mode", "lo", "hi", "median", "mean", "std")), kept)
                z = normalise.scale_column(v[rows], known[rows], s) if kept else np.zeros(0)
                for is_test in (True, False):
                    part = z[test == is_test] if kept else z
                    if is_test or kept:
                        out.append((*stats, is_test, len(part), float(part.sum()), float(part @ part), float(np.abs(part).max(initial=0.0))))
    return out


def normalised(rows: DataFrame, panel: DataFrame, static: DataFrame, asks: Sequence[dict], seed: int, k: int = spec.N_FOLDS) -> DataFrame:
    """``normalise.fit`` of one seed with ``kept`` and, of the kept features, count, sums and largest of the normalised cells of test and training rows.

    From rows of :func:`dealt` of entities without repeated features. An entity's values are gathered once; a few columns of an
    ask move at a time and are put in order once for all its regimes and folds.
    """
    wide, known = tasks.entity_values(panel, static)
    size = 1 + max((i for i, _ in known), default=0)
    blocks = -(-size // COLUMNS)
    keys = {a["ask_no"]: [t[1] for t in a["tasks"]] for a in asks}
    columns: dict[tuple, dict] = {}
    for a in asks:
        for i, r in known:
            seen = [j for j, t in enumerate(a["tasks"]) if _sees(t, r, a["target_modality"])]
            if seen:
                columns.setdefault((a["ask_no"], i // COLUMNS), {})[i % COLUMNS] = (r.feature, seen)
    names = [c.split()[0] for c in NORMALISED.split(", ")]
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], NORMALISED).schema)

    def done(table: pa.Table) -> pa.Table:
        ask, block = table["ask_no"][0].as_py(), table["_block"][0].as_py()
        found = _normalise_ask(table, keys[ask], columns.get((ask, block), {}), seed, k)
        return pa.Table.from_pylist([dict(zip(names, r)) for r in found], schema=arrow)

    empty = F.array_repeat(F.lit(None).cast("double"), blocks * COLUMNS)
    values = F.slice(F.concat("_all", empty), 1, blocks * COLUMNS)
    slim = rows.select("ask_no", "entity_id", "bits", f"fold_{seed}").join(wide, "entity_id", "left").withColumn("_all", F.coalesce(values, empty))
    each = F.array(*[F.struct(F.lit(b).alias("_block"), F.slice("_all", b * COLUMNS + 1, COLUMNS).alias("_x")) for b in range(blocks)])
    moved = slim.select("ask_no", "bits", f"fold_{seed}", F.inline(each))
    return moved.groupBy("ask_no", "_block").applyInArrow(done, NORMALISED)
