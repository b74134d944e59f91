"""Resampling tests and false-discovery control.

Random draws are md5 streams of (seed, repetition, row), so any engine reproduces them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from panelcast import spec
from panelcast.operators.metrics import TINY, ratio
from panelcast.operators.order_stats import number_in_order
from panelcast.sources.stage import write_stage

Scores = Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray], dict[str, np.ndarray]]]
SLACK = 1e-12  # ties between a permuted and the observed mean survive float summation order


def coin(*parts: Column) -> Column:
    """True for half of the (seed, repetition, row) triples."""
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 1) < "8"


def draw(n: Column, *parts: Column) -> Column:
    """A 0-based index below n."""
    word = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")
    return word % n


def benjamini_hochberg(tests: DataFrame, p: str, out: str, family: Sequence[str] = ()) -> DataFrame:
    """Step-up adjusted p-values; null p stays null. A family holds one row per test, a spec-sized table."""
    fam = [F.lit(1).alias("_fam")] if not family else []
    rows = tests.select("*", *fam)
    by = list(family) or ["_fam"]
    seen = Window.partitionBy(*by, F.col(p).isNull())
    up = seen.orderBy(p)
    raw = F.col(p) * F.count(F.lit(1)).over(seen) / F.row_number().over(up)
    rows = rows.withColumn("_raw", F.when(F.col(p).isNotNull(), raw))
    # Equal p-values: the largest rank of the tie counts, hence a range frame from the current value on.
    tail = up.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    adjusted = F.least(F.lit(1.0), F.min("_raw").over(tail))
    rows = rows.withColumn(out, F.when(F.col(p).isNotNull(), adjusted))
    return rows.drop("_raw", "_fam")


def cohens_d_paired(d: Column) -> Column:
    """Mean over sample std of the differences; 0 when they do not vary."""
    flat = (F.count(d) < 2) | (F.stddev_pop(d) < TINY)
    return F.when(flat, 0.0).otherwise(ratio(F.avg(d), F.stddev_samp(d)))


def paired_tests(
    diffs: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    n_perm: int = spec.N_PERMUTATIONS,
    n_boot: int = spec.N_BOOTSTRAP,
    seed: int = spec.TEST_SEED,
) -> DataFrame:
    """Sign-flip test, bootstrap interval and effect size of the mean of ``d`` per key.

    The sign and draw tables have a slot for every position that occurs, so a key may
    hold any number of rows; their size is repetitions x the largest key.
    """
    keys = list(keys)
    rows = diffs.where(F.col("d").isNotNull())
    w = Window.partitionBy(*keys)
    rows = rows.select(
        *keys, "d", F.row_number().over(w.orderBy(*order)).alias("i"), F.count(F.lit(1)).over(w).alias("n")
    ).where("n >= 3")
    obs = rows.groupBy(*keys).agg(
        F.avg("d").alias("observed_diff"), cohens_d_paired(F.col("d")).alias("cohens_d"), F.max("n").alias("n_folds")
    )
    slots = rows.select("i").distinct()
    signs = slots.select("i", F.explode(F.sequence(F.lit(1), F.lit(n_perm)).cast("array<bigint>")).alias("perm"))
    signs = signs.withColumn("s", F.when(coin(F.lit(seed), F.col("perm"), F.col("i")), -1.0).otherwise(1.0))
    flipped = rows.join(signs, "i").groupBy(*keys, "perm").agg((F.sum(F.col("d") * F.col("s")) / F.max("n")).alias("m"))
    extreme = F.count_if(F.abs("m") >= F.abs("observed_diff") - SLACK)
    p = flipped.join(obs.select(*keys, "observed_diff"), keys).groupBy(*keys).agg(((extreme + 1) / (n_perm + 1)).alias("p_value"))
    sizes = rows.select("n").distinct()
    draws = sizes.select("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    draws = draws.select("n", "i", F.explode(F.sequence(F.lit(1), F.lit(n_boot)).cast("array<bigint>")).alias("boot"))
    draws = draws.select("boot", "n", (draw(F.col("n"), F.lit(seed), F.col("boot"), F.col("i")) + 1).cast("int").alias("i"))
    means = rows.join(draws, ["n", "i"]).groupBy(*keys, "boot").agg((F.sum("d") / F.max("n")).alias("m"))
    ci = means.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("ci_lo"), F.percentile("m", F.lit(0.975)).alias("ci_hi"))
    return obs.join(p, keys).join(ci, keys)


def draw_word(boot: Column, j: Column, seed: int) -> Column:
    """The number behind draw ``j`` of a repetition; one md5 holds the words of four draws in a row."""
    word = F.md5(F.concat_ws("|", F.lit(seed), boot, F.floor(j / 4).cast("bigint")))
    return F.conv(word.substr((j % 4 * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("bigint")


_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_PLACES = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]


def _md5(text: np.ndarray) -> np.ndarray:
    """Digests, 16 bytes a row, of rows of bytes: md5 of many short texts (under 56 bytes) of one length at once."""
    n, size = text.shape
    padded = np.zeros((n, 64), dtype=np.uint8)
    padded[:, :size], padded[:, size] = text, 128
    block = np.ascontiguousarray(padded.view("<u4").T)
    block[14] = 8 * size
    used = {*range(size // 4 + 1), 14}
    start = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(n, v) for v in start)
    f, turned = np.empty_like(a), np.empty_like(a)
    for i, (sine, turn, place) in enumerate(zip(_SINES, _TURNS, _PLACES)):
        if i < 16:
            np.bitwise_xor(d, np.bitwise_and(b, np.bitwise_xor(c, d, out=f), out=f), out=f)
        elif i < 32:
            np.bitwise_xor(c, np.bitwise_and(d, np.bitwise_xor(b, c, out=f), out=f), out=f)
        elif i < 48:
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
        else:
            np.bitwise_xor(c, np.bitwise_or(b, np.invert(d, out=f), out=f), out=f)
        a += f
        a += np.uint32(sine)
        if place in used:
            a += block[place]
        np.right_shift(a, np.uint32(32 - turn), out=turned)
        np.left_shift(a, np.uint32(turn), out=a)
        a |= turned
        a += b
        a, b, c, d = d, a, b, c
    return np.column_stack([v + first for v, first in zip((a, b, c, d), start)]).astype("<u4").view(np.uint8)


def _words(seed: int, boot: int, n: int) -> np.ndarray:
    """:func:`draw_word` of one repetition for draws below a multiple of four from ``n`` on."""
    parts, blocks, at = [], -(-n // 4), 0
    prefix = np.frombuffer(f"{seed}|{boot}|".encode(), np.uint8)
    while at < blocks:
        end = min(blocks, at + 8192, 10 ** len(str(at)))
        digits = [np.arange(at, end) // 10**i % 10 + 48 for i in reversed(range(len(str(at))))]
        text = np.column_stack([np.broadcast_to(prefix, (end - at, len(prefix))), *digits]).astype(np.uint8)
        parts.append(_md5(text).view(">u4").ravel())
        at = end
    return np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32)


#: Counts that are scored at once; they stay in a core's cache.
SCORED = 1 << 15


def coded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of values and, for every row, the number of its pair."""
    (_, x), (levels, z) = (np.unique(v, return_inverse=True) for v in (a, b))
    _, one, place = np.unique(x * len(levels) + z, return_index=True, return_inverse=True)
    return a[one], b[one], place.astype(np.min_scalar_type(len(one)))


def _drawn_scores(keyed: Mapping, score: Scores, boots: range, seed: int) -> dict:
    """{key: [scores of each repetition]} of {key: (first, second)}, arrays by place."""
    return _drawn_codes({k: coded(a, b) for k, (a, b) in keyed.items()}, score, boots, seed)


def _drawn_codes(keyed: Mapping, score: Scores, boots: range, seed: int) -> dict:
    """:func:`_drawn_scores` of {key: (first, second, number of the pair by place)}.

    The words of a repetition are made once for all keys, and its counts of places once for keys of equal size. Rows of a key
    with few different pairs of values are counted by pair.
    """
    sized: dict[int, list] = {}
    for key, (a, b, place) in keyed.items():
        pairs = (len(a), place, score(a, b)) if len(a) * 8 < len(place) else (len(place), None, score(a[place], b[place]))
        sized.setdefault(len(place), []).append((key, *pairs))
    out, longest = {k: [] for k in keyed}, max(sized, default=1)
    step = max(1, SCORED // longest)
    for first in range(boots.start, boots.stop, step):
        words = [_words(seed, boot, longest) for boot in range(first, min(first + step, boots.stop))]
        for n, members in sized.items():
            at = [(w[:n] % np.uint32(n)).astype(np.intp) for w in words]
            whole = None
            for key, size, place, scores in members:
                if place is not None:
                    w = np.array([np.bincount(np.take(place, i), minlength=size) for i in at], dtype=np.float64)
                elif whole is None:
                    w = whole = np.array([np.bincount(i, minlength=n) for i in at], dtype=np.float64)
                else:
                    w = whole
                out[key].append(scores(w))
    return out


class _Ties:
    """Weights of rows summed by the distinct values of ``values``, in ascending order."""

    def __init__(self, values: np.ndarray):
        _, self.place, counts = np.unique(values, return_inverse=True, return_counts=True)
        self.order, self.starts = np.argsort(self.place, kind="stable"), np.r_[0, np.cumsum(counts)[:-1]]

    def __call__(self, weights: np.ndarray) -> np.ndarray:
        ordered = np.take(weights, self.order, axis=1)
        return ordered if len(self.starts) == len(self.order) else np.add.reduceat(ordered, self.starts, axis=1)


def _spread(square: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Variance from the mean square and the mean; what is left of a constant by rounding is zero."""
    var = square - mean * mean
    return np.where(var <= 1e-12 * square, 0.0, var)


def score_moments(y: np.ndarray, yhat: np.ndarray, known: _Ranks | None = None) -> Callable[[np.ndarray], dict[str, np.ndarray]]:
    """R2, MAE, RMSE and Pearson of each row of draw counts, with the rules of :func:`metrics.regression_metrics`."""
    err, y, p = y - yhat, y - y.mean(), yhat - yhat.mean()
    terms = np.column_stack([np.ones(len(y)), np.abs(err), err * err, y, p, y * y, p * p, y * p])

    def scores(w: np.ndarray) -> dict[str, np.ndarray]:
        n, *sums = (w @ terms).T
        ae, ee, my, mp, yy, pp, yp = (v / n for v in sums)
        vy, vp = _spread(yy, my), _spread(pp, mp)
        with np.errstate(divide="ignore", invalid="ignore"):
            r2 = np.where(vy == 0, np.where(ee == 0, 1.0, 0.0), 1 - ee / vy)
            flat = (np.sqrt(vy) < TINY) | (np.sqrt(vp) < TINY)
            return {"r2": r2, "mae": ae, "rmse": np.sqrt(ee), "pearson": np.where(flat, 0.0, (yp - my * mp) / np.sqrt(vy * vp))}

    return scores


class _Ranks(_Ties):
    """Average ranks, less their mean, of the rows of each resample, and their variance; kept for the next key with the same values and draws."""

    def __init__(self, values: np.ndarray):
        super().__init__(values)
        self.values, self.of, self.kept = values, None, None

    def ranked(self, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.of is not w:
            tied = self(w)
            rank = np.cumsum(tied, axis=1)
            rank -= tied / 2 + n[:, None] / 2
            self.of, self.kept = w, (np.take(rank, self.place, axis=1), np.einsum("ij,ij,ij->i", tied, rank, rank) / n)
        return self.kept


def ranks_of(values: np.ndarray) -> _Ranks:
    """The ranks of values that several keys share."""
    return _Ranks(values)


def score_ranks(y: np.ndarray, yhat: np.ndarray, known: _Ranks | None = None) -> Callable[[np.ndarray], dict[str, np.ndarray]]:
    """Spearman of each row of draw counts: average ranks from running counts over the distinct values, less their mean.

    ``known`` are the ranks of ``y``, when the caller has them.
    """
    ties = [known or _Ranks(y), _Ranks(yhat)]

    def scores(w: np.ndarray) -> dict[str, np.ndarray]:
        n = w.sum(axis=1)
        (a, vx), (b, vp) = (tie.ranked(w, n) for tie in ties)
        ties[1].of = ties[1].kept = None
        with np.errstate(divide="ignore", invalid="ignore"):
            return {"spearman": np.where((vx < TINY) | (vp < TINY), 0.0, np.einsum("ij,ij,ij->i", w, a, b) / n / np.sqrt(vx * vp))}

    return scores


def score_regression(y: np.ndarray, yhat: np.ndarray, known: _Ranks | None = None) -> Callable[[np.ndarray], dict[str, np.ndarray]]:
    """All five regression scores of each row of draw counts."""
    moments, ranks = score_moments(y, yhat), score_ranks(y, yhat, known)
    return lambda w: moments(w) | ranks(w)


def score_classes(y: np.ndarray, prob: np.ndarray) -> Callable[[np.ndarray], dict[str, np.ndarray]]:
    """AUROC and average precision of each row of draw counts; NaN where a resample has one class only."""
    tie = _Ties(prob)

    def scores(w: np.ndarray) -> dict[str, np.ndarray]:
        pos, neg = tie(w * y), tie(w * (1 - y))
        p, m = pos.sum(axis=1), neg.sum(axis=1)
        area = (pos * (np.cumsum(neg, axis=1) - neg / 2)).sum(axis=1)
        hit, seen = (np.cumsum(x[:, ::-1], axis=1)[:, ::-1] for x in (pos, pos + neg))
        with np.errstate(divide="ignore", invalid="ignore"):
            steps = np.where(seen > 0, pos * hit / seen, 0.0).sum(axis=1)
            one = (p == 0) | (m == 0)
            return {"auroc": np.where(one, np.nan, area / (p * m)), "auprc": np.where(one, np.nan, steps / p)}

    return scores


#: Rows of a key that one task resamples with draw counts (about 60 bytes a row); larger keys are drawn row by row.
DRAWN_ROWS = 10_000_000
#: Rows of several keys that meet in one task, so that they share the words of its draws.
SHARED_ROWS = 8_000_000
#: Rows that one task holds in the swaps of predictions.
TASK_ROWS = 200_000

def numbered(rows: DataFrame, keys: Sequence[str], ident: str, seed: int) -> DataFrame:
    """Rows with ``_pos``, the 0-based place by hash inside the key, and ``_n``, the size of the key."""
    hashed = rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col(ident))))
    placed = number_in_order(hashed, list(keys), "_h", ident, "_pos").drop("_h")
    return placed.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), list(keys))


def bootstrap_rows(placed: DataFrame, keys: Sequence[str], n_boot: int, seed: int = spec.TEST_SEED) -> DataFrame:
    """Every key of :func:`numbered` rows drawn n_boot times with replacement, as (keys, boot, columns).

    The draws follow from the rows themselves, so no key is gathered in one task.
    """
    keys = list(keys)
    boots = F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("boot")
    drawn = placed.select(*keys, "_pos", "_n", boots)
    drawn = drawn.select(*keys, "boot", (draw_word(F.col("boot"), F.col("_pos"), seed) % F.col("_n")).alias("_pos"))
    return drawn.join(placed.drop("_n"), [*keys, "_pos"]).drop("_pos")


def bootstrap_scores(
    rows: DataFrame,
    keys: Sequence[str],
    ident: str,
    columns: Sequence[str],
    score: Scores,
    spread: Callable[[DataFrame, Sequence[str]], DataFrame],
    names: Sequence[str],
    n_boot: int = spec.N_BOOTSTRAP,
    seed: int = spec.TEST_SEED,
    min_rows: int = 10,
    task_rows: int = DRAWN_ROWS,
) -> DataFrame:
    """(keys, metric, point, mean, ci_lo, ci_hi, se) of ``names`` over row-level resamples with replacement.

    Rows are packed in hash order, a few bytes each. Keys of up to ``task_rows`` rows are dealt by their size to groups of about
    ``SHARED_ROWS`` rows, and a group to some tasks by blocks of repetitions: a task counts how often each row is drawn and ``score`` gives the metrics of its resamples from those
    counts. Larger keys are drawn as rows, and ``spread(rows, keys)`` scores them in Spark; both ways make the same draws.
    ``point`` is the score of the rows themselves. Rows with a null in ``columns`` are left out, undefined resamples are
    skipped, keys under ``min_rows`` rows have nulls, and null keys are left out.
    """
    keys, (first, second) = list(keys), columns
    rows = rows.where(F.col(first).isNotNull() & F.col(second).isNotNull()).dropna(subset=keys)
    rows = rows.select(*keys, ident, F.col(first).cast("double").alias(first), F.col(second).cast("double").alias(second))
    packed = write_stage(_packed(rows, keys, ident, first, second, seed), "packed")
    sizes = packed.groupBy(*keys).agg(F.sum("n").alias("_n"))
    here = F.col("_n") <= task_rows
    total, kinds, largest = sizes.agg(F.sum(F.when(here, F.col("_n"))), F.countDistinct(F.when(here, F.col("_n"))), F.max("_n")).first()
    groups = max(1, min(kinds, -(-(total or 0) // SHARED_ROWS)))
    edges = block_edges(n_boot, groups, rows.sparkSession.sparkContext.defaultParallelism)
    shape = StructType([*[rows.schema[k] for k in keys], *DRAWN])
    arrow = to_arrow_schema(shape)

    def resampled(table: pa.Table) -> pa.Table:
        block = table["_block"][0].as_py()
        spans: dict[tuple, list] = {}
        for r in table.sort_by("_bucket").to_batches(max_chunksize=64):
            columns = {c: r.column(c) for c in r.schema.names}
            for i in range(len(r)):
                codes = np.frombuffer(columns["codes"][i].as_buffer(), CODES[columns["width"][i].as_py()])
                spans.setdefault(tuple(columns[k][i].as_py() for k in keys), []).append((*(columns[c][i].values.to_numpy() for c in ("a", "b")), codes))
        keyed = {k: _joined(parts) for k, parts in spans.items()}
        return pa.Table.from_pylist(drawn_rows(keyed, score, names, edges, block, seed, min_rows, shape.names), schema=arrow)

    dealt = packed.join(sizes.where(here), keys).withColumn("_group", F.pmod(F.xxhash64("_n"), F.lit(groups))).drop("_n", "n")
    dealt = dealt.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 2))))
    done = intervals(dealt.repartition(groups * (len(edges) - 1), "_group", "_block").groupBy("_group", "_block").applyInArrow(resampled, shape), keys)
    if (largest or 0) <= task_rows:
        return done
    stats = ["point", "mean", "ci_lo", "ci_hi", "se"]
    large = rows.join(sizes.where(~here).drop("_n"), keys, "left_semi")
    large = write_stage(numbered(large, keys, ident, seed).drop(ident), "placed")
    drawn = write_stage(bootstrap_rows(large, keys, n_boot, seed), "draws")
    long = spread(drawn, [*keys, "boot"]).unpivot([*keys, "boot"], list(names), "metric", "value").where("value is not null")
    agg = long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.percentile("value", F.lit(0.025)).alias("ci_lo"),
        F.percentile("value", F.lit(0.975)).alias("ci_hi"), F.stddev_pop("value").alias("se"),
    )
    points = spread(large, keys).unpivot(keys, list(names), "metric", "point")
    return done.unionByName(points.join(agg, [*keys, "metric"], "left").select(*keys, "metric", *stats))


#: What a task hands on: scores of its block of repetitions, and of the rows themselves from the first block.
DRAWN = [StructField("metric", StringType()), StructField("_point", DoubleType()), StructField("_drawn", ArrayType(DoubleType()))]
CODES = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}
#: Rows of a key and range of hashes that one task puts in order.
PACKED_ROWS = 500_000


def _packed(rows: DataFrame, keys: Sequence[str], ident: str, first: str, second: str, seed: int) -> DataFrame:
    """(keys, _bucket, n, a, b, width, codes): rows of a key in hash order, by ranges of hashes, as numbers of their different pairs.

    A row moves once, with 16 bytes of hash, and is stored as a number of as few bytes as the pairs of its range need.
    """
    chars = -(-max(0, (rows.count() // PACKED_ROWS).bit_length()) // 4)
    hashed = F.md5(F.concat_ws("|", F.lit(seed), F.col(ident)))
    bucket = F.conv(F.substring(hashed, 1, chars), 16, 10).cast("int") if chars else F.lit(0)
    moved = rows.select(*keys, bucket.alias("_bucket"), F.unhex(hashed).alias("_h"), first, second)
    shape = StructType([*[rows.schema[k] for k in keys], *rows.sparkSession.createDataFrame([], "_bucket int, n bigint, a array<double>, b array<double>, width int, codes binary").schema])
    arrow = to_arrow_schema(shape)

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("_h")
        a, b, place = coded(table[first].to_numpy(), table[second].to_numpy())
        row = [*(table[k][0].as_py() for k in keys), table["_bucket"][0].as_py(), len(table), a, b, place.itemsize, place.tobytes()]
        return pa.Table.from_pylist([dict(zip(arrow.names, row))], schema=arrow)

    return moved.groupBy(*keys, "_bucket").applyInArrow(packed, shape)


def _joined(parts: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coded rows of several ranges, in order, as those of one."""
    a, b, code = coded(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
    starts = np.cumsum([0, *(len(p[0]) for p in parts[:-1])])
    return a, b, np.concatenate([code[at : at + len(p[0])][p[2]] for at, p in zip(starts, parts)])


def block_edges(n_boot: int, groups: int, cores: int) -> list[int]:
    """The repetitions of each block: two tasks a core, as the rows of a group move once for every block."""
    blocks = max(1, min(n_boot, -(-2 * cores // groups)))
    return [1 + n_boot * i // blocks for i in range(blocks + 1)]


def drawn_rows(keyed: Mapping, score: Scores, names: Sequence[str], edges: Sequence[int], block: int, seed: int, min_rows: int, columns: Sequence[str]) -> list[dict]:
    """Rows (key, metric, _point, _drawn) of one block of repetitions; keys under ``min_rows`` rows have nulls."""
    boots = range(edges[block], edges[block + 1])
    drawn = _drawn_codes({k: v for k, v in keyed.items() if len(v[2]) >= min_rows}, score, boots, seed)
    out = []
    for key, (a, b, place) in keyed.items():
        point = score(a[place], b[place])(np.ones((1, len(place)))) if boots.start == 1 and key in drawn else {}
        for m in names:
            own = float(point[m][0]) if m in point and not np.isnan(point[m][0]) else None
            values = np.concatenate([p[m] for p in drawn[key]]) if key in drawn else np.zeros(0)
            out.append(dict(zip(columns, [*key, m, own, values[~np.isnan(values)]])))
    return out


def intervals(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, metric, point, mean, ci_lo, ci_hi, se) from the :data:`DRAWN` rows of all blocks."""
    all_drawn = parts.groupBy(*keys, "metric").agg(F.max("_point").alias("point"), F.flatten(F.collect_list("_drawn")).alias("_drawn"))
    values = all_drawn.select(*keys, "metric", "point", F.explode_outer("_drawn").alias("value"))
    return values.groupBy(*keys, "metric").agg(
        F.max("point").alias("point"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.025)).alias("ci_lo"),
        F.percentile("value", F.lit(0.975)).alias("ci_hi"), F.stddev_pop("value").alias("se"),
    )


def row_signs(idents: Sequence[str], n_perm: int, seed: int) -> np.ndarray:
    """(row, permutation) bits; 1 swaps the row. One md5 of (seed, block, row) holds 128 permutations, highest bit first."""
    blocks = range(-(-n_perm // 128))
    raw = b"".join(hashlib.md5(f"{seed}|{block}|{i}".encode()).digest() for i in idents for block in blocks)
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(idents), -1), axis=1)[:, :n_perm]


def paired_prediction_test(
    pred: DataFrame, keys: Sequence[str], ident: str, n_perm: int = spec.N_PERMUTATIONS, seed: int = spec.TEST_SEED, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Difference in R2 of predictions a and b under row-wise swaps.

    R2_a - R2_b is (SSE_b - SSE_a) / SST, so a permutation only flips signs of per-row error gaps. Rows are dealt
    by ``ident``, whose signs all keys share, to groups of 1 to 10 times ``task_rows``; a group gives one array of sums per
    key for all permutations, and the arrays of a key are added up. Rows with a null in ``y``, ``a`` or ``b`` are left out.
    """
    keys = list(keys)
    gap = F.pow(F.col("y") - F.col("b"), 2) - F.pow(F.col("y") - F.col("a"), 2)
    rows = pred.select(*keys, F.col(ident).cast("string").alias("_ident"), "y", gap.alias("g")).where("g is not null")
    obs = rows.groupBy(*keys).agg(F.sum("g").alias("_g"), (F.var_pop("y") * F.count("y")).alias("_sst"), F.count("y").alias("n"))
    total = rows.count()
    buckets = max(-(-total // (10 * task_rows)), min(pred.sparkSession.sparkContext.defaultParallelism, -(-total // task_rows)), 1)
    dealt = rows.select(*keys, F.pmod(F.xxhash64("_ident"), F.lit(buckets)).alias("_group"), "_ident", "g")
    schema = StructType([*[pred.schema[k] for k in keys], StructField("sums", ArrayType(DoubleType()))])
    arrow = to_arrow_schema(schema)

    def summed(table: pa.Table) -> pa.Table:
        idents = table.column("_ident").combine_chunks().dictionary_encode()
        names, row, g = idents.dictionary.to_pylist(), idents.indices.to_numpy(), table.column("g").to_numpy()
        flat = np.zeros(len(g), dtype=np.int64)
        for k in keys:
            coded = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
            flat = flat * len(coded.dictionary) + coded.indices.to_numpy()
        _, first, key = np.unique(flat, return_index=True, return_inverse=True)
        known = table.select(keys).take(pa.array(first))
        order = np.argsort(row, kind="stable")
        row, key, g = row[order], key[order], g[order]
        sums = np.zeros((len(first), n_perm))
        for i in range(0, len(names), 512):
            lo, hi = np.searchsorted(row, [i, i + 512])
            gaps = np.zeros((len(first), min(512, len(names) - i)))
            np.add.at(gaps, (key[lo:hi], row[lo:hi] - i), g[lo:hi])
            sums += gaps.sum(axis=1)[:, None] - 2 * (gaps @ row_signs(names[i : i + 512], n_perm, seed).astype(np.float64))
        columns = [known.column(k).combine_chunks().cast(arrow.field(k).type) for k in keys]
        return pa.table([*columns, pa.array(list(sums), arrow.field("sums").type)], schema=arrow)

    sums = dealt.groupBy("_group").applyInArrow(summed, schema).select(*keys, F.posexplode("sums").alias("perm", "m"))
    both = sums.groupBy(*keys, "perm").agg(F.sum("m").alias("m")).join(obs, keys)
    extreme = F.count_if(F.abs("m") >= F.abs("_g") * (1 - SLACK))
    return both.groupBy(*keys).agg(
        ratio(F.max("_g"), F.max("_sst")).alias("observed_diff"), ((extreme + 1) / (n_perm + 1)).alias("p_value"), F.max("n").alias("n")
    )


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")

