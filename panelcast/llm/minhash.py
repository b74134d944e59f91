"""MinHash near-duplicate detection with sequential Bayesian verification.

1. One pass over the texts gives each document's shingle count, a digest of its
   shingle set, band keys and a signature of 8-bit MinHash values.
2. Documents with equal sets form a class; only its smallest id goes on.
3. Classes that share a band key are candidates. Instead of all pairs of a
   bucket, every member is paired with one pivot per bucket, and with one per
   half-bucket that shares the next band too.
4. Candidate pairs compare their signatures in batches; a pair is pruned once
   the posterior probability that its similarity reaches the threshold is below
   ``miss``. Survivors are confirmed on their full shingle sets.
5. Components of the confirmed links are formed. What is left in each bucket is
   then compared: members outside the bucket's main component with every member
   of another component. Blocks of both meet in tasks as matrices of shingles,
   each pair in its first shared band only, and only pairs that reach the
   threshold leave the task. That makes the result exact for all documents that
   share a band, while no list of pairs of a group is ever written.

A pair at the threshold misses all bands with probability (1 - t^rows)^bands,
1.3e-7 by default. Null text, and text without words, has an empty set and is
linked with nothing. Ids are taken to be unique and rows with a null id are left
out; rows that share an id are treated each by its own text. Other columns are
not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.components import connected_components
from panelcast.llm.registry import query, table
from panelcast.llm.words import LOWER, mix, shingle_hashes, slices, span_hashes, text_buffers, word_spans
from panelcast.sources.stage import write_stage

BANDS, ROWS, BATCH = 40, 5, 40
#: Members of a bucket that meet in one task, on either side.
BLOCK = 256
#: Distinct shingles in one matrix product.
COLUMNS = 4096
#: Shingles whose hash matrix is held at once.
CHUNK = 2048
_RNG = np.random.default_rng(20240)
_SCALE = (_RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFT = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest hash under each of the BANDS * ROWS functions."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_SCALE), np.uint32(0xFFFFFFFF))
    for at in range(0, len(h), CHUNK):
        np.minimum(out, ((h[at : at + CHUNK, None] ^ _SHIFT) * _SCALE).min(axis=0), out=out)
    return out


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text in turn."""
    data, offsets = text_buffers(column)
    for a, b in slices(offsets):
        cut = LOWER[data[offsets[a] : offsets[b]]]
        start, end, row = word_spans(cut, offsets[a : b + 1] - offsets[a])
        word = span_hashes(cut, start, end)
        cuts = np.searchsorted(row, np.arange(b - a + 1))
        for i in range(b - a):
            yield np.unique(shingle_hashes(word[cuts[i] : cuts[i + 1]], size))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Per row of (id, text): set size, two halves of the set digest, band keys and 8-bit signature."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = mix(np.arange(1, ROWS + 1, dtype=np.uint64))
        salt = mix(np.arange(100, 100 + BANDS, dtype=np.uint64))
        for batch in batches:
            n, digests, sigs = [], [], []
            for own in shingle_sets(batch.column(1), size):
                n.append(len(own))
                digests.append((own.sum(dtype=np.uint64), mix(own * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)))
                sigs.append(signature(own))
            if not n:
                continue
            sig, digest = np.array(sigs), np.array(digests, np.uint64).view(np.int64)
            keys = mix((sig.reshape(-1, BANDS, ROWS).astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64) + salt).view(np.int64)
            low = pa.array([r.tobytes() for r in sig.astype(np.uint8)], pa.binary())
            bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), bands, low],
                names=["id", "n", "d1", "d2", "bands", "sig"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(signed, f"id {kind}, n bigint, d1 bigint, d2 bigint, bands array<bigint>, sig binary")


def least_matches(threshold: float, miss: float) -> np.ndarray:
    """After each batch of signature values, the fewest matches at which P(similarity >= threshold) is not below ``miss``.

    Uniform prior; two 8-bit values also match by chance.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    p = grid + (1 - grid) / 256
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            posterior = np.exp(log - log.max())
            if posterior[grid >= threshold].sum() >= miss * posterior.sum():
                out.append(m)
                break
    return np.array(out)


def stored_sets(docs: DataFrame, size: int) -> DataFrame:
    """``id`` and ``set``, the sorted 64-bit shingle hashes, of rows of (id, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1), size)], pa.binary())], names=["id", "set"])

    return docs.mapInArrow(sets, f"id {docs.schema['id'].dataType.simpleString()}, set binary")


def verified(pairs: DataFrame, full: DataFrame, signed: DataFrame, percent: int, miss: float, name: str) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold."""
    floor = least_matches(percent / 100, miss)

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for k in (2, 3))
                alive, found = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
                for step, least in enumerate(floor):
                    at = slice(step * BATCH, (step + 1) * BATCH)
                    found[alive] += (left[alive, at] == right[alive, at]).sum(axis=1)
                    alive = alive[found[alive] >= least]
                yield batch.select([0, 1]).take(pa.array(alive))

    kind = full.schema["id"].dataType.simpleString()
    sig = signed.select("id", "sig")
    both = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    alive = write_stage(both.select("a", "b", "sa", "sb").mapInArrow(pruned, f"a {kind}, b {kind}"), f"{name}-alive")

    @F.udf("boolean", useArrow=True)
    def linked(x, y):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= percent * (len(x) + len(y) - common)

    both = alive.join(full.select(F.col("id").alias("a"), F.col("set").alias("xa")), "a").join(full.select(F.col("id").alias("b"), F.col("set").alias("xb")), "b")
    return write_stage(both.where(linked("xa", "xb")).select("a", "b"), f"{name}-links")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()


def block_pairs(rest: pa.Table, other: pa.Table, percent: int) -> np.ndarray:
    """Rows (of rest, of other) of one bucket whose shingles reach the threshold, up to collisions of 32-bit hashes."""
    cx, cy, nx, ny = (t.column(c).to_numpy() for c in ("c", "n") for t in (rest, other))
    x, y = rest.column("id").to_numpy(), other.column("id").to_numpy()
    open_ = cx[:, None] != cy
    open_ &= (cy == other.column("main").to_numpy()) | (x[:, None] < y)
    open_ &= 100 * np.minimum(nx[:, None], ny) >= percent * np.maximum(nx[:, None], ny)
    bx, by = (np.frombuffer(b"".join(t.column("keys").to_pylist()), np.uint32).reshape(-1, BANDS) for t in (rest, other))
    for band in range(int(rest.column("band")[0].as_py())):  # a pair that shares an earlier band is settled there
        open_ &= bx[:, band, None] != by[:, band]
    i, j = np.nonzero(open_)
    if not len(i):
        return np.zeros((0, 2), np.int64)
    sx, sy = ([np.frombuffer(v, np.uint32) for v in t.column("set").to_pylist()] for t in (rest, other))
    if len(i) <= 16:
        common = np.array([len(np.intersect1d(sx[a], sy[b])) for a, b in zip(i, j, strict=True)])
    else:
        row_x, row_y = (np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (sx, sy))
        _, number = np.unique(np.concatenate(sx + sy), return_inverse=True)
        vx, vy = number[: len(row_x)], number[len(row_x) :]
        counts = np.zeros((len(sx), len(sy)), np.float32)
        for low in range(0, int(number.max()) + 1, COLUMNS):
            a, b = (np.zeros((len(s), COLUMNS), np.float32) for s in (sx, sy))
            for m, r, v in ((a, row_x, vx), (b, row_y, vy)):
                own = (v >= low) & (v < low + COLUMNS)
                m[r[own], v[own] - low] = 1
            counts += a @ b.T
        common = counts[i, j].astype(np.int64)
    # Shingles of a text that share their 32 bits count once here. A pair has at most as many more in common as the
    # text with fewer such ones has lost, so no link is ruled out; links are confirmed later.
    lost_x, lost_y = (n - np.array([len(np.unique(v)) for v in s]) for n, s in ((nx, sx), (ny, sy)))
    common = common + np.maximum(2, np.minimum(lost_x[i], lost_y[j]))
    good = 100 * common >= percent * (nx[i] + ny[j] - common)
    return np.column_stack([i[good], j[good]])


def across_components(now: DataFrame, full: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of one bucket but different components that reach the threshold."""
    kind = full.schema["id"].dataType.simpleString()
    parts = now.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k"))
    main = parts.groupBy("key").agg(F.max(F.struct("k", "c")).alias("most"), F.sum("k").alias("all"), F.count(F.lit(1)).alias("parts"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    main = main.where("parts > 1").select("key", F.col("most.c").alias("main"), blocks(F.col("all") - F.col("most.k")).alias("nx"), blocks(F.col("all")).alias("ny"))
    open_ = write_stage(now.join(write_stage(main, "minhash-main"), "key"), "minhash-open")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(np.frombuffer(s, np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for s in batch.column(1).to_pylist()]
            keys = np.array(batch.column(2).to_pylist(), np.int64).astype(np.uint32)
            yield pa.record_batch([batch.column(0), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(sets, pa.binary())], names=["id", "keys", "set"])

    need = open_.select("id").distinct()
    own = full.join(need, "id", "left_semi").join(reps.select("id", "bands"), "id")
    loads = write_stage(own.mapInArrow(packed, f"id {kind}, keys binary, set binary"), "minhash-loads")
    h = F.xxhash64("id")
    sides = open_.select(
        "key", "band", "id", "n", "c", "main",
        F.explode(
            F.concat(
                F.when(F.col("c") != F.col("main"), F.transform(F.sequence(F.lit(0), F.col("ny") - 1), lambda j: F.struct(F.pmod(h, "nx").cast("int").alias("i"), j.alias("j"), F.lit(0).alias("side")))).otherwise(
                    F.array().cast("array<struct<i:int,j:int,side:int>>")
                ),
                F.transform(F.sequence(F.lit(0), F.col("nx") - 1), lambda i: F.struct(i.alias("i"), F.pmod(h, "ny").cast("int").alias("j"), F.lit(1).alias("side"))),
            )
        ).alias("at"),
    ).select("key", "band", "id", "n", "c", "main", "at.*")
    met = sides.join(loads, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def solved(table: pa.Table) -> list[tuple]:
            place = np.column_stack([table.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = np.r_[0, np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1, len(place)]
            side, ids, out = table.column("side").to_numpy(), table.column("id"), []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                m = a + int(np.searchsorted(side[a:b], 1))
                if a < m < b:
                    for i, j in block_pairs(table.slice(a, m - a), table.slice(m, b - m), percent).tolist():
                        out.append((ids[a + i].as_py(), ids[m + j].as_py()))
            return out

        def sent(pairs: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([p[k] for p in pairs], batch_type) for k in (0, 1)], names=["x", "y"])

        batch_type = None
        for batch in batches:
            batch_type = batch.schema.field("id").type
            table = pa.concat_tables([*held, pa.Table.from_batches([batch])]).combine_chunks()
            place = np.column_stack([table.column(c).to_numpy() for c in ("key", "i", "j")])
            ends = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1 if len(place) > 1 else []
            whole = int(ends[-1]) if len(ends) else 0  # the last group may go on in the next batch
            if whole:
                yield sent(solved(table.slice(0, whole)))
            held = [table.slice(whole)]
        if held and held[0].num_rows:
            yield sent(solved(held[0]))

    return met.select("key", "i", "j", "side", "band", "id", "n", "c", "main", "keys", "set").mapInArrow(compared, f"x {kind}, y {kind}")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, miss: float = 1e-7
) -> DataFrame:
    """``id_col``, ``n_shingles``, ``class_id`` (smallest id with the same set) and ``component_id`` (smallest id reachable).

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of ``size``-word shingles.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("id").isNotNull())
    signed = write_stage(signatures(docs, size), "minhash")
    classes = write_stage(signed.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep")), "minhash-classes")
    reps = signed.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    each = reps.select("id", "n", F.posexplode("bands").alias("band", "key"), "bands")
    each = each.select("id", "n", "band", "key", F.element_at("bands", (F.col("band") + 1) % BANDS + 1).alias("next"))

    def pivot():
        return F.min(F.struct(F.xxhash64("id", "key").alias("h"), "id"))["id"].alias("pivot")

    shared = write_stage(each.groupBy("key").agg(pivot(), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "minhash-buckets")
    members = write_stage(each.join(shared, "key"), "minhash-members")
    halves = members.groupBy("key", "next").agg(pivot(), F.count(F.lit(1)).alias("k")).where("k > 1")
    to_pivot = members.select(F.col("id").alias("x"), F.col("pivot").alias("y"))
    to_half = members.drop("pivot").join(halves, ["key", "next"]).select(F.col("id").alias("x"), F.col("pivot").alias("y"))
    tried = write_stage(ordered(to_pivot.unionByName(to_half)), "minhash-pairs")
    # The texts of documents that share a bucket move once, for their sets.
    full = write_stage(stored_sets(docs.join(members.select("id").distinct(), "id", "left_semi"), size), "minhash-sets")
    links = verified(tried, full, reps, percent, miss, "minhash-first")
    found = connected_components(links)
    now = members.select("key", "band", "id", "n").join(found.withColumnRenamed("node", "id"), "id", "left")
    now = write_stage(now.select("key", "band", "id", "n", F.coalesce("component", "id").alias("c")), "minhash-now")
    left = write_stage(ordered(across_components(now, full, reps, percent)), "minhash-across")
    more = verified(left, full, reps, percent, miss, "minhash-rest")
    found = connected_components(links.unionByName(more))

    rows = signed.select("id", "n", "d1", "d2").join(classes, ["d1", "d2", "n"], "left")
    rows = rows.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return rows.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("class_id"),
        F.coalesce("component", "rep", "id").alias("component_id"),
    )


@query("op5_minhash_near_dedup")
def op5_minhash_near_dedup(spark, folder: str) -> DataFrame:
    """Near-duplicate component of every document, by four-word shingles at a similarity of 0.8."""
    found = near_duplicates(table(spark, folder, "documents"), size=4)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "class_id")
