"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Lengths are whole numbers up to the capacity, so the corpus enters the plan as a
histogram, whose size does not grow with the data:

1. Large lengths are put into groups of equal cardinality and rounded up to the
   largest of their group (linear grouping).
2. For these few sizes, the best mix of configurations (how many pieces of each
   size share a sequence) is found by column generation on the cutting-stock
   linear programme; whole parts are used, remainders go on as single pieces.
3. Actual lengths take the places of the rounded ones, which leaves gaps.
4. Remainders and small lengths are put best-fit, longest first, into the
   fullest sequences that have room.

A plan row gives a run of equal pieces their sequences. Each piece then finds its
place by its rank among the pieces of its length; ranks come from counts per
(length, hash bucket), so a length that a third of all rows share is spread over
many tasks.

Null text counts as empty; an empty text still has its end token. Repeated rows
are packed once each. Other columns are not read, so names cannot clash. The
text's ids are those of the vocabulary's own library; they are computed with a
faster library on the same vocabulary (equality is tested).
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.registry import query, table
from panelcast.sources.stage import write_stage

#: Pieces of one length are ranked in buckets of about this many.
BUCKET_ROWS = 20_000


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """Encoder of a byte-level vocabulary file; its added tokens have their own ids, also inside a text."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)
    # Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"]: t["id"] for t in vocabulary.get("added_tokens", [])}
    ranks = {bytes(map(letters.__getitem__, t)): i for t, i in vocabulary["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def library(path: str):
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


def encoded(text: str, path: str, pattern: str) -> list[int]:
    """The text's ids; the faster encoder gives up on very long runs of blanks, and the vocabulary's library takes over."""
    try:
        return encoder(path, pattern).encode(text, allowed_special="all")
    except ValueError:
        return library(path).encode(text, add_special_tokens=False).ids


def tokenise(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids: id, ``piece``, ``start``, ``length``, ``ids_crc32``.

    A longer document is cut into full pieces; only its first piece may be shorter.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = partial(encoded, path=path, pattern=pattern)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, text in enumerate(batch.column(1)):
                ids = array("I", encode(text.as_py() or ""))
                ids.append(end)
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                view = memoryview(ids).cast("B")
                for k in range(len(cuts) - 1):
                    a, b = cuts[k], cuts[k + 1]
                    rows.append((i, k, a, b - a, zlib.crc32(view[4 * a : 4 * b])))
            if rows:
                at, piece, start, length, crc = zip(*rows, strict=True)
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(pieces, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Cutting-stock programme by column generation: (pieces of each size in a sequence, how many such sequences)."""
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    for _ in range(60 * m):
        prices = inverse.sum(axis=0)
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(int(sizes.min()), capacity + 1):
            fits = np.flatnonzero(sizes <= room)
            value = best[room - sizes[fits]] + prices[fits]
            k = int(value.argmax())
            best[room], last[room] = value[k], fits[k]
        if best[capacity] <= 1 + 1e-7:
            break
        new, room = np.zeros(m), capacity
        while room >= 0 and last[room] >= 0:
            new[last[room]] += 1
            room -= int(sizes[last[room]])
        step, now = inverse @ new, inverse @ demand
        ratio = np.where(step > 1e-9, now / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = new
        inverse = np.linalg.inv(columns)
    return [(columns[:, j].astype(int), float(x)) for j, x in enumerate(inverse @ demand) if x > 1e-9]


class Plan:
    """Runs of equal sequences, and which pieces go where."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.used: dict[int, int] = {}  # pieces of a length that have their place
        self.open: dict[int, list[tuple[int, int]]] = {}  # free room -> runs (first sequence, how many)
        self.rooms: list[int] = []
        self.rows: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, pieces, first sequence, in each, offset

    def _put(self, length: int, count: int, first: int, each: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.rows.append((length, rank, count, first, each, offset))
        self.used[length] = rank + count

    def _free(self, room: int, first: int, count: int) -> None:
        if room and count:
            if room not in self.open:
                self.open[room] = []
                insort(self.rooms, room)
            self.open[room].append((first, count))

    def bins(self, contents: list[tuple[int, int]], count: int) -> None:
        """``count`` new sequences, each with (length, pieces) contents."""
        offset = 0
        for length, each in contents:
            self._put(length, count * each, self.sequences, each, offset)
            offset += length * each
        self._free(self.capacity - offset, self.sequences, count)
        self.sequences += count

    def best_fit(self, length: int, count: int) -> None:
        while count:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                self._free(self.capacity, self.sequences, -(-count // each))
                self.sequences += -(-count // each)
                continue
            room = self.rooms[at]
            first, n = self.open[room].pop()
            if not self.open[room]:
                del self.open[room]
                del self.rooms[at]
            each = room // length
            full = min(n, count // each)
            if full:
                self._put(length, full * each, first, each, self.capacity - room)
                self._free(room - each * length, first, full)
                count -= full * each
            if full < n and 0 < count < each:
                self._put(length, count, first + full, count, self.capacity - room)
                self._free(room - count * length, first + full, 1)
                full, count = full + 1, 0
            self._free(room, first + full, n - full)


def plan(histogram: dict[int, int], capacity: int, groups: int = 96, small: int | None = None) -> Plan:
    """``small`` is the largest length that is put best-fit only; a third of the capacity by default."""
    small = capacity // 3 if small is None else small
    out = Plan(capacity)
    if histogram.get(capacity):
        out.bins([(capacity, 1)], histogram[capacity])
    large = [(k, n) for k, n in sorted(histogram.items(), reverse=True) if small < k < capacity and n]
    rest = {k: n for k, n in histogram.items() if k <= small and n}
    if large:
        total = sum(n for _, n in large)
        share = -(-total // groups)
        cut: list[list[list[int]]] = []
        left = 0
        for k, n in large:
            while n:
                if not left:
                    cut.append([])
                    left = share
                take = min(n, left)
                cut[-1].append([k, take])
                n, left = n - take, left - take
        sizes: list[int] = []
        lists: list[list[list[int]]] = []
        for own in cut:  # groups that round up to the same size are one
            if sizes and sizes[-1] == own[0][0]:
                lists[-1].extend(own)
            else:
                sizes.append(own[0][0])
                lists.append(own)
        demand = np.array([sum(n for _, n in own) for own in lists])
        held = demand.copy()
        for own in lists:
            own.reverse()  # taken from the end, longest first
        for column, times in sorted(configurations(np.array(sizes), demand.astype(float), capacity), key=lambda c: -c[1]):
            parts = [(g, int(a)) for g, a in enumerate(column) if a]
            count = min(int(times + 1e-6), *(int(held[g]) // a for g, a in parts))
            for g, a in parts:
                held[g] -= a * count
            while count:
                same = min([count, *(lists[g][-1][1] // a for g, a in parts)])
                contents: dict[int, int] = {}
                if same:
                    for g, a in parts:
                        contents[lists[g][-1][0]] = contents.get(lists[g][-1][0], 0) + a
                        lists[g][-1][1] -= a * same
                else:
                    same = 1
                    for g, a in parts:
                        while a:
                            while not lists[g][-1][1]:
                                lists[g].pop()
                            take = min(a, lists[g][-1][1])
                            contents[lists[g][-1][0]] = contents.get(lists[g][-1][0], 0) + take
                            lists[g][-1][1] -= take
                            a -= take
                for g, _ in parts:
                    while len(lists[g]) > 1 and not lists[g][-1][1]:
                        lists[g].pop()
                out.bins(sorted(contents.items(), reverse=True), same)
                count -= same
        for own in lists:
            for k, n in own:
                if n:
                    rest[k] = rest.get(k, 0) + n
    for k in sorted(rest, reverse=True):
        out.best_fit(k, rest[k])
    return out


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces with a ``length`` from 1 to ``capacity``."""
    spark = pieces.sparkSession
    pieces = write_stage(pieces, "packing-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    made = plan(histogram, capacity)
    rows = np.array(sorted(made.rows), np.int64).reshape(-1, 6)
    state = spark.sparkContext.broadcast(rows)  # bounded by lengths and configurations, not by the data
    buckets = 1 + max(histogram.values(), default=0) // BUCKET_ROWS
    fields = pieces.columns
    names = [c for c in fields if c != "length"]
    ranked = pieces.withColumn("bucket", F.pmod(F.xxhash64(*pieces.columns), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranked.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = write_stage(counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "packing-ranks")
    inside = Window.partitionBy("length", "bucket").orderBy(*names)
    ranked = ranked.withColumn("inside", F.row_number().over(inside)).join(counts, ["length", "bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("before") + F.col("inside") - 1).cast("long").alias("rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first_rank, _, first, each, offset = state.value.T
        key = (length << 44) | first_rank
        for batch in batches:
            own, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, (own << 44) | rank, "right") - 1
            j = rank - first_rank[at]
            places = [pa.array(first[at] + j // each[at]), pa.array(offset[at] + j % each[at] * own)]
            yield pa.record_batch([*[batch.column(c) for c in fields], *places], names=[*fields, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(placed, f"{kinds}, sequence_id bigint, offset bigint")


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark, folder: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 2048 ids."""
    import public_tokenizers as vocabularies

    pieces = tokenise(table(spark, folder, "documents"), vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN)
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
