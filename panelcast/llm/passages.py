"""Substring de-duplication by MinHash bands over overlapping paragraphs.

Passages that documents share start and end anywhere, so paragraphs are taken as
all overlapping stretches of WINDOW words. A paragraph's MinHash in a band is the
smallest hash among its five-word shingles; neighbouring paragraphs mostly have
the same one, so a document gives about 2 / WINDOW rows per word and band. The
band key is the hash of the CONTEXT words from that shingle on, which keeps
common phrases apart.

Every key links its later documents with the first one that has it (smallest id),
never all pairs. That holder may have only a part of what later documents share, so
once its links are verified a second round follows. A key outside all verified blocks
of a document links it with the next holder that is open there too. And around every
shared key the stretches of exactly ``min_words`` words are keys besides, but for those
inside an equal run with an earlier document: that run has a first holder whose own
stretches are all there, so each stretch still meets its first holder.
A linked pair is verified on both texts: equal runs of words are
extended from the shared shingles and then, on both sides, over gaps of up to GAP
words to the next equal shingle, and a block counts if it has at least ``min_words``
words and the Jaccard similarity of its five-word shingles to the other side is 0.8
or more (else its longest similar parts are tried). The later document loses the block. Components of the verified links
label the removals.

A passage of 50 words or more that two documents share exactly always has a common key,
so each of its stretches is linked and exact repeats are complete for ``min_words`` of
45 or more. An edited passage is missed if the first two open holders of each of its keys
have only a shorter part of it.
Words are compared with ASCII letters lowered. Null and empty texts, and texts
under ``min_words`` words, have no passages. Rows with a null id take no part. Rows
that share an id are never compared with each other, and each loses what was found
in any of them only where the words agree. Repeats inside one document are left.
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
from panelcast.sources.stage import release, write_stage

SHINGLE, WINDOW, CONTEXT, BANDS, GAP = 5, 40, 10, 4, 6
PERCENT = 80


def word_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in slices: the first text, hashes of all words, the code point of its text at which each begins, and where the words of each text begin and end."""
    data, offsets = text_buffers(column)
    for a, b in slices(offsets):
        raw = data[offsets[a] : offsets[b]]
        start, end, row = word_spans(raw, offsets[a : b + 1] - offsets[a])
        chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        cuts = np.searchsorted(row, np.arange(b - a + 1))
        yield a, span_hashes(LOWER[raw], start, end), chars[start] - chars[(offsets[a : b + 1] - offsets[a])[row]], cuts


def text_words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text: hashes of its words and the code point at which each begins."""
    for _, word, begins, cuts in word_slices(column):
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            yield word[first:last], begins[first:last]


def lowest(h: np.ndarray, size: int, usable: np.ndarray) -> np.ndarray:
    """Marks the first smallest place of each stretch of ``size`` values of ``h`` that is ``usable`` (by its begin).

    Minima of stretches come from minima of ever longer ones. A value that is the largest of the minima of the stretches around
    it is the minimum of one of them.
    """

    def over(f, values: np.ndarray) -> np.ndarray:
        k = 1
        while 2 * k <= size:
            values, k = f(values[:-k], values[k:]), 2 * k
        return f(values[: len(values) - size + k], values[size - k :]) if k < size else values

    low = over(np.minimum, h)
    low[~usable] = 0
    none = np.zeros(size - 1, h.dtype)
    out = h == over(np.maximum, np.concatenate([none, low, none]))
    # Equal values near each other: the later one counts if a stretch that begins behind the earlier one has no smaller value.
    at = np.flatnonzero(out)
    tied = 1 + np.flatnonzero((at[1:] - at[:-1] < size) & (h[at[1:]] == h[at[:-1]]))
    if len(tied):
        at, before = at[tied], at[tied - 1]
        first = np.zeros(len(tied), bool)
        for k in range(size):
            begin = np.clip(at - k, 0, len(low) - 1)
            first |= (begin == at - k) & (begin > before) & (low[begin] == h[at])
        out[at[~first]] = False
    return out


def slice_keys(word: np.ndarray, cuts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, key, first and last place of the keys of texts whose words lie between ``cuts``, all texts at once.

    Of repeats within a paragraph (as in periodic text) the first and the last place are told.
    """
    sizes = np.diff(cuts)
    long = sizes >= max(min_words, WINDOW)
    texts, word, sizes = np.flatnonzero(long), word[np.repeat(long, sizes)], sizes[long]
    if not len(texts):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    begin, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    left = (begin + sizes)[of] - np.arange(len(word))  # words from here to the end of the text
    shingle, keys, places = shingle_hashes(word, SHINGLE), [], []
    for band in range(BANDS):
        h = mix(shingle + np.uint64(band * 0x51ED270B9F3A6C15 & (1 << 64) - 1))
        at = np.flatnonzero(lowest(h, WINDOW - SHINGLE + 1, left[: len(word) - WINDOW + 1] >= WINDOW))
        at = at[left[at] >= CONTEXT]
        context = shingle_hashes(word[at + np.arange(CONTEXT)[:, None]], CONTEXT)[0]
        keys.append(mix(context + np.uint64(band)))
        places.append(at)
    key, place = np.concatenate(keys).view(np.int64), np.concatenate(places)
    order = np.lexsort((place, key, of[place]))
    key, place = key[order], place[order]
    text = of[place]
    fresh = np.r_[True, (text[1:] != text[:-1]) | (key[1:] != key[:-1]) | (place[1:] - place[:-1] > WINDOW)]
    place = place - begin[text]
    return texts[text[fresh]], key[fresh], place[fresh], place[np.r_[fresh[1:], True]]


def band_keys(word: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a text and their first and last places."""
    return slice_keys(word, np.array([0, len(word)]), min_words)[1:]


def exact_keys(word: np.ndarray, first: np.ndarray, last: np.ndarray, size: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the stretches of ``size`` words around keys that are at ``first`` to ``last``, but for those inside ``runs``.

    Of equal ones that begin within ``size`` words of each other, two that cover the others are kept.
    """
    n = len(word) - size + 1
    if n <= 0 or not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.bincount(np.clip(first + CONTEXT - size, 0, n), minlength=n + 1)
    ends = np.bincount(np.clip(last + 1, 0, n), minlength=n + 1)
    inside = np.bincount(np.clip(runs[:, 0], 0, n), minlength=n + 1) - np.bincount(np.clip(runs[:, 1] - size + 1, 0, n), minlength=n + 1)
    at = np.flatnonzero((np.cumsum(begins - ends)[:n] > 0) & (np.cumsum(inside)[:n] == 0))
    key = span_hashes(word, at, at + size).view(np.int64)
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    fresh = np.ones(len(key) + 1, bool)
    fresh[1:-1] = (key[1:] != key[:-1]) | (at[1:] // size != at[:-1] // size)
    outer = fresh[:-1] | fresh[1:]
    return key[outer], at[outer]


def shared_blocks(x: np.ndarray, y: np.ndarray, hits: list[tuple[int, int]], min_words: int) -> list[tuple[int, int, int, int]]:
    """Verified blocks (begin and end in x, begin and end in y) around common places of two texts."""
    return [b for chain in chains(x, y, hits) for b in best_parts(x, y, chain) if b[1] - b[0] >= min_words]


def chains(x: np.ndarray, y: np.ndarray, hits: list[tuple[int, int]]) -> list[list[tuple[int, int, int, int]]]:
    """Equal runs (begin and end in x, begin and end in y) that follow each other over short gaps, around common places of two texts."""

    def run_at(i: int, j: int) -> tuple[int, int, int, int]:
        """The equal run that has word i of x and word j of y."""
        after, before = reach(x[i:], y[j:]), reach(x[:i][::-1], y[:j][::-1])
        return i - before, i + after, j - before, j + after

    def beyond(run: tuple[int, int, int, int], step: int) -> tuple[int, int, int, int] | None:
        """The nearest run of a shingle or more after (step 1) or before (step -1) a run, past a gap of up to GAP words on either side."""
        i, j = (run[1], run[3]) if step > 0 else (run[0] - SHINGLE, run[2] - SHINGLE)
        for p, q in GAPS:
            c, d = i + step * p, j + step * q
            if 0 <= c <= len(x) - SHINGLE and 0 <= d <= len(y) - SHINGLE and x[c] == y[d] and (x[c : c + SHINGLE] == y[d : d + SHINGLE]).all():
                a, b, shift = *run_at(c, d)[:2], c - d
                # The run may reach back over words of the first one (as in periodic text): only what lies beyond counts.
                a, b = (max(a, run[1], run[3] + shift), b) if step > 0 else (a, min(b, run[0], run[2] + shift))
                return a, b, a - shift, b - shift
        return None

    seeds, last = set(), None
    for shift, i in sorted((i - j, i) for i, j in hits):
        if last and last[0] - last[2] == shift and i < last[1]:
            continue
        if 0 <= i < len(x) and 0 <= i - shift < len(y) and x[i] == y[i - shift]:
            seeds.add(last := run_at(i, i - shift))
    seen: set[tuple[int, int, int, int]] = set()
    out = []
    for seed in sorted(seeds):
        if seed in seen:
            continue
        chain = [seed]
        for step in (1, -1):
            last = seed
            while (more := beyond(last, step)) and more not in seen:
                chain.append(last := more)
        chain.sort()
        seen.update(chain)
        out.append(chain)
    return out


def ranges(column: pa.Array):
    """Reads fields of a column of lists of structs, row by row, as arrays; a null list is empty."""
    cuts, flat = column.offsets.to_numpy(), column.values
    fields = {}

    def row(i: int, *names: str) -> list[np.ndarray]:
        for name in names:
            if name not in fields:
                fields[name] = flat.field(name).to_numpy(zero_copy_only=False).astype(np.int64)
        return [fields[name][cuts[i] : cuts[i + 1]] for name in names]

    return row


def reach(u: np.ndarray, v: np.ndarray) -> int:
    """How many words two stretches have in common from their beginning."""
    n, at, size = min(len(u), len(v)), 0, 64
    while at < n:
        differ = np.flatnonzero(u[at : min(n, at + size)] != v[at : min(n, at + size)])
        if len(differ):
            return at + int(differ[0])
        at, size = at + size, 2 * size
    return n


#: Words passed over in each text between two runs of a block, fewest first.
GAPS = sorted(((p, q) for p in range(GAP + 1) for q in range(GAP + 1) if p or q), key=lambda g: (sum(g), abs(g[0] - g[1])))
#: Runs of a chain whose parts are compared with each other.
CHAIN = 500


def best_parts(x: np.ndarray, y: np.ndarray, chain: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The chain as one block if both sides are similar, else its longest similar part and those of what is left; single runs at least."""
    todo, out = [chain], []
    while todo:
        own = todo.pop()
        if not own:
            continue
        whole = (own[0][0], own[-1][1], own[0][2], own[-1][3])
        if len(own) == 1 or similar(x[whole[0] : whole[1]], y[whole[2] : whole[3]]):
            out.append(whole)
            continue
        if len(own) > CHAIN:
            widest = max(range(1, len(own)), key=lambda k: own[k][0] - own[k - 1][1] + own[k][2] - own[k - 1][3])
            todo += [own[:widest], own[widest:]]
            continue
        a, b, c, d = np.array(own).T
        common = np.r_[0, np.cumsum(np.maximum(b - a - SHINGLE + 1, 0))]
        both = common[None, 1:] - common[:-1, None]
        size = (b[None] - a[:, None]) + (d[None] - c[:, None]) - 2 * (SHINGLE - 1) - both
        fits = np.triu(100 * both >= PERCENT * size)
        np.fill_diagonal(fits, True)
        fits[0, -1] = False
        length = np.where(fits, b[None] - a[:, None], -1)
        i, j = np.unravel_index(int(length.argmax()), length.shape)
        todo += [own[:i], own[i : j + 1], own[j + 1 :]]
    return out


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    x, y = np.unique(shingle_hashes(x, SHINGLE)), np.unique(shingle_hashes(y, SHINGLE))
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """One row per passage that an earlier document has: ``id_col``, ``start``, ``end`` (code points; the end is where
    the next word begins), ``n_words``, ``kept_id``, ``kept_start`` and ``component_id``."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    spark, kind = docs.sparkSession, docs.schema["id"].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, word, _, cuts in word_slices(batch.column(1)):
                texts, keys, places, ends = slice_keys(word, cuts, min_words)
                ids = batch.column(0).take(pa.array(first + texts))
                # Nearly every key has one place only, so that the distance to the last one takes hardly any disk.
                yield pa.record_batch([ids, pa.array(keys), pa.array(places, pa.int32()), pa.array(ends - places, pa.int32())], names=["id", "key", "at", "span"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys of the second round: those outside all verified blocks, and stretches outside all equal runs."""
        for batch in batches:
            spots, blocks, runs = (ranges(batch.column(k)) for k in (2, 3, 4))
            for i, (word, _) in enumerate(text_words(batch.column(1))):
                at, last, key, head = spots(i, "at", "last_at", "key", "head")
                keys, places = exact_keys(word, at, last, min_words, np.stack(runs(i, "begin", "end"), 1))
                begin, end = blocks(i, "begin", "end")
                # Blocks by begin with the furthest end so far: a context lies inside one if the last that begins by then reaches over it.
                order = np.argsort(begin, kind="stable")
                reached = np.r_[0, np.maximum.accumulate(end[order])] if len(end) else np.zeros(1, np.int64)
                open_ = (head == 0) & (reached[np.searchsorted(begin[order], at, "right")] < at + CONTEXT)
                part = np.r_[places // min_words, -1 - at[open_]]
                keys, places = np.r_[keys, key[open_]], np.r_[places, at[open_]]
                if len(keys):
                    ids = batch.column(0).take(pa.array(np.full(len(keys), i)))
                    yield pa.record_batch([ids, pa.array(keys), pa.array(places, pa.int32()), pa.array(part, pa.int32())], names=["id", "key", "at", "part"])

    def first_holders(keys: DataFrame) -> DataFrame:
        first = keys.groupBy("key").agg(F.min(F.struct("id", "at")).alias("first"), F.max("id").alias("last"))
        return first.where("last > first.id").select("key", F.col("first.id").alias("other"), F.col("first.at").alias("other_at"))

    def linked(shared: DataFrame, name: str) -> DataFrame:
        """Common places of each pair. Stretches of one shift and part are of one equal run, and one of them is enough; each other place is a part of its own."""
        hits = shared.where("id > other").groupBy("id", "other", F.col("at") - F.col("other_at"), "part").agg(F.min(F.struct("at", "other_at")).alias("hit"))
        return write_stage(hits.groupBy("id", "other").agg(F.collect_list("hit").alias("hits")), name)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, facts, runs = [], [], []
            left, right, spots = text_words(batch.column(2)), text_words(batch.column(3)), ranges(batch.column(4))
            for r, ((x, at), (y, other_at)) in enumerate(zip(left, right, strict=True)):
                i, j = spots(r, "at", "other_at")
                there = (i < len(x)) & (j < len(y))
                hits = list(zip(i[there].tolist(), j[there].tolist(), strict=True))
                for chain in chains(x, y, hits):
                    for a, b, c, d in best_parts(x, y, chain):
                        if b - a >= min_words:
                            rows.append(r)
                            facts.append((at[a], at[b] if b < len(at) else -1, b - a, other_at[c], a, b))
                            runs.append([{"begin": u, "end": v} for u, v, w, z in chain if v - u >= min_words and a <= u and v <= b and c <= w and z <= d])
            if rows:
                start, end, n, other, first, stop = np.array(facts).T
                take = pa.array(rows)
                columns = [batch.column(0).take(take), pa.array(start), pa.array(end), pa.array(n), batch.column(1).take(take), pa.array(other)]
                columns += [pa.array(first, pa.int32()), pa.array(stop, pa.int32()), pa.array(runs, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))]
                yield pa.record_batch(columns, names=names)

    names = ["id", "start", "end", "n_words", "other", "other_start", "first", "stop", "runs"]
    shape = f"id {kind}, start bigint, end bigint, n_words bigint, other {kind}, other_start bigint, first int, stop int, runs array<struct<begin: int, end: int>>"

    def checked(hits: DataFrame, name: str) -> DataFrame:
        pairs = hits.join(texts.select("id", "text"), "id").join(texts.select(F.col("id").alias("other"), F.col("text").alias("other_text")), "other")
        return write_stage(pairs.select("id", "other", "text", "other_text", "hits").mapInArrow(verified, shape), name)

    keys = write_stage(docs.mapInArrow(keyed, f"id {kind}, key bigint, at int, span int"), "passage-keys")
    first = write_stage(first_holders(keys), "passage-first")
    release(spark)
    shared = write_stage(keys.join(first, "key"), "passage-shared")
    release(spark, keys, first)
    spots = shared.groupBy("id").agg(F.collect_set(F.struct("at", (F.col("at") + F.col("span")).alias("last_at"), "key", (F.col("id") == F.col("other")).cast("int").alias("head"))).alias("spots"))
    texts = write_stage(docs.join(spots, "id"), "passage-texts")
    release(spark)
    found = checked(linked(shared.withColumn("part", -1 - F.col("at")), "passage-hits"), "passages")
    release(spark, shared)

    # Runs of all links of a document: equal and nested ones are common among near copies, so each is held once.
    own = found.groupBy("id").agg(
        F.collect_set(F.struct(F.col("first").alias("begin"), F.col("stop").alias("end"))).alias("blocks"),
        F.array_distinct(F.flatten(F.collect_set("runs"))).alias("runs"),
    )
    opened = texts.join(own, "id", "left").select("id", "text", "spots", "blocks", "runs")
    whole = write_stage(opened.mapInArrow(second, f"id {kind}, key bigint, at int, part int"), "passage-second")
    release(spark)
    hits = linked(whole.join(first_holders(whole), "key"), "passage-second-hits")
    release(spark, whole)
    again = checked(hits, "passages-second")
    release(spark)
    found = found.union(again).select("id", "start", "end", "n_words", "other", "other_start").distinct()
    found = write_stage(found, "passages-all")
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    sizes = texts.select("id", F.length("text").alias("size")).groupBy("id").agg(F.max("size").alias("size"))
    out = found.join(parts.withColumnRenamed("node", "id"), "id").join(sizes, "id")
    return out.select(
        F.col("id").alias(id_col), "start", F.when(F.col("end") < 0, F.col("size")).otherwise(F.col("end")).alias("end"), "n_words",
        F.col("other").alias("kept_id"), F.col("other_start").alias("kept_start"), F.col("component").alias("component_id"),
    )


def remove_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the spans of ``passages`` cut out of their texts; all columns stay."""
    spans = passages.groupBy(F.col(id_col).alias("_id")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    # Spans may overlap: each step keeps what lies between the furthest end so far and the next start.
    empty = F.struct(F.lit(0).cast("bigint").alias("to"), F.lit("").alias("text"))

    def step(done, span):
        gap = F.col(text_col).substr((done["to"] + 1).cast("int"), F.greatest(span["start"] - done["to"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(done["to"], span["end"]).alias("to"), F.concat(done["text"], gap).alias("text"))

    def rest(done):
        return F.concat(done["text"], F.col(text_col).substr((done["to"] + 1).cast("int"), F.length(text_col)))

    cut = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(F.aggregate("_spans", empty, step, rest))
    both = docs.join(spans, F.col(id_col) == F.col("_id"), "left")
    return both.select(*[(cut.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns])


@query("op8_substring_dedup")
def op8_substring_dedup(spark, folder: str) -> DataFrame:
    """Every passage of 50 words or more that an earlier document has, with that document."""
    found = repeated_passages(table(spark, folder, "documents"))
    return found.withColumnRenamed("kept_id", "kept_doc_id")
