"""Byte-level BPE encoding and decoding by replaying the merges over a block of the corpus.

Every task takes its documents in blocks, cuts the texts into words with the
vocabulary's pattern and keeps each distinct word of the block once. An index
from pair rank to the positions of that pair is then worked off in rank order:
all occurrences of the lowest pair are merged at once, and only their left and
right neighbours get new entries. Blocks are independent, so nothing is shuffled
and a lost executor costs the blocks it held. Memory is bounded by the block.

Null text counts as empty and gives no ids. Repeated rows give repeated rows.
Other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.registry import query, table
from panelcast.llm.words import slices, text_buffers

#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Bytes of text in a batch that a task hands back.
BATCH_BYTES = 4 << 20
NONE = np.int32(2**31 - 1)


class MergeTable:
    """Tokens by id, and the id that each adjacent pair of tokens merges into."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        rows = [
            (ranks[token[:cut]], ranks[token[cut:]], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        left, right, into = np.array(sorted(rows), np.int64).T
        self.keys, self.into = (left << 32) | right, into.astype(np.int32)
        # Tokens that can be part of a pair of lower rank: after such a merge the word must be looked at anew.
        self.early = np.zeros(len(self.tokens), bool)
        self.early[left[into < left]] = True
        self.early[right[into < right]] = True

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.into[at], NONE)


@lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def _by_rank(ranks: np.ndarray, positions: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(ranks, kind="stable")
    ranks, positions = ranks[order], positions[order]
    cuts = np.r_[0, np.flatnonzero(np.diff(ranks)) + 1, len(ranks)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(ranks[a]), positions[a:b]


def replay(words: list[bytes], merges: MergeTable) -> list[bytes]:
    """Ids of each distinct word as little-endian unsigned 32-bit integers."""
    if not words:
        return []
    sizes = np.array([len(w) for w in words], np.int64)
    token = merges.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    n = len(token)
    owner = np.repeat(np.arange(len(words)), sizes)
    follow = np.arange(1, n + 2)  # position n stands for "none"
    before = np.arange(-1, n)
    ends = np.cumsum(sizes)
    follow[ends[sizes > 0] - 1] = n
    before[(ends - sizes)[sizes > 0]] = n
    before = np.r_[before, n][: n + 1]
    follow[n] = n
    token = np.r_[token, np.int32(-1)]
    ranks = np.full(n + 1, NONE, np.int32)
    has = np.flatnonzero(follow[:n] < n)
    ranks[has] = merges.rank(token[has], token[follow[has]])
    alive = np.ones(n + 1, bool)

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def put(positions: np.ndarray) -> None:
        positions = positions[ranks[positions] != NONE]
        if len(positions):
            for rank, found in _by_rank(ranks[positions], positions):
                if rank in index:
                    index[rank].append(found)
                else:
                    index[rank] = [found]
                    heapq.heappush(heap, rank)

    put(has)
    while heap:
        rank = heapq.heappop(heap)
        at = index.pop(rank)
        at = np.unique(np.concatenate(at)) if len(at) > 1 else np.sort(at[0])
        at = at[ranks[at] == rank]  # the others have been merged away
        if not len(at):
            continue
        if merges.early[rank]:
            first = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
            rest, at = at[~first], at[first]
            if len(rest):
                index[rank] = [rest]
                heapq.heappush(heap, rank)
        elif len(at) > 1:
            linked = np.r_[False, follow[at[:-1]] == at[1:]]
            if linked.any():  # of overlapping pairs the left one is taken, so every other one of a run
                starts = np.flatnonzero(~linked)
                in_run = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
                at = at[in_run % 2 == 0]
        gone = follow[at]
        after = follow[gone]
        token[at] = rank
        alive[gone] = False
        ranks[gone] = NONE
        ranks[at] = NONE
        follow[at] = after
        before[after] = at
        touched = np.concatenate([at[after < n], before[at]])
        touched = touched[touched < n]
        touched = touched[alive[touched]]
        touched = np.unique(touched) if len(touched) > 1 else touched
        if len(touched):
            ranks[touched] = merges.rank(token[touched], token[follow[touched]])
            put(touched)
    alive = alive[:n]
    ids = token[:n][alive].astype("<u4").tobytes()
    cuts = np.r_[0, np.cumsum(np.bincount(owner[alive], minlength=len(words)))] * 4
    return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def decoded(ids: bytes, merges: MergeTable) -> bytes:
    return b"".join(map(merges.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", back: bool = False
) -> DataFrame:
    """``id_col`` and ``ids``: the ids of the whole text as little-endian unsigned 32-bit integers.

    With ``back`` also ``bytes``, what :func:`decode` makes of the ids, without a second set of Python workers.
    The rank file must be readable on every executor at ``ranks_path``.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, find = merge_table(ranks_path), regex.compile(pattern).findall
        for batch in batches:
            texts = batch.column(1)
            _, offsets = text_buffers(texts)
            for a, b in slices(offsets, BLOCK_BYTES):
                number: dict[str, int] = {}
                cut = [array("i", [number.setdefault(w, len(number)) for w in find(t.as_py() or "")]) for t in texts.slice(a, b - a)]
                ids = replay([w.encode() for w in number], merges)
                del number
                for c, d in slices(offsets[a : b + 1], BATCH_BYTES):
                    out = [b"".join(map(ids.__getitem__, words)) for words in cut[c:d]]
                    columns = {id_col: batch.column(0).slice(a + c, d - c), "ids": pa.array(out, pa.binary())}
                    if back:
                        columns["bytes"] = pa.array([decoded(x, merges) for x in out], pa.binary())
                    yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(encoded, f"`{id_col}` {kind}, ids binary" + ", bytes binary" * back)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out: str = "bytes") -> DataFrame:
    """Adds ``out``: the bytes that the ids of ``ids_col`` stand for; null ids give null."""

    @F.udf("binary", useArrow=True)
    def joined(ids):
        return None if ids is None else decoded(ids, merge_table(ranks_path))

    return encoded.withColumn(out, joined(ids_col))


@query("op2_byte_bpe")
def op2_byte_bpe(spark, folder: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes they decode to."""
    import public_tokenizers as vocabularies

    path = vocabularies.path("byte_bpe_50k.tiktoken")
    ids = encode(table(spark, folder, "documents"), path, vocabularies.PATTERN, back=True)
    return ids.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
