"""Language identification by unigram piece models that sum over all segmentations.

Every language has probabilities of the pieces of one fixed public vocabulary. A
word's likelihood is the sum over all ways to cut it into pieces (a forward
pass over its bytes); a text's is the product over its words. Words are the
runs of letters, digits and non-ASCII bytes, with ASCII letters lowered; each
distinct word of a batch is scored once for all languages. The probabilities
are learned by expectation-maximisation from word counts by language.

Null text or text without a letter gives ``und`` with score 0; so does every
text when nothing could be learned. Rows with null or empty ``lang`` teach
nothing. Only id and text are read for a prediction, so other columns may have
any names. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.registry import query, table
from panelcast.llm.words import LOWER, NOT_ALNUM, _grow, mix, slices, span_hashes, text_buffers, word_spans
from panelcast.llm import words as _words
from panelcast.sources.stage import write_stage

#: A word is scored in stretches of this many bytes, so likelihoods stay within double range.
STRETCH = 32
#: Bytes of words whose lattices are held at once.
LATTICE_BYTES = 1 << 18
FLOOR = 1e-8
#: Bytes of text scored at once.
BATCH_BYTES = 1 << 22


def public_pieces(path: str) -> list[bytes]:
    """The vocabulary as bytes: a leading blank for a word start, and every single byte as a piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = chr(0x2581)
    found = {bytes([b]): None for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_unknown(i) or model.is_control(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        body = piece.removeprefix(mark)
        if mark not in body and piece:
            found[(b" " if piece.startswith(mark) else b"") + body.encode()] = None
    return [p for p in found if len(p) <= STRETCH]


@dataclass
class Lattice:
    """Looks up which byte ranges of words are pieces."""

    hashes: np.ndarray
    ids: np.ndarray
    lengths: list[int]
    maybe: np.ndarray
    n: int

    @classmethod
    def of(cls, pieces: Sequence[bytes]) -> Lattice:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        starts = np.r_[0, ends[:-1]]
        h = span_hashes(data, starts, ends)
        order = np.argsort(h)
        maybe = np.zeros(1 << 20, bool)
        maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return cls(h[order], order.astype(np.int32), sorted({len(p) for p in pieces}), maybe, len(pieces))

    def find(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """For words of equal length n, by piece length l: ids (words x n - l + 1), or ``self.n`` where there is no piece."""
        count, size = words.shape
        flat = words.ravel()
        _grow(len(flat) + 1)
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _words._powers[: len(flat)], out=sums[1:])
        out = {}
        for length in self.lengths:
            if length > size:
                break
            at = (np.arange(count)[:, None] * size + np.arange(size - length + 1)).ravel()
            h = mix((sums[at + length] - sums[at]) * _words._inverses[at])
            likely = np.flatnonzero(self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            place = np.searchsorted(self.hashes, h[likely])
            place[place == len(self.hashes)] = 0
            hit = self.hashes[place] == h[likely]
            ids = np.full(len(at), self.n, np.int32)
            ids[likely[hit]] = self.ids[place[hit]]
            out[length] = ids.reshape(count, -1)
        return out


def stretches(words: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words, with a blank before them, cut into stretches: (word numbers, equally long stretches as a byte matrix)."""
    by_size: dict[int, tuple[list[int], list[bytes]]] = {}
    for i, word in enumerate(words):
        word = b" " + word
        for at in range(0, len(word), STRETCH):
            piece = word[at : at + STRETCH]
            own = by_size.setdefault(len(piece), ([], []))
            own[0].append(i)
            own[1].append(piece)
    for size, (owners, parts) in sorted(by_size.items()):
        step = max(1, LATTICE_BYTES // size)
        for at in range(0, len(parts), step):
            some = parts[at : at + step]
            yield np.array(owners[at : at + step]), np.frombuffer(b"".join(some), np.uint8).reshape(len(some), size)


def forward(ids: dict[int, np.ndarray], size: int, probs: np.ndarray) -> np.ndarray:
    """Probability of each prefix, summed over its segmentations: (size + 1, words, languages)."""
    alpha = np.zeros((size + 1, next(iter(ids.values())).shape[0], probs.shape[1]))
    alpha[0] = 1
    for end in range(1, size + 1):
        for length, found in ids.items():
            if length <= end:
                alpha[end] += alpha[end - length] * probs[found[:, end - length]]
    return alpha


def backward(ids: dict[int, np.ndarray], size: int, probs: np.ndarray) -> np.ndarray:
    beta = np.zeros((size + 1, next(iter(ids.values())).shape[0], probs.shape[1]))
    beta[size] = 1
    for start in range(size - 1, -1, -1):
        for length, found in ids.items():
            if start + length <= size:
                beta[start] += beta[start + length] * probs[found[:, start]]
    return beta


def word_likelihoods(words: Sequence[bytes], lattice: Lattice, probs: np.ndarray) -> np.ndarray:
    """Log likelihood of each word in each language."""
    out = np.zeros((len(words), probs.shape[1]))
    for owners, block in stretches(words):
        size = block.shape[1]
        np.add.at(out, owners, np.log(forward(lattice.find(block), size, probs)[size]))
    return out


def expected_counts(words: Sequence[bytes], counts: np.ndarray, lattice: Lattice, probs: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in each language, given word counts by language."""
    total = np.zeros((lattice.n + 1, probs.shape[1]))
    for owners, block in stretches(words):
        size, ids = block.shape[1], lattice.find(block)
        alpha, beta = forward(ids, size, probs), backward(ids, size, probs)
        weight = counts[owners] / alpha[size]
        for j in range(probs.shape[1]):
            own = np.flatnonzero(weight[:, j])
            if not len(own):
                continue
            for length, found in ids.items():
                found = found[own]
                for start in range(size - length + 1):
                    use = alpha[start, own, j] * beta[start + length, own, j] * weight[own, j] * probs[found[:, start], j]
                    total[:, j] += np.bincount(found[:, start], use, lattice.n + 1)
    return total[:-1]


def batch_words(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of a text column, and per word its number and its row."""
    data, offsets = text_buffers(column)
    parts = []
    for a, b in slices(offsets):
        cut = LOWER[data[offsets[a] : offsets[b]]]
        start, end, row = word_spans(cut, offsets[a : b + 1] - offsets[a], NOT_ALNUM)
        parts.append((span_hashes(cut, start, end), start + offsets[a], end + offsets[a], row + a))
    if not parts:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, start, end, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    raw = data.tobytes()
    words = [raw[a:b].lower() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    return words, number, row


@dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray
    probs: np.ndarray  # pieces + 1 x languages; the last row is "no piece"
    lattice: Lattice


def train(
    labelled: DataFrame, pieces: Sequence[bytes], text_col: str = "text", lang_col: str = "lang",
    max_docs: int = 8000, rounds: int = 3, id_col: str = "doc_id",
) -> LanguageModel:
    """Piece probabilities by language from labelled rows.

    ``max_docs`` is the documented bound on the labelled sample: where a language has more
    rows, those with the smallest hash of their id are used, about ``max_docs`` of them. The id
    serves for nothing else. The model has pieces x languages numbers, which come back to the driver.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col).alias("h"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != ""))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    lattice = Lattice.of(pieces)
    n = len(languages)
    probs = np.full((lattice.n + 1, n), 1 / lattice.n)
    probs[-1] = 0
    if not n:
        return LanguageModel([], np.zeros(0), probs, lattice)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, max_docs / sizes[k]))])
    bucket = F.pmod("h", F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(bucket < share[F.col("lang")]).select("text", "lang")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number_of = {k: i for i, k in enumerate(languages)}
        for batch in batches:
            words, number, row = batch_words(batch.column(0))
            if words:
                lang = np.array([number_of[k] for k in batch.column(1).to_pylist()])
                pair, times = np.unique(number * n + lang[row], return_counts=True)
                yield pa.record_batch(
                    [pa.array([words[i] for i in (pair // n).tolist()], pa.binary()), pa.array(pair % n, pa.int32()), pa.array(times, pa.int64())],
                    names=["word", "lang", "times"],
                )

    counts = sample.mapInArrow(counted, "word binary, lang int, times bigint").groupBy("word")
    counts = counts.agg(*[F.sum(F.when(F.col("lang") == i, F.col("times")).otherwise(0)).cast("double").alias(f"c{i}") for i in range(n)])
    counts = write_stage(counts, "langid-words")
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((lattice, probs))

        def expected(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            lattice, probs = state.value
            total = np.zeros((lattice.n, n))
            for batch in batches:
                each = np.column_stack([batch.column(i + 1).to_numpy() for i in range(n)])
                total += expected_counts(batch.column(0).to_pylist(), each, lattice, probs)
            piece, lang = np.nonzero(total)
            yield pa.record_batch([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])], names=["piece", "lang", "uses"])

        uses = counts.mapInArrow(expected, "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses"))
        got = uses.toPandas()
        total = np.full((lattice.n, n), 0.01)
        total[got["piece"], got["lang"]] += got["uses"]
        probs = np.vstack([np.maximum(total / total.sum(axis=0), FLOOR), np.zeros((1, n))])
        state.unpersist()
    prior = np.array([sizes[k] for k in languages], float)
    return LanguageModel(languages, np.log(prior / prior.sum()), probs, lattice)


def by_bytes(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about BATCH_BYTES together, one row at least."""
    offsets = text_buffers(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score``, the posterior probability of that language.

    With ``keep``, these columns of ``docs`` stand in place of the id, so a filter by language needs no join.
    """
    state = docs.sparkSession.sparkContext.broadcast(model)
    names = list(keep) if keep is not None else [id_col]
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"), *[F.col(f"`{c}`") for c in names])

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = state.value
        for batch in (part for whole in batches if whole.num_rows for part in by_bytes(whole, 0)):
            rows = batch.num_rows
            lettered = np.array([any(map(str.isalpha, t.as_py() or "")) for t in batch.column(0)], bool)
            lang, score = np.full(rows, "und", object), np.zeros(rows)
            if model.languages:
                words, number, row = batch_words(batch.column(0))
                total = np.tile(model.prior, (rows, 1))
                if words:
                    each = word_likelihoods(words, model.lattice, model.probs)
                    for j in range(total.shape[1]):
                        total[:, j] += np.bincount(row, each[number, j], rows)
                total = np.exp(total - total.max(axis=1, keepdims=True))
                best = total.argmax(axis=1)
                lang[lettered] = np.array(model.languages, object)[best[lettered]]
                score[lettered] = (total.max(axis=1) / total.sum(axis=1))[lettered]
            yield pa.record_batch([*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    shape = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names]
    return texts.mapInArrow(predicted, ", ".join([*shape, "lang_pred string", "score double"]))


def is_held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether a row is kept from learning; a null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


@query("op7_language_id")
def op7_language_id(spark, folder: str) -> DataFrame:
    """Predicted language of every document; every fourth hash class of ids is held out from learning."""
    import public_tokenizers as vocabularies

    docs = table(spark, folder, "documents")
    pieces = public_pieces(vocabularies.path("piece_bpe_32k.model"))
    model = train(docs.where(F.col("doc_id").isNotNull() & ~is_held_out()), pieces)
    return predict(docs, model).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
