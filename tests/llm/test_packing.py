import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as vocabularies
import pytest
from tokenizers import Tokenizer

from panelcast.llm.packing import configurations, encoded, encoder, pack, plan, tokenise

PATH = vocabularies.path("byte_bpe_50k.json")


def test_encoder_has_the_ids_of_the_vocabulary_library(spark):
    library = Tokenizer.from_file(PATH)
    own = encoder(PATH, vocabularies.PATTERN)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in [*texts, "", " ", "a\r\n\tb  c", "漢字🤖 naïve", "x" * 3000]:
        assert own.encode_ordinary(t) == library.encode(t, add_special_tokens=False).ids


def test_special_tokens_in_texts_have_their_ids(spark):
    library = Tokenizer.from_file(PATH)
    own = encoder(PATH, vocabularies.PATTERN)
    mark = "<|endoftext|>"
    texts = [mark, f"{mark} start", f"end {mark}", f"end {mark} start", mark * 2, f"{mark} {mark}\n{mark}", f"in{mark}side", f" a  {mark}  b", "<|endoftext", f"<{mark}|>", f"é{mark}漢\ud7ff", mark.upper()]
    for t in texts:
        assert own.encode(t, allowed_special="all") == library.encode(t, add_special_tokens=False).ids
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {i: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids_crc32 for r in tokenise(df, PATH, vocabularies.PATTERN).collect()} == want


def test_configurations_reach_the_bound():
    sizes, demand = np.array([60, 40, 30]), np.array([10.0, 10.0, 20.0])
    got = configurations(sizes, demand, 100)
    assert abs(sum(x for _, x in got) - (10 + 20 / 3)) < 1e-6  # ten of 60 + 40, the rest 30 + 30 + 30
    for column, _ in got:
        assert column @ sizes <= 100


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_a_packing_and_close_to_the_bound(seed):
    rng = random.Random(seed)
    capacity = 256
    lengths = [min(capacity, max(1, int(rng.lognormvariate(4 - seed % 3, 1)))) for _ in range(4000)]
    histogram = defaultdict(int)
    for k in lengths:
        histogram[k] += 1
    got = plan(dict(histogram), capacity)
    held, ranks = defaultdict(dict), defaultdict(set)
    for length, rank, count, first, each, offset in got.rows:
        for j in range(count):
            assert rank + j not in ranks[length]
            ranks[length].add(rank + j)
            held[first + j // each][offset + j % each * length] = length
    assert {k: len(v) for k, v in ranks.items()} == dict(histogram)
    assert all(v == set(range(histogram[k])) for k, v in ranks.items())
    for own in held.values():
        end = 0
        for offset in sorted(own):
            assert offset == end
            end += own[offset]
        assert end <= capacity
    assert len(held) == got.sequences <= 1.02 * sum(lengths) / capacity + 8


def test_pack_edge_rows(spark):
    texts = ["", None, "one", "word " * 9000, "word " * 2047, "word " * 2048, "word " * 2046, "one"]
    df = spark.createDataFrame([(i // 2, t, 5, 6) for i, t in enumerate(texts)], "doc_id long, text string, offset int, length int")
    got = pack(tokenise(df, PATH, vocabularies.PATTERN)).collect()
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(i // 2, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert pack(tokenise(df.limit(0), PATH, vocabularies.PATTERN)).count() == 0


def test_very_long_runs_of_blanks():
    import public_tokenizers as vocabularies
    import tokenizers

    path = vocabularies.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    for text in (" " * 3_000_000, "start" + "\n" * 1_000_000 + "end <|endoftext|>" + " " * 1_000_000 + "x"):
        assert encoded(text, path, vocabularies.PATTERN) == library.encode(text, add_special_tokens=False).ids
