import base64
import hashlib
import random

import public_tokenizers as vocabularies
import pytest
import tiktoken

from panelcast.llm.bpe import decode, encode, merge_table, replay

PATH = vocabularies.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_matches_library(spark, library):
    rng = random.Random(1)
    texts = ["", None, "a" * 4001, " " * 300 + "x", "Zażółć gęślą jaźń 漢字 🤖\n\n\tend", "=-" * 900, "it's <|endoftext|> they'll", "abab" * 333]
    texts += ["".join(rng.choice("abnth e\n.,é漢'012") for _ in range(rng.randrange(400))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    df = spark.createDataFrame([(i, t, "x", t) for i, t in rows], "doc_id long, text string, ids string, bytes string").repartition(3)
    got = decode(encode(df, PATH, vocabularies.PATTERN), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts[r.doc_id] or ""
        assert r.ids == b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(t))
        assert bytes(r.bytes) == t.encode()


def test_replay_takes_lowest_rank_leftmost_first(library):
    rng = random.Random(2)
    words = list({bytes(rng.choice(b"aeinrst \xc3\xa9") for _ in range(rng.randrange(1, 40))) for _ in range(4000)})
    merges = merge_table(PATH)
    for word, ids in zip(words, replay(words, merges), strict=True):
        assert ids == b"".join(i.to_bytes(4, "little") for i in library._encode_single_piece(word)), word


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encode(df, PATH, vocabularies.PATTERN).count() == 0


def test_query_on_documents(spark, library):
    from panelcast.llm.registry import QUERIES

    got = {r.doc_id: r for r in QUERIES["op2_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
