import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from trackspark.llm.queries import public_tokenizer
from trackspark.llm.token_shards import Encoder, Shard, read_shards, write_shards

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("path", T.StringType())])
ROWS = [
    (5, "Hello wörld, don't\n\nstop  now.", "x"), (-3, None, "y"), (None, "a null key", None), (9, "", "z"), (7, "tie", "1"), (7, "tie", "1"),
    (2**40, " \n\n", None), (11, "<|endoftext|> 's ｆ　x  y…|| 123abc", None), (12, "word " * 30_000, None),
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizer())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


def test_round_trip(spark, library):
    manifest = write_shards(spark.createDataFrame(ROWS, SCHEMA), public_tokenizer(), partitions=3)
    got = sorted(map(tuple, read_shards(manifest).collect()), key=lambda r: r[1])
    want, start = [], 0
    for doc_id, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library(text)
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_lookup(spark, library):
    paths = [r.path for r in write_shards(spark.createDataFrame(ROWS, SCHEMA), public_tokenizer(), partitions=3).collect()]
    shards = [Shard(p) for p in paths]
    find = lambda k: [x.tolist() for s in shards for x in s.get(k)]
    assert find(7) == [library("tie")] * 2
    assert find(None) == [library("a null key")] and find(8) == []
    assert find(12) == [library("word " * 30_000)]
    absent = [k for k in range(10_000, 12_000) if any(s.may_have(k) for s in shards)]
    assert len(absent) < 200


def test_empty_table(spark):
    assert read_shards(write_shards(spark.createDataFrame([], SCHEMA), public_tokenizer())).collect() == []


def test_pieces_give_the_library_ids(library):
    import random

    r, parts = random.Random(3), [" ", "\n", "  ", "\t", "a", "Zb", "é", "'s", "don't", "1", ".", "$$$", " ", "　", "你好", "…", "\r\n", ",", "#\n", "—"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    ids, at = Encoder(public_tokenizer()).encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == library(t), repr(t)


@pytest.fixture(scope="module")
def defaults():
    """The library with nothing set."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizer())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


def test_added_tokens_give_their_ids(defaults):
    import random

    end = "<|endoftext|>"
    assert defaults(f"end {end} next") == [437, 220, 50256, 1306, 2]
    r, parts = random.Random(4), [end, end, " ", "\n", "  ", "a", "Zb", "é", "'s", "1", ".", "　", "你好", "<|", "|>", "<|endof", "text|>", "<"]
    texts = [f"end {end} next", end, end * 3, "<|endof", "text|>", *("".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(3000))]
    raw = [t.encode() for t in texts]
    ids, at = Encoder(public_tokenizer(), added=True).encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == defaults(t), repr(t)


def test_added_tokens_in_the_queries(spark, defaults, tmp_path):
    import corpus_pipeline
    from trackspark.llm.queries import op10_token_shards

    rows = [(1, "end <|endoftext|> next", None), (2, "plain", None), (3, "<|endoftext|>", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for got in (op10_token_shards(spark, str(tmp_path)), corpus_pipeline.token_ids(spark, docs, str(tmp_path))):
        start = 0
        for row, (doc_id, text, _) in zip(sorted(got.collect()), rows, strict=True):
            ids = defaults(text)
            assert tuple(row) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)


def _ids(texts, **kw):
    raw = [t.encode() for t in texts]
    ids, at = Encoder(public_tokenizer(**kw)).encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


def test_pieces_that_hashes_confuse(library, monkeypatch):
    word = "a"
    for _ in range(10):  # the Thue-Morse word and its complement: no polynomial hash modulo 2**64 tells them apart
        word += word.translate({97: 98, 98: 97})
    texts = [f"{word} {word[1024:]}", word[:512] * 40, "x" * 1_000_000]
    assert _ids(texts) == [library(t) for t in texts]
    # were every hash the same, pieces would still be told apart by their bytes
    monkeypatch.setattr("trackspark.llm.token_shards.word_hash", lambda data, s, e: np.zeros(len(s), np.uint64))
    texts = ["one two one", "two", "", "three one", "thref one"]
    assert _ids(texts) == [library(t) for t in texts]


def test_other_tokenizers_take_whole_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizer("word_bpe_49k.json"))
    texts = ["Hello, World  two\n\nlines", "", "don't   stop"]
    assert _ids(texts, name="word_bpe_49k.json") == [t.encode(x, add_special_tokens=False).ids + [2] for x in texts]


def test_one_identifier_takes_several_shards(spark, library):
    rows = [(4, f"text {k}", None) for k in range(400)] + [(None, f"null {k}", None) for k in range(200)] + [(5, "last", None)]
    manifest = write_shards(spark.createDataFrame(rows, SCHEMA), public_tokenizer(), partitions=6)
    assert manifest.count() > 3
    got = sorted(read_shards(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 200 + [4] * 400 + [5]
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(np.array(library(t), "<u4").tobytes()) for _, t, _ in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
