"""BPE ids and round trip next to the tokenizers library."""

import hashlib
import random

import pytest
import tokenizers

from neoquarry.llm import bpe, queries

PATH = queries.tokenizer_path()
LETTERS = "abcdeéèßñ ΣσἈ'sS'll'1२½Ⅷ一ぁ́̈İıẞﬁ​\x85\x1c\x1f\xa0　\t\n<|>&*#%😀🇩🇪"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.tokenizer_text(PATH))


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_random_texts(library, codec):
    rng = random.Random(1)
    for i in range(5000):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 30)))
        text += " <|endoftext|>x<|STARTOFTEXT|>" + text + "<|startoftext|>" if i % 50 == 0 else ""
        ids = codec.encode(text)
        assert (ids, codec.decode(ids)) == expected(library, text)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 4000, "é" * 3000, "thethe" * 900, "!" * 5000, " ", "\n\t"])
def test_very_long_words_and_white_space(library, codec, text):
    assert codec.encode(text) == expected(library, text)[0]


def test_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 3)
    monkeypatch.setattr(bpe, "MEMORY_PAIRS", 3)
    codec = bpe.Codec(bpe.tokenizer_text(PATH))
    text = "some words of a text that go on and on and on"
    assert codec.encode(text) == expected(library, text)[0]
    assert len(codec.memory) <= 3


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids, text = expected(library, r.text)
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(text)))
    assert sorted(tuple(r) for r in queries.op5_bpe(spark, folder).collect()) == sorted(want)


def test_nulls_repeats_extra_columns_and_nothing(spark, library):
    df = spark.createDataFrame([(1, None, 2), (1, "", 2), (None, "Hello  You", 3), (None, "Hello  You", 3)], "doc_id long, text string, ids int")
    got = sorted(map(repr, (tuple(r) for r in bpe.encoded(df, PATH).collect())))
    ids, text = expected(library, "Hello  You")
    assert got == sorted(map(repr, [(1, [], ""), (1, [], ""), (None, ids, text), (None, ids, text)]))
    assert bpe.digests(df.limit(0), PATH).collect() == []
