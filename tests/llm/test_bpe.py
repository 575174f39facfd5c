"""BPE against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from itemnorm.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.Encoder(bpe.Vocabulary(PATH)), Tokenizer.from_file(PATH)


def same(both, text):
    mine, theirs = both
    want = theirs.encode(text, add_special_tokens=False).ids
    ids = np.frombuffer(mine.encode(text), np.int32)
    assert ids.tolist() == want
    assert bpe.decode_ids(ids, bpe.Vocabulary(PATH).tokens) == theirs.decode(want, skip_special_tokens=False) == text


def test_cases(both):
    for text in ["", " ", "a", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x" * 900, "ab" * 700, "  \n\t  x   ",
                 "don't DON'T we'll", "naïve Straße 日本語 😀‍🔥", "\x00\x1f\x85 　"]:
        same(both, text)


def test_random_texts_in_small_segments(both, monkeypatch):
    rng = random.Random(1)
    for segment, long in ((bpe.SEGMENT, bpe.LONG), (5, 3)):
        monkeypatch.setattr(bpe, "SEGMENT", segment)
        monkeypatch.setattr(bpe, "LONG", long)
        both[0].known.clear()
        for _ in range(300):
            same(both, "".join(rng.choice(" \n\t'aAzs0é<|>.,rethe　中😀") for _ in range(rng.randint(0, 60))))


def test_table(spark):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (3, "", None), (3, "Hello world", "x"), (None, "é", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(df, PATH, decoded="decoded").collect()
    assert sorted((r.decoded, len(r.ids)) for r in out) == [("", 0), ("", 0), ("Hello world", 2), ("Hello world", 2), ("é", 1)]
    again = bpe.encode(df, PATH)
    assert sorted(r.t for r in again.select(bpe.decoder(PATH)("ids").alias("t")).collect()) == sorted(r.decoded for r in out)
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
