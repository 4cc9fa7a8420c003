import random

import pytest
from pyspark.sql import functions as F

from quarrygraph.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return t


R = random.Random(7)
ODD = [
    None, "", " ", "\n\n \t x", "<|endoftext|> is text", "a" * 20_000, "ab" * 3_000, "".join(R.choice("abcdefghijklmnop") for _ in range(1_500)), "I'll don't I'LL", "́e ½²Ⅷ", "\U0001f642‍\U0001f469", "﻿x\x00\x1c\x85 　b",
    "漢字" * 200, "0123456789" * 40, "!" * 999, "ʼn᠎ ­x", " lead and trail ",
]


def test_same_ids_as_library(public):
    enc = bpe.Encoder.of(bpe.DEFAULT_VOCABULARY)
    fuzz = ["".join(chr(R.choice([R.randrange(1, 0x250), R.randrange(0x2000, 0x3100), R.randrange(1, 0x80), R.randrange(0x1F300, 0x1FAFF)])) for _ in range(50)) for _ in range(200)]
    texts = ODD + fuzz
    want = [e.ids for e in public.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in enc.encode(texts)] == want


def test_words_of_many_rounds_and_full_cache(public, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 5)
    monkeypatch.setattr(bpe, "CHUNK", 64)
    enc = bpe.Encoder(bpe.DEFAULT_VOCABULARY)
    for text in ("one two three four five six seven", "internationalisation " * 3 + "x" * 300, "eins zwei drei"):
        assert enc.encode([text])[0].tolist() == public.encode(text, add_special_tokens=False).ids
    assert len(enc.known) <= 7


def test_documents(spark, public):
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(ODD)] + [(3, ODD[3], 9), (None, "x", 9)], "doc_id bigint, text string, ids int").withColumn("tokens", F.lit(1))
    got = bpe.encode_documents(df).collect()
    assert len(got) == len(ODD) + 2
    want = {i: public.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(ODD)} | {None: public.encode("x").ids}
    assert all(list(r.ids) == want[r.doc_id] for r in got)
    assert {r.doc_id: r.tokens for r in bpe.count_tokens(df).collect()} == {k: len(v) for k, v in want.items()}
    assert bpe.encode_documents(df.limit(0)).count() == 0


def test_round_trip(public):
    enc = bpe.Encoder.of(bpe.DEFAULT_VOCABULARY)
    texts = [t for t in ODD if t]
    assert [public.decode(x.tolist(), skip_special_tokens=False) for x in enc.encode(texts)] == texts


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Encoder("/opt/tokenizers/word_bpe_49k.json")
    assert bpe.supported({"pre_tokenizer": {"type": "ByteLevel"}, "model": {"merges": []}}, "x") == {"merges": []}
    for file in ({"model": {}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}, "model": {}}, {"pre_tokenizer": {"type": "ByteLevel"}, "model": {"type": "Unigram"}}):
        with pytest.raises(ValueError):
            bpe.supported(file, "x")
