"""Byte-level BPE against tiktoken."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from vigilog.llm.bpe import decode, encode, encoder, round_trip

NAME = "byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path(NAME), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    alphabets = ["ab", "etaoin ", " \n\t", "-=*", "0123456789", "éèßñü ", "日本語テキスト", "😀👍🏽‍",
                 "".join(map(chr, range(32, 127)))]
    yield from ["", " ", "a", "<|endoftext|>", "don't we'll I'M", "x" * 5000, "ab" * 3000, " " * 700, "\x00\x01"]
    for _ in range(1500):
        alphabet = rng.choice(alphabets)
        yield "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))


def test_ids_equal_tiktoken(reference):
    own = encoder(NAME)
    import numpy as np

    for text in texts():
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()


def test_rows(spark):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (2, None, None), (None, "", "y"),
            (3, "word " * 40_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    got = round_trip(df).collect()
    assert len(got) == 5 and sorted(df.columns + ["n_tokens", "decoded"], key=str.lower) == sorted(
        [c if c != "ids" else "IDS" for c in round_trip(df).columns], key=str.lower)
    for row in got:
        assert bytes(row.decoded) == (row.text or "").encode() and len(row.ids) == 4 * row.n_tokens
    again = decode(encode(df)).collect()
    assert {(r.doc_id, hashlib.sha256(r.ids).hexdigest()) for r in again} == {
        (r.doc_id, hashlib.sha256(r.ids).hexdigest()) for r in got}
    assert round_trip(df.limit(0)).count() == 0


def test_other_vocabulary(spark):
    name = "byte_bpe_multi_50k.tiktoken"
    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    other = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = encoder(name)
    for text in ["Grüße aus Köln", "la niñez", "naïveté", "abcabc" * 50]:
        assert own.decode(own.encode(text)) == text.encode()
        assert [int.from_bytes(own.encode(text)[i:i + 4], "little") for i in range(0, len(own.encode(text)), 4)] == other.encode_ordinary(text)
