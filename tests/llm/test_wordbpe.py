"""Words cut at forced boundaries against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vigilog.llm.common import table
from vigilog.llm.memo import Memo
from vigilog.llm.wordbpe import op12_word_fragments, word_encoder, word_round_trip

NAME = "word_bpe_49k.json"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


def texts():
    rng = random.Random(4)
    alphabets = ["ab", "etaoin ", " \n\t", "-=*'", "0123456789", "éèßñüÀÉŐſſﬁ ", "日本語テキスト", "😀👍🏽‍", "ΣΑσς İIı",
                 "éä ñ", "\x1c\x1f\x85\xa0 a ", "²³¼ªº×÷µ", "ÀàÐðÞþĲĳŉ", "'sdtlm re",
                 "".join(map(chr, range(32, 127))), "".join(map(chr, range(0xA0, 0x250)))]
    yield from ["", " ", "a", "<|endoftext|>", "x<|startoftext|>y<|endoftext|><|endoftext|> z", "<|StartOfText|>", "don't WE'LL I'M it'd",
                "x" * 3000, "ab" * 2000, " " * 700, "\x00\x01", "</w>", "a</w>b", "ΩÅﬁ", "𐐀𐐨", "\U00010d50\U00016ea0"]
    for _ in range(1200):
        alphabet = rng.choice(alphabets)
        yield "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 50)))


def test_ids_and_text_equal_the_library(library):
    own = word_encoder(NAME)
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(own.encode(text), "<i4")
        assert got.tolist() == want, repr(text)
        assert own.decode(got) == library.decode(want, skip_special_tokens=False), repr(text)


def test_every_settled_character(library):
    own = word_encoder(NAME)
    settled = [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]
    for c in settled:
        for text in (f"a{chr(c)}b1{chr(c)}", chr(c) * 2):
            assert np.frombuffer(own.encode(text), "<i4").tolist() == library.encode(text, add_special_tokens=False).ids, hex(c)


def test_cuts_are_forced():
    """No token holds the two symbols at a cut, and every other pair stands inside some token."""
    own = word_encoder(NAME)
    rng = random.Random(1)
    cuts = 0
    for _ in range(300):
        word = "".join(chr(rng.randrange(256)) for _ in range(rng.randint(1, 12)))
        parts = own.cut(word)
        assert "".join(parts) == word
        cuts += len(parts) - 1
        for left, right in zip(parts, parts[1:]):
            assert not any(left[-1] + right[0] in token for token in own.ids)
        assert all(part[i:i + 2] in own.inner for part in parts for i in range(len(part) - 1))
    assert cuts > 300


def test_query_equals_the_library(spark, library):
    want = {}
    for r in table(spark, SF, "documents").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = op12_word_fragments(spark, SF)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_rows(spark):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (2, None, None), (None, "", "y"), (3, "word " * 40_000, "z"),
            (4, "w" * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    got = word_round_trip(df)
    assert got.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    by = {(r.doc_id, r.text): r for r in got.collect()}
    assert got.count() == 6 and by[2, None].ids == [] == by[None, ""].ids and by[2, None].decoded == ""
    assert by[3, "word " * 40_000].n_tokens == 40_000 and by[1, "Hello world"].decoded == "hello</w> world</w>"
    assert word_round_trip(df.limit(0)).count() == 0


def test_memo_is_bounded():
    made = []
    memo = Memo(lambda k: made.append(k) or len(k), kept=3, longest=4)
    assert [memo[k] for k in ("a", "bb", "a", "ccc", "a", "dddd", "a", "eeeee", "eeeee")] == [1, 2, 1, 3, 1, 4, 1, 5, 5]
    assert made == ["a", "bb", "ccc", "dddd", "eeeee", "eeeee"] and len(memo) + len(memo.old) <= 6
