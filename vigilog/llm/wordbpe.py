"""BPE over words with forced boundaries: certain cuts first, merges within fragments only.

Two neighbouring symbols that stand side by side in no token of the vocabulary can never end up in
one token, so the text is certainly cut between them. Every word is split at all such places; the
fragments are merged independently, each distinct one once as long as it is remembered, and their
tokens are put one after the other.

A symbol is a byte, or the last byte of a word, which is another symbol (the vocabulary marks word
ends): 512 symbols, written as the characters 0 to 511.
"""

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.llm.common import query, table, whole_text, without
from vigilog.llm.memo import Memo

WORDS_KEPT = 150_000
FRAGMENTS_KEPT = 50_000
LONGEST_KEPT = 64

# characters on whose class and case all Unicode versions in use agree; other texts are cut into
# words by the tokenizer file's own normalizer and splitter, at a higher price
_SETTLED = regex.compile(r"[^\x00-ɏ‐-‧‰-⁞]")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files of this kind."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordEncoder:
    """Encodes and decodes by a tokenizer file (JSON) of BPE with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self._spec = json.load(f)
        model, self._letters = self._spec["model"], _byte_letters()
        self._suffix = model["end_of_word_suffix"]
        ids = {self._symbols(t): i for t, i in model["vocab"].items()}
        self.merges = {(a, b): (rank, ids[a + b]) for rank, (a, b) in enumerate(
            tuple(map(self._symbols, m if isinstance(m, list) else m.split(" "))) for m in model["merges"])}
        self.ids = ids
        self.shown = [""] * (1 + max([*ids.values(), *(t["id"] for t in self._spec["added_tokens"])]))
        for token, i in model["vocab"].items():
            self.shown[i] = token
        self.special = {t["content"]: t["id"] for t in self._spec["added_tokens"]}
        for token, i in self.special.items():
            self.shown[i] = token
        self.inner = {t[i:i + 2] for t in ids for i in range(len(t) - 1)}  # pairs inside some token
        own = Tokenizer.from_file(path)
        self._normalizer, self._splitter = own.normalizer, own.pre_tokenizer
        split = next(p for p in self._spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = regex.compile(split["pattern"]["Regex"]).findall
        self._specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.fragments = Memo(self.merge, FRAGMENTS_KEPT, LONGEST_KEPT)
        self.words = Memo(self._word, WORDS_KEPT, LONGEST_KEPT)
        self.odd_words = Memo(self._odd_word, WORDS_KEPT // 8, LONGEST_KEPT)

    def _symbols(self, token: str) -> str:
        last = token.endswith(self._suffix) and len(token) > len(self._suffix)
        body = [self._letters[c] for c in (token[:-len(self._suffix)] if last else token)]
        return "".join(map(chr, body[:-1])) + chr(body[-1] + 256 * last)

    def cut(self, symbols: str) -> list[str]:
        """The fragments between all forced boundaries."""
        inner, out, start = self.inner, [], 0
        for i in range(1, len(symbols)):
            if symbols[i - 1:i + 1] not in inner:
                out.append(symbols[start:i])
                start = i
        return [*out, symbols[start:]]

    def merge(self, fragment: str) -> list[int]:
        """The ids of one fragment: the neighbours of lowest rank are merged first, from the left."""
        if fragment in self.ids and len(fragment) == 1:
            return [self.ids[fragment]]
        parts, merges = list(fragment), self.merges
        none = (1 << 60, 0)
        ranks = [merges.get(p, none)[0] for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none[0]:
                break
            out, i = [], 0
            while i < len(parts):
                if i < len(ranks) and ranks[i] == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
            ranks = [merges.get(p, none)[0] for p in zip(parts, parts[1:])]
        return [self.ids[p] for p in parts]

    def encode_symbols(self, symbols: str) -> bytes:
        """Packed ids of one word."""
        fragments = self.fragments
        return np.array([i for f in self.cut(symbols) for i in fragments[f]], "<i4").tobytes()

    def _word(self, word: str) -> bytes:
        raw = word.encode().decode("latin-1")
        return self.encode_symbols(raw[:-1] + chr(ord(raw[-1]) + 256))

    def _odd_word(self, letters: str) -> bytes:
        own = [self._letters[c] for c in letters]
        return self.encode_symbols("".join(map(chr, own[:-1])) + chr(own[-1] + 256))

    def _plain(self, text: str) -> bytes:
        """Packed ids of a text without special tokens."""
        if text.isascii():
            return b"".join(map(self.words.__getitem__, self._words(text.lower())))
        if _SETTLED.search(text) is None:
            import unicodedata

            return b"".join(map(self.words.__getitem__, self._words(unicodedata.normalize("NFC", text).lower())))
        pieces = self._splitter.pre_tokenize_str(self._normalizer.normalize_str(text))
        return b"".join([self.odd_words[p] for p, _ in pieces])

    def encode(self, text: str) -> bytes:
        """Packed ids (little-endian, 32 bits each); a special token in the text is one id."""
        if "<|" not in text:
            return self._plain(text)
        return b"".join(np.array([self.special[part]], "<i4").tobytes() if part in self.special else self._plain(part)
                        for part in self._specials(text) if part)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens as the vocabulary shows them, with spaces between: the file names no decoder."""
        return " ".join(map(self.shown.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def word_encoder(name: str) -> WordEncoder:
    """One per Python worker; the vocabulary files are installed on every machine."""
    import public_tokenizers

    return WordEncoder(public_tokenizers.path(name))


_CODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def word_round_trip(df: DataFrame, vocabulary: str = "word_bpe_49k.json", text: str = "text") -> DataFrame:
    """Adds ``ids`` (array of integers), ``n_tokens`` and ``decoded`` (the text that the ids stand for).

    Null, empty and blank texts have no ids and decode to an empty text. Rows are independent:
    repeated rows give equal ids, texts of any length are encoded whole. Columns of the input named
    like the added ones are replaced.
    """
    @F.arrow_udf(_CODED)
    def coded(texts: pa.Array) -> pa.Array:
        own = word_encoder(vocabulary)
        packed = [own.encode(t) for t in texts.to_pylist()]
        flat = np.frombuffer(b"".join(packed), "<i4")
        ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
        decoded = [own.decode(flat[a:b]) for a, b in zip(ends, ends[1:])]
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
        return pa.StructArray.from_arrays([ids, pa.array(decoded, pa.string())], ["ids", "decoded"])

    rest = without(df, ["ids", "decoded", "n_tokens", "_coded"])
    both = rest.withColumn("_coded", coded(whole_text(text)))
    return both.select(
        *[f"`{c}`" for c in rest.columns], F.col("_coded.ids").alias("ids"),
        F.size("_coded.ids").cast("long").alias("n_tokens"), F.col("_coded.decoded").alias("decoded"))


@query("op12_word_fragments")
def op12_word_fragments(spark, sf):
    coded = word_round_trip(table(spark, sf, "documents").select("doc_id", "text"))
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", "n_tokens", F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
