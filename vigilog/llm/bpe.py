"""Byte-level BPE in linear time: longest matches, adjacent-token compatibility, backtracking.

A sequence of tokens is the one that the merges would give if and only if every two neighbours
stay as they are when their joined bytes are merged on their own. So encoding needs no merge
queue: take the longest token that starts here (an Aho-Corasick automaton over the bytes, mapped
to Latin-1, finds all matches of a piece in one pass), keep it if it is compatible with the token
before it, else try its next shorter prefix, and step back when none is left. A position that has
been given up is never tried again, which bounds the work by the length of the piece.
"""

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.llm.common import query, table, whole_text, without
from vigilog.llm.memo import Memo

PIECES_KEPT = 100_000
PAIRS_KEPT = 200_000
LONGEST_KEPT = 64


class Encoder:
    """Encodes and decodes by a file of ranks (base64 token, rank per line)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length = [len(t) for t in self.bytes_of]
        self.shorter = [self._prefix(t) for t in self.bytes_of]
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.bytes_of))]
        self.pairs = Memo(self._stays, PAIRS_KEPT)
        self.findall = regex.compile(pattern).findall
        self.pieces = Memo(self._piece, PIECES_KEPT, LONGEST_KEPT)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> "Encoder":
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return cls(ranks, pattern)

    def _prefix(self, token: bytes) -> int:
        """The longest token that is a proper prefix, or -1."""
        return next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1)
                     if token[:n] in self.ranks), -1)

    def merged(self, text: bytes) -> list[int]:
        """By the definition: merge the neighbours of lowest rank, leftmost first."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i)
                           for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _stays(self, pair: int) -> bool:
        left, right = divmod(pair, len(self.bytes_of))
        return self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def compatible(self, left: int, right: int) -> bool:
        return self.pairs[left * len(self.bytes_of) + right]

    def _piece(self, piece: str) -> bytes:
        """Packed ids of a piece (little-endian, 32 bits each)."""
        raw = piece.encode()
        own = self.ranks.get(raw)
        return self.packed[own] if own is not None else b"".join(map(self.packed.__getitem__, self.encode_piece(raw)))

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        longest = [0] * (len(piece) + 1)
        length = self.length
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[rank]] = rank  # ends ascend: the longest is written last
        open_ends = bytearray(b"\1" * (len(piece) + 1))
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            end = at + length[token]
            if open_ends[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at, token = end, longest[end]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                open_ends[at] = 0
                token = out.pop()
                at -= length[token]
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """One per Python worker; the vocabulary files are installed on every machine."""
    import public_tokenizers

    return Encoder.from_file(public_tokenizers.path(name), public_tokenizers.PATTERN)


def encode(df: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", text: str = "text") -> DataFrame:
    """Adds ``ids`` (binary: little-endian unsigned 32-bit integers) and ``n_tokens``.

    Null texts count as empty: no ids. Rows are independent; repeated rows give equal ids.
    Columns of the input named like these two are replaced.
    """
    @F.arrow_udf(T.BinaryType())
    def ids(texts: pa.Array) -> pa.Array:
        own = encoder(vocabulary)
        return pa.array([own.encode(t) for t in texts.to_pylist()], pa.binary())

    return (without(df, ["ids", "n_tokens"]).withColumn("ids", ids(whole_text(text)))
            .withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long")))


def decode(df: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary) of packed ids; null ids count as none."""
    @F.arrow_udf(T.BinaryType())
    def decoded(packed: pa.Array) -> pa.Array:
        own = encoder(vocabulary)
        return pa.array([own.decode(p) for p in packed.to_pylist()], pa.binary())

    none = F.lit(b"")
    return without(df, ["decoded"]).withColumn("decoded", decoded(F.coalesce(F.col(ids), none)))


def round_trip(df: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken",
               text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the rows."""
    kind = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    @F.arrow_udf(kind)
    def both(texts: pa.Array) -> pa.Array:
        own = encoder(vocabulary)
        ids = [own.encode(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array(ids, pa.binary()), pa.array([own.decode(i) for i in ids], pa.binary())],
            ["ids", "decoded"])

    rest = without(df, ["ids", "decoded", "n_tokens", "_coded"])
    coded = rest.withColumn("_coded", both(whole_text(text)))
    return coded.select(
        *[f"`{c}`" for c in rest.columns], F.col("_coded.ids").alias("ids"),
        (F.octet_length("_coded.ids") / 4).cast("long").alias("n_tokens"),
        F.col("_coded.decoded").alias("decoded"))


@query("op2_byte_bpe")
def op2_byte_bpe(spark, sf):
    coded = round_trip(table(spark, sf, "documents").select("doc_id", "text"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
