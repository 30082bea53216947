"""Benchmark items inside documents, in whatever order their passages stand: greedy string tiling.

The benchmark is the stated set: it is cut into blocks of bounded size, and each block is sent to
all tasks and held against every document. Runs of ``SHORTEST`` words that a document shares with
an item are seeds. All tiles consist of seeds, so tiling works on the seeded words alone: windows
of a search length are hashed by a running hash, equal ones are extended to maximal matches, the
longest are marked first and never overlap, and the search length goes down until it is
``SHORTEST``. The share of an item's words that tiles cover decides.
"""

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.llm.common import checkpointed, prepare, query, table, whole_text, without

SHORTEST = 5            # words of a tile, and of a seed
COVERAGE = 0.6          # share of an item's words
BLOCK_WORDS = 500_000   # words of the benchmark that tasks hold at a time

_WORD = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode())
        return value


_HASHES = Hashes()  # of a Python worker, over all its batches


def seed_hashes(words: list[str], hashes: Hashes, size: int = SHORTEST) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    h = np.array([hashes[w] for w in words], np.uint64)
    n = len(h) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out = out * np.uint64(_BASE) + h[k:k + n]
    return out


def _free_windows(words, hashes, marked, size):
    """(start, hash) of each window of ``size`` unmarked words, the hash rolled along."""
    top = pow(_BASE, size - 1, 1 << 64)
    value = run = 0
    for i, w in enumerate(words):
        if marked[i] or w is None:
            value = run = 0
            continue
        if run >= size:
            value -= hashes[words[i - size]] * top
        value = (value * _BASE + hashes[w]) & _ALL
        run += 1
        if run >= size:
            yield i - size + 1, value


def tiles(item: list[str], doc: list[str | None], hashes: Hashes,
          shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, words), longest first.

    ``None`` in ``doc`` stands for a word that can match nothing. Of equally long matches the one
    that starts first in the item, then in the document, is marked first.
    """
    item_marked, doc_marked = bytearray(len(item)), bytearray(len(doc))
    out = []
    size = max(shortest, min(len(item), len(doc)) // 2)
    while True:
        at = defaultdict(list)
        for start, value in _free_windows(item, hashes, item_marked, size):
            at[value].append(start)
        matches = []
        for d, value in _free_windows(doc, hashes, doc_marked, size):
            for i in at.get(value, ()):
                if i and d and item[i - 1] == doc[d - 1] and not item_marked[i - 1] and not doc_marked[d - 1]:
                    continue  # begins earlier
                n = 0
                while (i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n]
                       and not item_marked[i + n] and not doc_marked[d + n]):
                    n += 1
                if n >= size:
                    matches.append((-n, i, d))
        for n, i, d in sorted(matches):
            n = -n
            # earlier tiles may have taken an end of this match
            while n and (item_marked[i] or doc_marked[d]):
                i, d, n = i + 1, d + 1, n - 1
            free = 0
            while free < n and not item_marked[i + free] and not doc_marked[d + free]:
                free += 1
            if free >= size:
                item_marked[i:i + free] = b"\1" * free
                doc_marked[d:d + free] = b"\1" * free
                out.append((i, d, free))
        if not matches and size == shortest:
            return out
        if not matches:
            size = max(shortest, size // 2)


class Block:
    """Some items; those of fewer than SHORTEST words have seeds and tiles of their own length."""

    def __init__(self, items: list[tuple[int | None, list[str]]]):
        by_size = defaultdict(list)
        for item in items:
            by_size[min(SHORTEST, len(item[1]))].append(item)
        self.parts = [_Seeded(own, size) for size, own in sorted(by_size.items()) if size]

    def leaks(self, text: str, hashes: Hashes, coverage: float) -> list[dict]:
        words = words_of(text)
        return [x for part in self.parts for x in part.leaks(words, hashes, coverage)]


class _Seeded:
    """Some items with the seeds of ``size`` words they hold."""

    def __init__(self, items: list[tuple[int | None, list[str]]], size: int):
        self.items, self.size = items, size
        hashes = Hashes()
        seeds = [np.unique(seed_hashes(words, hashes, size)) for _, words in items]
        owner = np.repeat(np.arange(len(items)), [len(s) for s in seeds])
        every = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.seeds, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))

    def leaks(self, words: list[str], hashes: Hashes, coverage: float) -> list[dict]:
        own = seed_hashes(words, hashes, self.size)
        if not len(own) or not len(self.seeds):
            return []
        slot = np.minimum(np.searchsorted(self.seeds, own), len(self.seeds) - 1)
        hits = np.flatnonzero(self.seeds[slot] == own)
        if not len(hits):
            return []
        slot = slot[hits]
        counts = self.first[slot + 1] - self.first[slot]
        owners = np.concatenate([self.owner[self.first[s]:self.first[s + 1]] for s in slot])
        at = np.repeat(hits, counts)
        out = []
        for k, n in zip(*np.unique(owners, return_counts=True), strict=True):
            item_id, item = self.items[k]
            if n * self.size < coverage * len(item):
                continue  # so few seeds cannot cover it
            excerpt = _excerpt(words, at[owners == k], self.size)
            found = tiles(item, excerpt[0], hashes, self.size)
            covered = sum(t[2] for t in found) / len(item)
            if covered >= coverage:
                out.append({"item_id": item_id, "coverage": covered, "tiles": [
                    {"item_word": i, "doc_word": excerpt[1][d], "words": w} for i, d, w in sorted(found)]})
        return out


def _excerpt(words: list[str], starts: np.ndarray, size: int) -> tuple[list[str | None], list[int]]:
    """The seeded words, gaps as None, and where each stands in the document."""
    keep = np.unique(starts[:, None] + np.arange(size))
    out: list[str | None] = []
    places: list[int] = []
    last = -1
    for p in keep.tolist():
        if p != last + 1:
            out.append(None)
            places.append(p)
        out.append(words[p])
        places.append(p)
        last = p
    return out, places


def _blocks(benchmark: DataFrame):
    """The items, a bounded number of words at a time. Items without words take no part; a null id is
    left out where the same text has an id."""
    held, size = [], 0
    rows = (benchmark.where(F.col("text").isNotNull()).groupBy("text").agg(F.collect_set("item_id").alias("ids"))
            .select(F.explode_outer("ids").alias("item_id"), "text").orderBy("item_id", "text"))
    for row in rows.toLocalIterator():
        words = words_of(row["text"])
        if not words:
            continue
        if held and size + len(words) > BLOCK_WORDS:
            yield Block(held)
            held, size = [], 0
        held.append((row["item_id"], words))
        size += len(words)
    yield Block(held)


_LEAKS = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()),
    T.StructField("tiles", T.ArrayType(T.StructType([
        T.StructField("item_word", T.IntegerType()), T.StructField("doc_word", T.IntegerType()),
        T.StructField("words", T.IntegerType())])))]))


def _finder(block, coverage: float):
    kind = pa.list_(pa.struct([
        ("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct(
            [("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())])))]))

    @F.arrow_udf(_LEAKS)
    def leaks(texts: pa.Array) -> pa.Array:
        own = block.value
        return pa.array([own.leaks(t, _HASHES, coverage) for t in texts.to_pylist()], kind)

    return leaks


def with_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Adds ``leaks``: (item_id, coverage, tiles) of each item covered to ``coverage`` at least.

    Null and empty texts, and an empty benchmark, give empty arrays. Repeated rows get equal
    arrays; items that repeat an id and text count once. A column of that name is replaced.
    """
    spark = prepare(docs.sparkSession)
    out = without(docs, ["leaks"])
    for number, block in enumerate(_blocks(benchmark)):
        leaks = _finder(spark.sparkContext.broadcast(block), coverage)
        if number:  # one block in the tasks at a time
            out = checkpointed(out).withColumn("leaks", F.concat("leaks", leaks(whole_text())))
        else:
            out = out.withColumn("leaks", leaks(whole_text()))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that hold no item."""
    rest = without(docs, ["leaks"])
    return with_leaks(rest, benchmark, coverage).where(F.size("leaks") == 0).drop("leaks")


@query("op9_benchmark_tiling")
def op9_benchmark_tiling(spark, sf):
    found = with_leaks(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"),
        F.sort_array("leaks.item_id").alias("item_ids"),
        F.coalesce(F.array_max("leaks.coverage"), F.lit(0.0)).alias("coverage"))
