"""Ranked search by range maxima over posting lists, best document intervals first.

Documents are dealt to shards of bounded postings. In a shard, a posting list holds the impacts of
one term by document, and a sparse table over all lists answers the place of the greatest impact
in any range of a list. The score of no document in an interval exceeds the sum of its terms'
range maxima, so intervals are taken best first: the document at the greatest impact is scored
and splits its interval in two. When no interval left can beat the documents found, they are the
shard's answer; the shards' answers merge to the best of all.
"""

import heapq
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilog.llm.common import checkpointed, prepare, query, table, utf8, whole_text

TOP = 20
TERMS = 100_000            # distinct terms of the items that are searched for at a time; more take further passes
SHARD_POSTINGS = 1 << 20   # of a shard, beside one document's
AT_ONCE = 24               # intervals of an item that are split in one step
NO_ID = (1 << 63) - 1      # rows without an id come after all others

# letters and digits of ASCII and all other characters make terms; A-Z count as a-z
_TERMS = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


class Shard:
    """The posting lists of some documents, in order of term and document, and their sparse table."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray,
                 rarity: np.ndarray):
        """A document has an id, a number of postings, and ``rarity`` (the m of its length)."""
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        doc = np.repeat(place, sizes)
        tf = tfs.astype(np.int64)
        impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(rarity, sizes)))
        self.ids = ids[order]
        key = (terms.astype(np.int64) << 32) | doc
        by_key = np.argsort(key, kind="stable")
        self.key, self.impact = key[by_key], impact[by_key]
        self.levels = [np.arange(len(key), dtype=np.int32)]
        longest = np.unique(terms, return_counts=True)[1].max(initial=1)
        step = 1
        while 2 * step <= longest:
            low = self.levels[-1]
            left, right = low[:-step], low[step:]
            self.levels.append(np.where(self.impact[left] >= self.impact[right], left, right))
            step *= 2
        self.flat = np.concatenate(self.levels) if len(key) else np.empty(0, np.int32)
        self.offsets = np.cumsum([0, *map(len, self.levels[:-1])])
        self.levels = None

    def highest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of the greatest impact in each range [a, b), the first one of equals; -1 of an empty range."""
        out = np.full(a.shape, -1, np.int64)
        live = b > a
        lo, hi = a[live], b[live]
        level = np.frexp(hi - lo)[1] - 1
        base = self.offsets[level]
        left, right = self.flat[base + lo], self.flat[base + hi - (1 << level)]
        out[live] = np.where(self.impact[left] >= self.impact[right], left, right)
        return out

    def search(self, terms: np.ndarray, times: np.ndarray, top: int, found: list) -> list:
        """The best ``top`` of ``found`` and this shard's documents, as sorted (-score, id).

        An item has distinct terms and how often it holds each.
        """
        n = len(self.ids)
        a = np.searchsorted(self.key, terms << 32)
        b = np.searchsorted(self.key, (terms << 32) + n)
        held = b > a
        terms, times, a, b = terms[held], times[held], a[held], b[held]
        if not len(terms):
            return found
        best = [(-s, -i) for s, i in found]  # the worst one first
        heapq.heapify(best)
        heap: list = []

        def push(a, b, first):
            """Intervals by their posting ranges (a row each) and first document."""
            at = self.highest(a, b)
            most = np.where(at >= 0, self.impact[at], 0) * times
            bound = most.sum(1)
            which = most.argmax(1)
            split = self.key[at[np.arange(len(at)), which]] & 0xFFFFFFFF
            for k in np.flatnonzero(bound > 0).tolist():
                if hopeful(int(bound[k]), int(first[k])):
                    heapq.heappush(heap, (-int(bound[k]), int(first[k]), int(split[k]), a[k], b[k]))

        def hopeful(bound, first):
            if len(best) < top:
                return bound > 0
            worst = best[0]
            return bound > worst[0] or bound == worst[0] and int(self.ids[first]) < -worst[1]

        push(a[None, :], b[None, :], np.zeros(1, np.int64))
        while heap:
            some = []
            while heap and len(some) < AT_ONCE:
                x = heapq.heappop(heap)
                if not hopeful(-x[0], x[1]):
                    heap.clear()  # none of the rest can do better: bounds fall, and among equals first documents rise
                    break
                some.append(x)
            if not some:
                break
            first = np.array([x[1] for x in some])
            split = np.array([x[2] for x in some])
            a, b = (np.stack([x[k] for x in some]) for k in (3, 4))
            want = (terms << 32)[None, :] | split[:, None]
            mid = np.searchsorted(self.key, want)
            here = (mid < b) & (self.key[np.minimum(mid, len(self.key) - 1)] == want)
            mid = np.clip(mid, a, b)
            score = (np.where(here, self.impact[np.minimum(mid, len(self.key) - 1)], 0) * times).sum(1)
            for s, d in zip(score.tolist(), split.tolist(), strict=True):
                entry = (s, -int(self.ids[d]))
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            push(np.concatenate([a, mid + here]), np.concatenate([mid, b]), np.concatenate([first, np.minimum(split + 1, n - 1)]))
        return sorted((-s, -i) for s, i in best)


def _postings(numbers):
    """(doc_id, n, terms, tfs): of each document the number of its terms, and the searched ones it holds."""
    def postings(batches):
        number = numbers.value
        for batch in batches:
            n, sizes, terms, tfs = [], [0], [], []
            for text in utf8(batch["text"]):
                own = terms_of(text)
                n.append(len(own))
                seen: dict[int, int] = {}
                for t in map(number.get, own):
                    if t is not None:
                        seen[t] = seen.get(t, 0) + 1
                terms += seen
                tfs += seen.values()
                sizes.append(len(terms))
            ends = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "n": pa.array(n, pa.int64()),
                "terms": pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                "tfs": pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))})

    return postings


def _searched(weights, items, total: int, length: int, top: int, shard_postings: int):
    """(item_id, doc_id, score): the best documents of a task, shard after shard."""
    def searched(batches):
        best: dict[int, list] = {}

        def shard(held):
            ids, n, sizes = (np.concatenate([h[k] for h in held]) for k in range(3))
            terms, tfs = (np.concatenate([h[k] for h in held]) for k in (3, 4))
            own = Shard(ids, sizes, terms, tfs, weights.value, 100 - 25 + (25 * n * total) // length)
            for item, (wanted, times) in items.value.items():
                best[item] = own.search(wanted, times, top, best.get(item, []))

        held, size = [], 0
        for batch in batches:
            lists = batch["terms"]
            sizes = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            # a batch may be larger than a shard: it is cut between documents
            cuts = np.flatnonzero(np.diff((np.cumsum(sizes) + size) // shard_postings, prepend=size // shard_postings))
            flat, counts = np.asarray(lists.flatten()), np.asarray(batch["tfs"].flatten())
            ends, ids = np.concatenate([[0], np.cumsum(sizes)]), np.asarray(batch["doc_id"])
            n = np.asarray(batch["n"])
            for lo, hi in zip([0, *(cuts + 1)], [*(cuts + 1), len(sizes)], strict=True):
                part = slice(ends[lo], ends[hi])
                held.append((ids[lo:hi], n[lo:hi], sizes[lo:hi], flat[part], counts[part]))
                size += int(ends[hi] - ends[lo])
                if size >= shard_postings:
                    shard(held)
                    held, size = [], 0
        if held:
            shard(held)
        rows = [(item, None if d == NO_ID else d, -s) for item, own in best.items() for s, d in own]
        yield pa.RecordBatch.from_pydict({
            "item_id": pa.array([r[0] for r in rows], pa.int64()), "doc_id": pa.array([r[1] for r in rows], pa.int64()),
            "score": pa.array([r[2] for r in rows], pa.int64())})

    return searched


def _blocks(items: DataFrame, most: int):
    """The items (id -> terms) with their distinct terms, a bounded number of those at a time."""
    texts = items.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.collect_list(whole_text()).alias("texts"))
    held, terms = {}, set()
    for row in texts.toLocalIterator():
        own = [t for text in row.texts for t in terms_of(text.encode())]
        if held and len(terms | set(own)) > most:
            yield held, terms
            held, terms = {}, set()
        held[row.item_id] = own
        terms |= set(own)
    if held:
        yield held, terms


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, most_terms: int = TERMS,
           shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0.

    Every row of ``docs`` (doc_id, text) is a document, rows that repeat an id too; a null id ranks
    after the others of its score, null texts have no terms. Rows of ``items`` (item_id, text) that
    repeat an id, a null one too, are one item of all their terms. The items are the queries: driver
    and tasks hold those of at most ``most_terms`` distinct terms (or one item) at a time; more items
    take further passes over the documents. Without documents,
    items or common terms there are no rows.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), whole_text().alias("text"))
    kinds = "item_id bigint, doc_id bigint, score bigint"
    out = spark.createDataFrame([], kinds)
    for block, terms in _blocks(items, most_terms):
        out = out.union(_best(texts, block, sorted(terms), top, shard_postings, kinds))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "item_id", "rank", "doc_id", "score")


def _best(texts: DataFrame, block: dict, terms: list[bytes], top: int, shard_postings: int, kinds: str) -> DataFrame:
    """The best documents of each task for each item of a block."""
    spark = texts.sparkSession
    number = {t: k for k, t in enumerate(terms)}
    numbers = spark.sparkContext.broadcast(number)
    rows = checkpointed(texts.mapInArrow(_postings(numbers), "doc_id bigint, n bigint, terms array<int>, tfs array<int>"))
    numbers.unpersist()
    sizes = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms"),
                     F.sum(F.size("terms")).alias("postings")).first()
    total, length = sizes["docs"], sizes["terms"] or 0
    if not length:
        return spark.createDataFrame([], kinds)
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # bounded: the block's terms
    weights = np.zeros(len(terms), np.int64)
    for term, n in zip(df["term"].to_pylist(), df["count"].to_pylist(), strict=True):
        weights[term] = floor(1000 * log((2 * total + 2) / (2 * n + 1)))
    wanted = {}
    for item, own in block.items():
        if own:
            kinds_, times = np.unique(np.array([number[t] for t in own], np.int64), return_counts=True)
            wanted[item] = (kinds_, times.astype(np.int64))
    parts = max(sizes["postings"] // shard_postings + 1, spark.sparkContext.defaultParallelism)
    return rows.where(F.size("terms") > 0).repartition(parts).mapInArrow(
        _searched(spark.sparkContext.broadcast(weights), spark.sparkContext.broadcast(wanted), total, length, top,
                  shard_postings), kinds)


@query("op13_range_maxima", r"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM t),
lens AS (SELECT k, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM lens),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
asked AS (SELECT item_id, w, count(*) AS times FROM q GROUP BY ALL),
words AS (SELECT k, unnest(w) AS w FROM d),
tf AS (SELECT k, w, count(*) AS tf FROM words WHERE w IN (SELECT w FROM asked) GROUP BY ALL),
df AS (SELECT w, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, s GROUP BY w, nn),
impact AS (SELECT tf.k, w, weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * nn) // ll)))) AS x
  FROM tf JOIN df USING (w) JOIN lens ON lens.k = tf.k, s),
scores AS (SELECT item_id, k, sum(times * x)::BIGINT AS score FROM asked JOIN impact USING (w) GROUP BY ALL),
best AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scores JOIN lens USING (k) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM best WHERE rank <= 20""")
def op13_range_maxima(spark, sf):
    return ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
