"""What each of several filters removes, alone and in every order, with a counting-Bloom prepass.

Whether a text stands elsewhere too is the one condition that needs other rows. Each task counts
the hashes of its texts in a sketch (only the counters it touched), the sketches are added up
block by block, and a text with a counter that only itself has touched is surely unique. Such
texts never leave their task; only the others are shuffled, whole, and get the exact smallest id
of their text. Then each document is one bit mask of the conditions it fails. Counts of masks add
up, and each order of the filters is answered from the counts of at most 2^filters masks.
"""

from collections.abc import Callable
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import checkpointed, prepare, query, table, whole_text

COUNTERS = 16           # of the sketch, for each text
TOUCHED = 4             # counters of a text, all in one block
BLOCK = 1 << 13         # counters of a block
MOST_BLOCKS = 1 << 16   # the sketch as it is sent to all tasks: one bit a counter, 64 MB at most
HELD = 1 << 20          # touched counters that a task holds before it hands them on

WORD = r"[^\x20\x09-\x0D]+"


def short(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))) < 50


def repetitive(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return 100 * F.size(F.array_distinct(words)) < 65 * F.size(words)


def shouting(text: Column) -> Column:
    return 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text)


def symbols(text: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


RULES: dict[str, Callable[[Column], Column]] = {"A": short, "B": repetitive, "C": shouting, "D": symbols}


def _partial_sketches(batches):
    """(block, slots, counts): how often this task's texts touched each counter."""
    held: list[np.ndarray] = []

    def rows():
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        blocks, starts = np.unique(keys // BLOCK, return_index=True)
        slots = np.split((keys % BLOCK).astype("<u2"), starts[1:])
        own = np.split(np.minimum(counts, 255).astype(np.uint8), starts[1:])  # more is not asked for
        return pa.RecordBatch.from_pydict({
            "block": pa.array(blocks, pa.int64()), "slots": pa.array([s.tobytes() for s in slots], pa.binary()),
            "counts": pa.array([c.tobytes() for c in own], pa.binary())})

    for batch in batches:
        block, seed = (np.asarray(batch[c]) for c in ("block", "seed"))
        held += [block * BLOCK + ((seed >> (13 * k)) & (BLOCK - 1)) for k in range(TOUCHED)]
        if sum(map(len, held)) >= HELD:
            yield rows()
            held.clear()
    if sum(map(len, held)):
        yield rows()


def _merged(rows: pa.Table) -> pa.Table:
    """The block's counters over all tasks, as bits: touched more than once."""
    total = np.zeros(BLOCK, np.int64)
    for slots, counts in zip(rows["slots"].to_pylist(), rows["counts"].to_pylist(), strict=True):
        total[np.frombuffer(slots, "<u2")] += np.frombuffer(counts, np.uint8)  # a row has each slot once
    bits = np.packbits(total > 1, bitorder="little").view("<i8")
    return pa.table({"block": rows["block"].slice(0, 1), "bits": pa.array([bits.tolist()], pa.list_(pa.int64()))})


def _hashed(docs: DataFrame, blocks: int) -> DataFrame:
    h = F.xxhash64("text")
    return docs.withColumn("block", F.pmod(h, F.lit(blocks)).cast("long")).withColumn("seed", F.xxhash64(F.lit(1), h))


def _perhaps_repeated(docs: DataFrame, counters: int) -> DataFrame:
    """Adds ``again``: false for texts that surely stand only once among ``docs``."""
    blocks = min(MOST_BLOCKS, docs.count() * counters // BLOCK + 1)
    hashed = _hashed(docs, blocks)
    sketch = checkpointed(hashed.select("block", "seed").mapInArrow(
        _partial_sketches, "block bigint, slots binary, counts binary")
        .groupBy("block").applyInArrow(_merged, "block bigint, bits array<bigint>"))
    touched = " and ".join(
        f"(shiftright(bits[cast((shiftright(seed, {13 * k + 6}) & {BLOCK // 64 - 1}) as int)],"
        f" cast(shiftright(seed, {13 * k}) & 63 as int)) & 1) = 1" for k in range(TOUCHED))
    return hashed.join(F.broadcast(sketch), "block").withColumn("again", F.expr(touched)).drop("block", "seed", "bits")


def failures(docs: DataFrame, rules: dict[str, Callable[[Column], Column]] = RULES, counters: int = COUNTERS) -> DataFrame:
    """(doc_id, part, mask), a row per row of ``docs`` (doc_id, text, source).

    Bit k of the mask is set if the k-th rule's condition holds; the bit after the last rule if a
    smaller doc_id has an identical text. Null texts count as empty ones and null sources as the
    empty string. A null id has no smaller one and is smaller than none; rows that repeat an id
    and a text are no repeats of each other.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    mask = sum((F.when(rule(F.col("text")), 1 << k).otherwise(0) for k, rule in enumerate(rules.values())), F.lit(0))
    rows = checkpointed(_perhaps_repeated(docs, counters).select(
        "doc_id", "part", mask.cast("int").alias("mask"), F.when(F.col("again"), F.col("text")).alias("text")))
    perhaps = rows.where("text is not null")
    # written, so that both sides of the join are shuffled for it alone and Spark splits a hot text
    first = checkpointed(perhaps.groupBy("text").agg(F.min("doc_id").alias("first")))
    later = F.when(F.col("doc_id") > F.col("first"), 1 << len(rules)).otherwise(0)
    return rows.where("text is null").drop("text").unionByName(
        perhaps.join(first, "text").select("doc_id", "part", F.col("mask").bitwiseOR(later).alias("mask")))


def filter_audit(docs: DataFrame, labels: DataFrame, rules: dict[str, Callable[[Column], Column]] = RULES,
                 repeats: str = "E", counters: int = COUNTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    A row per part, order of the filters (one letter each: the rules, then ``repeats``) and step.
    Labels without a document count nowhere; a document that is labelled twice is good (toxic) if
    any of its labels says so; null labels say nothing. Without documents there are no rows.
    """
    spec = list(rules) + [repeats]
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic")))
    masks = (failures(docs, rules, counters).join(said, "doc_id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")))
    # at most 2^filters masks for a part
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    orders = ["".join(p) for p in permutations(spec)]
    at = F.explode(F.sequence(F.lit(0), F.lit(len(orders) * len(spec) - 1)))
    steps = parts.withColumn("at", at).withColumn(
        "filter_order", F.element_at(F.array(*map(F.lit, orders)), (F.col("at") / len(spec)).cast("int") + 1)).withColumn(
        "step", F.col("at") % len(spec) + 1)
    place = {letter: F.instr("filter_order", letter) for letter in spec}
    bit = sum((F.when(place[x] == F.col("step"), 1 << k).otherwise(0) for k, x in enumerate(spec)), F.lit(0))
    before = sum((F.when(place[x] < F.col("step"), 1 << k).otherwise(0) for k, x in enumerate(spec)), F.lit(0))
    steps = steps.withColumn("bit", bit).withColumn("before", before)

    def total(where, what="n"):
        value = what if callable(what) else (lambda c: c[what])
        return F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda sum_, c: sum_ + value(c))

    own, earlier = F.col("bit"), F.col("before")
    passed = lambda c: c["mask"].bitwiseAND(earlier) == 0
    fails = lambda c: c["mask"].bitwiseAND(own) != 0
    removed = lambda c: passed(c) & fails(c)
    # of all orders, an equal share has this filter before the others that the document fails
    share = lambda c: c["n"] * (F.lit(factorial(len(spec))) / F.bit_count(c["mask"])).cast("long")
    return steps.select(
        "part", "filter_order", "step",
        total(lambda c: passed(c) & ~fails(c)).alias("kept"), total(removed).alias("removed"),
        total(lambda c: ~passed(c) & fails(c)).alias("redundant"),
        total(lambda c: c["mask"] == own).alias("unique_fails"),
        total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"),
        total(fails, share).alias("shapley"))


@query("op11_filter_audit", rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
  + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask FROM w),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic
  FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
  {" + ".join(f"{1 << k} * (instr(filter_order, '{x}') < step)::INT" for k, x in enumerate("ABCDE"))} AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
rows AS (SELECT part, filter_order, step, mask, bit, n, good, toxic, mask & before = 0 AS passed, mask & bit <> 0 AS fails
  FROM cells, steps),
share AS (SELECT part, filter_order[step] AS letter, sum(n) FILTER (passed AND fails) AS shapley FROM rows GROUP BY ALL)
SELECT part, filter_order, step::INT AS step,
  coalesce(sum(n) FILTER (passed AND NOT fails), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (passed AND fails), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (NOT passed AND fails), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (passed AND fails), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (passed AND fails), 0)::BIGINT AS toxic_lost,
  coalesce(any_value(s.shapley), 0)::BIGINT AS shapley
FROM rows r JOIN share s USING (part) WHERE s.letter = r.filter_order[r.step]
GROUP BY part, filter_order, step""")
def op11_filter_audit(spark, sf):
    return filter_audit(table(spark, sf, "documents"), table(spark, sf, "labels"))
