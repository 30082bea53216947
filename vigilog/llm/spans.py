"""Deduplication of runs of sentences that stand elsewhere too.

Every run of ``RUN`` consecutive sentences is hashed (128 bits). Runs met more than once are
joined with their places; every sentence that a non-first run covers is removed. The first place
of a run is the one of smallest doc_id, then of smallest position.

Runs of few words are skipped, or (``lengthen``) go on over further sentences, once to the right
and once to the left, until they hold enough: so no sentence stays of a repeated stretch that has
``RUN`` sentences and ``LEAST_WORDS`` words, however short the sentences are.
"""

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.llm.common import checkpointed, query, table, utf8, whole_text, without
from vigilog.llm.repeats import later, repeated

RUN = 2           # sentences of a run
LEAST_WORDS = 10  # of a run: shorter ones may stand in two documents by chance

# parts that make up the whole text: a sentence with what ends it, or such ends alone
SENTENCE = r"[^.!?\n]+[.!?\n\t ]*|[.!?\n\t ]+"
_SENTENCE = re.compile(SENTENCE.encode())
_SPACE = b" \t\n\x0b\x0c\r"


def runs(sentences: list[bytes], size: int, least_words: int, lengthen: bool = False):
    """(position, end, 128-bit hash as bytes) of each run that counts."""
    bare = [s.strip(_SPACE) for s in sentences]
    words = [len(s.split()) for s in bare]
    if lengthen:
        places = _lengthened(words, size, least_words)
    else:
        places = [(i, i + size) for i in range(len(bare) - size + 1) if sum(words[i:i + size]) >= least_words]
    for a, b in places:
        yield a, b, xxhash.xxh3_128_digest(b"\0".join(bare[a:b]))


def _lengthened(words: list[int], size: int, least_words: int) -> list[tuple[int, int]]:
    """(start, end) of the shortest runs that count from each sentence on, and up to each one."""
    sums = [0, *accumulate(words)]
    out = set()
    for i in range(len(words)):
        end = max(i + size, bisect_left(sums, sums[i] + least_words))
        if end <= len(words):
            out.add((i, end))
        start = min(i + 1 - size, bisect_right(sums, sums[i + 1] - least_words) - 1)
        if start >= 0:
            out.add((start, i + 1))
    return sorted(out)


def _places(size: int, least_words: int, lengthen: bool):
    def places(batches):
        for batch in batches:
            ids, at, high, low = [], [], [], []
            for d, text in zip(batch["doc_id"].to_pylist(), utf8(batch["text"]), strict=True):
                for i, _, h in runs(_SENTENCE.findall(text), size, least_words, lengthen):
                    ids.append(d)
                    at.append(i)
                    high.append(int.from_bytes(h[:8], "big", signed=True))
                    low.append(int.from_bytes(h[8:], "big", signed=True))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "place": pa.array(at, pa.int32()),
                "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64())})

    return places


def _cutter(size: int, least_words: int, lengthen: bool):
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("sentences", T.IntegerType()),
                         T.StructField("removed", T.IntegerType())])

    @F.arrow_udf(kind)
    def cut(texts: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(utf8(texts), places.to_pylist(), strict=True):
            sentences = _SENTENCE.findall(text)
            gone = set()
            if own:
                here = {(a, int.from_bytes(h[8:], "big", signed=True)): b
                        for a, b, h in runs(sentences, size, least_words, lengthen)}
                for p in later(own, "low"):
                    gone.update(range(p["place"], here.get((p["place"], p["low"]), 0)))
            kept = b"".join(s for i, s in enumerate(sentences) if i not in gone) if gone else text
            out.append({"text": kept, "sentences": len(sentences), "removed": len(gone)})
        return pa.array(out, pa.struct([("text", pa.string()), ("sentences", pa.int32()), ("removed", pa.int32())]))

    return cut


def dedup_spans(docs: DataFrame, size: int = RUN, least_words: int = LEAST_WORDS, lengthen: bool = False) -> DataFrame:
    """``docs`` without sentences of repeated runs; adds ``n_sentences`` and ``n_removed``.

    Runs of fewer words are skipped, or lengthened. Sentences are compared without the white space around them. Null texts become empty ones. Rows
    with a null id take no part and stay as they are. Rows that repeat an id stand for one
    document: equal ones keep and lose the same sentences. Columns named like the added ones are
    replaced.
    """
    ids = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    places = checkpointed(ids.mapInArrow(_places(size, least_words, lengthen), "doc_id bigint, place int, high bigint, low bigint"))
    gone = repeated(places, ["high", "low"], ["low"]).select(
        F.col("doc_id").alias("_id"), F.col("places").alias("_places"))
    rest = without(docs, ["n_sentences", "n_removed", "_cut", "_id", "_places"])
    cut = rest.join(gone, rest["doc_id"] == F.col("_id"), "left").withColumn(
        "_cut", _cutter(size, least_words, lengthen)(whole_text(), F.col("_places")))
    return cut.select(*[F.col("_cut.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in rest.columns],
                      F.col("_cut.sentences").alias("n_sentences"), F.col("_cut.removed").alias("n_removed"))


_TRIM = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))


@query("op10_sentence_spans", rf"""
WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SENTENCE}') AS l FROM documents),
s AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM l),
bare AS (SELECT *, trim(s, {_TRIM}) AS b FROM s),
counted AS (SELECT *, len(regexp_extract_all(b, '[^\x20\x09-\x0D]+')) AS w FROM bare),
pairs AS (SELECT doc_id, i, b AS b1, lead(b) OVER o AS b2, w + lead(w) OVER o AS w
  FROM counted WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY b1, b2 ORDER BY doc_id, i) AS k
  FROM pairs WHERE b2 IS NOT NULL AND w >= {LEAST_WORDS}) WHERE k > 1),
gone AS (SELECT doc_id, i FROM later UNION SELECT doc_id, i + 1 FROM later)
SELECT d.doc_id, count(s.i)::INT AS n_sentences, count(g.i)::INT AS n_removed,
  sha256(coalesce(string_agg(s.s, '' ORDER BY s.i) FILTER (g.i IS NULL), '')) AS kept_sha256
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.i = g.i
GROUP BY d.doc_id""")
def op10_sentence_spans(spark, sf):
    out = dedup_spans(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op10_lengthened_spans", rf"""
WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SENTENCE}') AS l FROM documents),
s AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM l),
bare AS (SELECT *, trim(s, {_TRIM}) AS b FROM s),
counted AS (SELECT *, len(regexp_extract_all(b, '[^\x20\x09-\x0D]+')) AS w FROM bare),
summed AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto, max(i) OVER (PARTITION BY doc_id) AS last
  FROM counted),
ends AS (SELECT doc_id, upto, min(i) AS i FROM summed GROUP BY ALL),
starts AS (SELECT doc_id, upto - w AS before, max(i) AS i FROM summed GROUP BY ALL),
places AS (
  SELECT x.doc_id, x.i AS a, greatest(x.i + {RUN - 1}, e.i) AS z FROM (SELECT *, upto - w + {LEAST_WORDS} AS need FROM summed) x
    ASOF JOIN ends e ON x.doc_id = e.doc_id AND x.need <= e.upto WHERE x.i + {RUN - 1} <= x.last
  UNION
  SELECT x.doc_id, least(x.i - {RUN - 1}, e.i) AS a, x.i AS z FROM (SELECT *, upto - {LEAST_WORDS} AS need FROM summed) x
    ASOF JOIN starts e ON x.doc_id = e.doc_id AND x.need >= e.before WHERE x.i - {RUN - 1} >= 1),
bodies AS (SELECT p.doc_id, a, z, string_agg(b, chr(0) ORDER BY c.i) AS body
  FROM places p JOIN counted c ON p.doc_id = c.doc_id AND c.i BETWEEN a AND z GROUP BY ALL),
later AS (SELECT doc_id, a, z FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS k FROM bodies)
  WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM later)
SELECT d.doc_id, count(s.i)::INT AS n_sentences, count(g.i)::INT AS n_removed,
  sha256(coalesce(string_agg(s.s, '' ORDER BY s.i) FILTER (g.i IS NULL), '')) AS kept_sha256
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.i = g.i
GROUP BY d.doc_id""")
def op10_lengthened_spans(spark, sf):
    out = dedup_spans(table(spark, sf, "documents").select("doc_id", "text"), lengthen=True)
    return out.select("doc_id", "n_sentences", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
