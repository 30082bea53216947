"""Deduplication of passages of lines by content-defined chunks.

Every line that is not empty is hashed. Under each of several boundary hashes, a line's own hash
decides whether a chunk starts there, and a rolling hash over two lines whether one ends there: a
chunk goes from a starting line to the next ending one, so both ends are decided by lines inside
it, whatever was put before or after. The chunks under all boundary hashes are united: a run of two
lines that is no chunk under one hash is very likely one under another (0.984 of them are under
some). Chunks that stand more than once, compared byte by byte, are removed everywhere but at
their first place (smallest doc_id, then position).

``dedup_runs`` takes every run of two lines instead: no boundary hash decides.
"""

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.llm.common import checkpointed, query, table, whole_text, without
from vigilog.llm.repeats import later, repeated

FACTOR, MODULUS = 31, 1 << 32
BOUNDARIES = 5  # independent boundary hashes
ONE_IN = 4      # lines that do not start (pairs that do not end) a chunk
TOP = 1 << 20   # the upper twelve bits of a product decide
# multipliers of (start, end) under each boundary hash: odd, below 2^30, so products stay below 2^62
FACTORS = [tuple((0x9E3779B97F4A7C15 * (2 * n + 1) >> 24) % (1 << 30) | 1 for n in (k, k + BOUNDARIES)) for k in range(BOUNDARIES)]


def chunks(lines: list[str]) -> list[tuple[int, int]]:
    """(start, end) of the chunks under all boundary hashes: from a starting line to the next ending one."""
    filled = [i for i, line in enumerate(lines) if line]
    hashes = [int.from_bytes(hashlib.md5(lines[i].encode()).digest()[:4], "big") for i in filled]
    out, ending = set(), [-1] * BOUNDARIES
    for at in range(len(filled) - 1, -1, -1):
        own = hashes[at]
        rolled = (own + FACTOR * hashes[at - 1]) % MODULUS if at else None  # two lines: the one before has rolled out
        for k, (start, end) in enumerate(FACTORS):
            if ending[k] >= 0 and own * start % MODULUS // TOP % ONE_IN:
                out.add((filled[at], ending[k] + 1))
            if at and rolled * end % MODULUS // TOP % ONE_IN:
                ending[k] = filled[at]
    return sorted(out)


def passages(text: str):
    """(start, end, body) of the chunks."""
    lines = text.split("\n")
    for a, b in chunks(lines):
        yield a, b, "\n".join(lines[a:b])


def runs(lines: list[str]) -> list[tuple[int, int]]:
    """(start, end) of the runs of two lines that are not empty, with the empty lines between them."""
    filled = [i for i, line in enumerate(lines) if line]
    return [(a, b + 1) for a, b in zip(filled, filled[1:])]


def pairs(text: str):
    """(start, end, body) of the runs."""
    lines = text.split("\n")
    for a, b in runs(lines):
        yield a, b, "\n".join(lines[a:b])


def _digest(body: str) -> int:
    return xxhash.xxh3_64_intdigest(body.encode()) - (1 << 63)


def _places(parts):
    def places(batches):
        for batch in batches:
            rows = [(d, n, _digest(body)) for d, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(),
                                                            strict=True) for n, _, body in parts(text)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([r[0] for r in rows], pa.int64()), "place": pa.array([r[1] for r in rows], pa.int32()),
                "digest": pa.array([r[2] for r in rows], pa.int64())})

    return places


def _bodies(parts):
    """The texts of the chunks that may repeat."""
    def bodies(batches):
        for batch in batches:
            rows = []
            for d, text, places in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "places")), strict=True):
                wanted = {(p["place"], p["digest"]) for p in places}
                rows += [(d, n, body) for n, _, body in parts(text) if (n, _digest(body)) in wanted]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([r[0] for r in rows], pa.int64()), "place": pa.array([r[1] for r in rows], pa.int32()),
                "digest": pa.array([_digest(r[2]) for r in rows], pa.int64()),
                "body": pa.array([r[2] for r in rows], pa.string())})

    return bodies


_CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("lines", T.IntegerType()),
                     T.StructField("removed", T.IntegerType())])


def _cutter(parts):
    @F.arrow_udf(_CUT)
    def cut(texts: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), places.to_pylist(), strict=True):
            lines = text.split("\n")
            gone = {(p["place"], p["digest"]) for p in later(own, "digest")}
            if gone:
                lost = {i for a, b, body in parts(text) if (a, _digest(body)) in gone for i in range(a, b)}
                kept = [line for i, line in enumerate(lines) if i not in lost]
                out.append({"text": "\n".join(kept), "lines": len(lines), "removed": len(lost)})
            else:
                out.append({"text": text, "lines": len(lines), "removed": 0})
        return pa.array(out, pa.struct([("text", pa.string()), ("lines", pa.int32()), ("removed", pa.int32())]))

    return cut


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks removed from ``text``; adds ``n_lines`` and ``n_removed``.

    Null texts become empty ones. Rows with a null id take no part and stay as they are. Rows that
    repeat an id stand for one document: equal ones keep and lose the same lines. Columns named
    like the added ones are replaced. The first place of every line stays.
    """
    return _dedup(docs, passages)


def dedup_runs(docs: DataFrame) -> DataFrame:
    """``dedup_lines`` by runs of two lines: every line of a run that stands earlier is removed.

    The first place of every line stays.
    """
    return _dedup(docs, pairs)


def _dedup(docs: DataFrame, parts) -> DataFrame:
    ids = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    places = checkpointed(ids.mapInArrow(_places(parts), "doc_id bigint, place int, digest bigint"))
    maybe = repeated(places, ["digest"], ["digest"])
    bodies = checkpointed(ids.join(maybe, "doc_id").mapInArrow(
        _bodies(parts), "doc_id bigint, place int, digest bigint, body string"))
    gone = repeated(bodies, ["digest", "body"], ["digest"]).select(
        F.col("doc_id").alias("_id"), F.col("places").alias("_places"))
    rest = without(docs, ["n_lines", "n_removed", "_cut", "_id", "_places"])
    cut = rest.join(gone, rest["doc_id"] == F.col("_id"), "left").withColumn(
        "_cut", _cutter(parts)(whole_text(), F.col("_places")))
    return cut.select(*[F.col("_cut.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in rest.columns],
                      F.col("_cut.lines").alias("n_lines"), F.col("_cut.removed").alias("n_removed"))


_HASHES = ", ".join(f"({k}, {start}, {end})" for k, (start, end) in enumerate(FACTORS))


@query("op3_line_chunks", f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM l),
hashed AS (SELECT doc_id, i, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM lines WHERE line <> ''),
rolled AS (SELECT *, (h + {FACTOR} * lag(h) OVER (PARTITION BY doc_id ORDER BY i)) % {MODULUS} AS r FROM hashed),
marked AS (SELECT doc_id, i, k, h * s % {MODULUS} // {TOP} % {ONE_IN} <> 0 AS starts,
  coalesce(r * e % {MODULUS} // {TOP} % {ONE_IN} <> 0, false) AS ends FROM rolled, (VALUES {_HASHES}) t(k, s, e)),
spans AS (SELECT DISTINCT doc_id, i, j FROM (SELECT *, min(CASE WHEN ends THEN i END) OVER (PARTITION BY doc_id, k
  ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS j FROM marked) WHERE starts AND j IS NOT NULL),
bodies AS (SELECT doc_id, i, j, list_aggregate(l[i:j], 'string_agg', chr(10)) AS body FROM spans JOIN l USING (doc_id)),
later AS (SELECT doc_id, i, j FROM (SELECT *, row_number() OVER (
  PARTITION BY body ORDER BY doc_id, i) AS k FROM bodies) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM later)
SELECT doc_id, count(*)::INT AS n_lines, count(g.i)::INT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY lines.i) FILTER (g.i IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id""")
def op3_line_chunks(spark, sf):
    out = dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op3_line_runs", """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM l),
ends AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM lines WHERE line <> ''),
bodies AS (SELECT doc_id, i, j, list_aggregate(l[i:j], 'string_agg', chr(10)) AS body
  FROM ends JOIN l USING (doc_id) WHERE j IS NOT NULL),
later AS (SELECT doc_id, i, j FROM (SELECT *, row_number() OVER (
  PARTITION BY body ORDER BY doc_id, i) AS k FROM bodies) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM later)
SELECT doc_id, count(*)::INT AS n_lines, count(g.i)::INT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY lines.i) FILTER (g.i IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id""")
def op3_line_runs(spark, sf):
    out = dedup_runs(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
