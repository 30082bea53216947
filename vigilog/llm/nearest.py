"""Nearest neighbours by shifted space-filling curves.

Vectors are projected onto a few random directions, shifted, and ordered along a Hilbert curve,
several times over with other directions and shifts. Spark sorts each ordering by range, and a
query is compared with the vectors in a window of positions around its own. The windows of all
curves are merged and ranked by the exact distance.

How wide a window must be depends on the data: it is fitted on a bounded sample, as the least share
of an ordering that reaches the wanted recall there. Vectors that are equal are one point of the
index with its smallest ids, so a vector that is met a million times fills no window.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vigilog.llm.common import checkpointed, prepare, query, table

CURVES = 4
DIRECTIONS, BITS = 6, 8
BLOCK = 1_024            # points that a task compares with at a time
PART = 256 * BLOCK       # positions whose queries meet a block together
SAMPLE = 4_096           # points that the index is fitted on, at most
SAMPLE_QUERIES = 256
RECALL = 0.97            # wanted on the sample
SHARES = [2.0**-k for k in range(9, 2, -1)] + [i / 20 for i in range(4, 21)]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the curve of the rows of ``cells`` (unsigned integers below 2^bits)."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns and mirrors of the sub-cubes, from the largest down
        low = q - 1
        for i in range(len(x)):
            up = (x[i] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ (swap if i else 0)
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ turn) >> bit) & 1)
    return key


@dataclass
class Index:
    """Of one vector length: the directions of each curve, the grid over them, the window's share."""

    directions: np.ndarray  # (curves, dim, directions)
    low: np.ndarray         # (curves, directions)
    cell: np.ndarray
    share: float

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        cells = np.floor((x @ self.directions[curve] - self.low[curve]) / self.cell[curve])
        return hilbert(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def fit(x: np.ndarray, curves: int = CURVES, recall: float = RECALL) -> Index:
    """An index for vectors like the rows of ``x``."""
    rng = np.random.default_rng(29)
    dim = x.shape[1]
    directions = rng.normal(size=(curves, dim, DIRECTIONS))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    spots = np.einsum("nd,cdk->cnk", x, directions)
    low, high = spots.min(1), spots.max(1)
    width = np.maximum(high - low, 1e-12)
    shift = rng.random((curves, DIRECTIONS)) * 0.5  # the grid is twice as wide as the data
    index = Index(directions, low - shift * width, 1.5 * width / (1 << BITS), 1.0)
    asked = np.arange(0, len(x), max(1, len(x) // SAMPLE_QUERIES))
    far = np.full((len(asked), len(x)), len(x))
    for c in range(curves):
        place = np.empty(len(x), np.int64)
        place[np.argsort(index.keys(x, c), kind="stable")] = np.arange(len(x))
        far = np.minimum(far, np.abs(place[asked][:, None] - place))
    exact = ((x[asked][:, None] - x) ** 2).sum(2) if dim * len(x) < 1 << 14 else (
        (x[asked] ** 2).sum(1)[:, None] + (x**2).sum(1) - 2 * x[asked] @ x.T)
    exact[np.arange(len(asked)), asked] = np.inf
    near = np.argsort(exact, axis=1)[:, :min(10, len(x) - 1)]
    needed = np.take_along_axis(far, near, 1) / len(x)
    index.share = next((s for s in SHARES if (needed <= s / 2).mean() >= recall), 2.0) if near.size else 2.0
    return index


def _points(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(dim, body, ids): each distinct vector once, with its smallest ids."""
    kind = df.schema[vector].dataType.elementType
    dtype = np.float32 if isinstance(kind, T.FloatType) else np.float64

    def pack(batches):
        for batch in batches:
            ids, bodies, dims = [], [], []
            for i, values in zip(batch["id"].to_pylist(), batch["vector"], strict=True):
                if i is None or values.as_py() is None or values.values.null_count:
                    continue
                x = np.asarray(values.values, dtype) + dtype(0)  # no negative zeros
                if len(x) and np.isfinite(x).all() and x.any():
                    ids.append(i)
                    bodies.append(x.astype(np.float64).tobytes())
                    dims.append(len(x))
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "body": pa.array(bodies, pa.binary()),
                                              "dim": pa.array(dims, pa.int32())})

    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector")).mapInArrow(
        pack, "id bigint, body binary, dim int")
    return rows.groupBy("id").agg(F.min(F.struct("dim", "body")).alias("x")).select("id", "x.dim", "x.body")


def _smallest_ids(points: DataFrame, k: int) -> DataFrame:
    """(v, dim, body, ids): the k smallest ids of each vector; the limit holds before the shuffle."""
    order = Window.partitionBy("dim", "body").orderBy("id")
    few = points.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return few.groupBy("dim", "body").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        F.col("ids")[0].alias("v"), "dim", "body", "ids")


def _ordered(points: DataFrame, indexes: dict[int, Index]) -> DataFrame:
    """(curve, dim, pos, n, v, body): each point's position on each curve of n points."""
    def keyed(batches):
        for batch in batches:
            dims = np.asarray(batch["dim"])
            for dim, index in indexes.items():
                rows = np.flatnonzero(dims == dim)
                if not len(rows):
                    continue
                part = batch.take(pa.array(rows))
                x = np.frombuffer(b"".join(part["body"].to_pylist())).reshape(len(rows), dim)
                for c in range(len(index.directions)):
                    yield pa.RecordBatch.from_pydict({
                        "curve": pa.array(np.full(len(rows), c, np.int32)), "dim": part["dim"],
                        "key": pa.array(index.keys(x, c)), "v": part["v"], "body": part["body"]})

    def numbered(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            seq = []
            for line in zip(batch["curve"].to_pylist(), batch["dim"].to_pylist(), strict=True):
                seq.append(seen.get(line, 0))
                seen[line] = seq[-1] + 1
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part] * len(seq), pa.int32()), "seq": pa.array(seq, pa.int64()),
                **{c: batch[c] for c in ("curve", "dim", "v", "body")}})

    order = ["dim", "curve", "key", "v"]
    kinds = "curve int, dim int, key bigint, v bigint, body binary"
    rows = checkpointed(points.mapInArrow(keyed, kinds).repartitionByRange(*order).sortWithinPartitions(*order)
                        .mapInArrow(numbered, "part int, seq bigint, curve int, dim int, v bigint, body binary"))
    line = Window.partitionBy("curve", "dim")
    before = line.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part", "curve", "dim").agg(F.count(F.lit(1)).alias("m")).select(
        "part", "curve", "dim", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"),
        F.sum("m").over(line).alias("n"))  # a row per curve and partition
    return rows.join(F.broadcast(starts), ["part", "curve", "dim"]).select(
        "curve", "dim", (F.col("start") + F.col("seq")).alias("pos"), "n", "v", "body")


def _compare(k: int):
    def compare(asked: pa.Table, block: pa.Table) -> pa.Table:
        out = {"q": [], "v": [], "score": []}
        if asked.num_rows and block.num_rows:
            v = np.asarray(block["v"])
            dim = block["dim"][0].as_py()
            x = np.frombuffer(b"".join(block["body"].to_pylist())).reshape(len(v), dim)
            size = (x**2).sum(1)
            for at in range(0, asked.num_rows, 256):
                part = asked.slice(at, 256)
                q = np.frombuffer(b"".join(part["body"].to_pylist())).reshape(part.num_rows, dim)
                rough = size - 2 * q @ x.T + (q**2).sum(1)[:, None]
                kth = np.partition(rough, min(k, len(v)) - 1, axis=1)[:, min(k, len(v)) - 1]
                slack = 1e-9 * (size.max() + (q**2).sum(1))  # above what rounding can move
                for i, own in enumerate(part["q"].to_pylist()):
                    near = np.flatnonzero(rough[i] <= kth[i] + slack[i])
                    score = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
                    best = np.lexsort((v[near], score))[:k]
                    out["q"] += [own] * len(best)
                    out["v"] += v[near][best].tolist()
                    out["score"] += score[best].tolist()
        return pa.table({"q": pa.array(out["q"], pa.int64()), "v": pa.array(out["v"], pa.int64()),
                         "score": pa.array(out["score"], pa.float64())})

    return compare


def nearest(df: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding",
            recall: float = RECALL) -> DataFrame:
    """(query_id, rank, id, score): for each query row its k nearest other rows that were found.

    ``is_query`` is a condition on a column ``id``. Scores are Euclidean distances in double
    precision on the vectors as given; ties go to the smaller id; fewer than k rows are returned
    only where there are fewer candidates. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do null ids. Rows that repeat an id count once (the
    smallest vector). Vectors of different lengths are not compared.
    """
    spark = prepare(df.sparkSession)
    rows = checkpointed(_points(df, id_column, vector))
    points = checkpointed(_smallest_ids(rows, k + 1))
    order = Window.partitionBy("dim").orderBy(F.xxhash64("body"), "v")
    sample = points.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE).select("dim", "body")
    indexes = {}
    bodies: dict[int, list] = {}
    for row in sample.orderBy("dim", "body").toLocalIterator():
        bodies.setdefault(row["dim"], []).append(row["body"])
    for dim, own in bodies.items():
        indexes[dim] = fit(np.frombuffer(b"".join(own)).reshape(-1, dim), recall=recall)
    asking = rows.where(is_query).select(F.col("id").alias("query_id"), "dim", "body")
    if not indexes:
        empty = "query_id bigint, rank int, id bigint, score double"
        return spark.createDataFrame([], empty)
    placed = checkpointed(_ordered(points, indexes))
    half = F.coalesce(*[F.when(F.col("dim") == d, F.ceil(F.lit(i.share / 2) * F.col("n"))) for d, i in indexes.items()])
    last = F.floor((F.col("n") - 1) / BLOCK)
    first_block = F.greatest(F.lit(0), F.floor((F.col("pos") - F.col("half")) / BLOCK))
    last_block = F.least(last, F.floor((F.col("pos") + F.col("half")) / BLOCK))
    queried = asking.select("dim", "body").distinct()
    at = ["curve", "dim", "block", "part"]
    asked = (placed.join(queried, ["dim", "body"]).withColumn("half", half)
             .select("curve", "dim", F.col("v").alias("q"), "body", F.floor(F.col("pos") / PART).alias("part"),
                     F.explode(F.sequence(first_block, last_block)).alias("block")))
    reach = F.col("half") + BLOCK
    parts = F.sequence(F.floor(F.greatest(F.lit(0), F.col("pos") - reach) / PART),
                       F.floor(F.least(F.col("n") - 1, F.col("pos") + reach) / PART))
    blocks = placed.withColumn("half", half).select(  # names of its own: both sides come from one table
        *[F.col(c).alias(c) for c in ("curve", "dim", "v", "body")], F.floor(F.col("pos") / BLOCK).alias("block"), F.explode(parts).alias("part"))
    found = checkpointed(asked.groupBy(*at).cogroup(blocks.groupBy(*at)).applyInArrow(
        _compare(k + 1), "q bigint, v bigint, score double"))
    by_query = Window.partitionBy("q").orderBy("score", "v")
    merged = found.groupBy("q", "v").agg(F.min("score").alias("score")).withColumn(
        "n", F.row_number().over(by_query)).where(F.col("n") <= k + 1)
    ids = points.select("v", "ids")
    listed = merged.join(ids, "v").select("q", "score", F.explode("ids").alias("id"))
    nearest_ids = listed.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))).where(
        F.col("n") <= k + 1).drop("n")
    asked_by = asking.join(points.select("dim", "body", F.col("v").alias("q")), ["dim", "body"])
    # k + 1 ids of a vector serve all queries that hold it: each leaves out itself
    ranked = asked_by.join(nearest_ids, "q").where(F.col("id") != F.col("query_id")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "id", "score")


@query("op5_hilbert_windows")
def op5_hilbert_windows(spark, sf):
    found = nearest(table(spark, sf, "embeddings"), F.col("id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
