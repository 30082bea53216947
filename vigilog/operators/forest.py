"""Isolation forest: samples, trees and scores as Spark jobs."""

import math
from dataclasses import dataclass
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilog.functions.features import features, top_features
from vigilog.session import checkpointed
from vigilog.values import ANOMALY_THRESHOLD, FEATURE_NAMES

SAMPLE = 256
MAX_TREES = 500  # bound of what is broadcast to the tasks: 500 trees of 511 nodes
TREE_SCHEMA = (
    "tree int, node int, feature int, threshold double, low int, high int, path double"
)


@dataclass
class Baseline:
    """Trees (a table of nodes) and the numbers that calibrate their scores."""

    trees: DataFrame
    mean: list[float]
    sample: int
    score_min: float
    score_max: float
    n_rows: int


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one tree; a leaf's path is its depth plus the mean path of its points."""
    nodes, work = [], [(0, points, 0)]
    nodes.append(None)
    while work:
        at, rows, depth = work.pop()
        spread = rows.max(axis=0) > rows.min(axis=0)
        if depth >= limit or len(rows) <= 1 or not spread.any():
            nodes[at] = (at, -1, 0.0, -1, -1, depth + average_path(len(rows)))
            continue
        feature = int(rng.choice(np.flatnonzero(spread)))
        column = rows[:, feature]
        threshold = float(rng.uniform(column.min(), column.max()))
        is_low = column <= threshold
        low, high = len(nodes), len(nodes) + 1
        nodes += [None, None]
        nodes[at] = (at, feature, threshold, low, high, 0.0)
        work += [(low, rows[is_low], depth + 1), (high, rows[~is_low], depth + 1)]
    return nodes


def _tree_builder(names: list[str], seed: int, limit: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["_tree"].iloc[0])
        points = pdf.sort_values("_rank")[names].to_numpy(dtype="float64")
        nodes = _grow(points, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "low", "high", "path"])
        out.insert(0, "tree", tree)
        return out.astype({"tree": "int32", "node": "int32", "feature": "int32", "low": "int32",
                           "high": "int32"})

    return build


def tree_samples(keys: DataFrame, key: str, n_rows: int, n_trees: int, seed: int,
                 sample: int = SAMPLE) -> DataFrame:
    """(_tree, _rank, key): for each tree the rows with the smallest hash of (row key, tree, seed).

    Independent of partitioning. Only rows under a hash bound that leaves about four times the
    sample are exploded and ranked.
    """
    span = float(2**63)
    share = min(1.0, 4.0 * sample / max(n_rows, 1))
    bound = int(-span + share * 2 * span) if share < 1 else 2**63 - 1
    # a row per tree instead of a lambda over the trees: lambdas are interpreted, this is compiled
    draws = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("_tree"))
    rows = draws.select("_tree", F.xxhash64(F.col(key), F.col("_tree"), F.lit(seed)).alias("_h"), key).where(
        F.col("_h") <= bound)
    rank = F.row_number().over(Window.partitionBy("_tree").orderBy("_h", key))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= sample).drop("_h")


SCORE_BINS = 1 << 16  # of the raw scores, which lie between -1 and 0


def score_histogram(vectors: DataFrame) -> DataFrame:
    """(bin, n, low, high, sums): counts and bounds of the raw scores, and sums of the features.

    Bins add up over tasks; there are at most SCORE_BINS of them.
    """
    at = F.floor((F.col("raw_score") + 1) * SCORE_BINS)
    return vectors.groupBy(at.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("raw_score").alias("low"), F.max("raw_score").alias("high"),
        F.array(*[F.sum(c) for c in FEATURE_NAMES]).alias("sums"))


def histogram_quantiles(bins: list, probabilities: list[float]) -> list[float]:
    """Linear-interpolated quantiles from (low, high, n) in order: exact where a bin holds one value,
    else to a bin's width."""
    ends = np.cumsum([b[2] for b in bins])

    def value(rank: int) -> float:
        k = int(np.searchsorted(ends, rank, side="right"))
        low, high, n = bins[k]
        inside = rank - (ends[k] - n)
        return low + (high - low) * (inside / (n - 1) if n > 1 else 0.0)

    result = []
    for p in probabilities:
        x = p * (ends[-1] - 1)
        lo, hi = math.floor(x), math.ceil(x)
        result.append(float(value(lo) + (value(hi) - value(lo)) * (x - lo)))
    return result


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float]) -> list[float]:
    """Linear-interpolated quantiles; only the value bins a rank falls into are ordered."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if low == high:
        return [float(low)] * len(probabilities)
    bins = 10_000
    at = F.least(F.floor((F.col(column) - low) / F.lit((high - low) / bins)), F.lit(bins - 1))
    binned = df.select(at.alias("_bin"), F.col(column).alias("_v"))
    counts = sorted(binned.groupBy("_bin").count().collect())  # at most ``bins`` rows
    ends = np.cumsum([r["count"] for r in counts])
    ranks = sorted({r for p in probabilities for r in (
        math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
    wanted = sorted({counts[int(np.searchsorted(ends, r, side="right"))]["_bin"] for r in ranks})
    begin = {c["_bin"]: int(e - c["count"]) for c, e in zip(counts, ends)}
    upto = Window.partitionBy("_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = (
        binned.where(F.col("_bin").isin(wanted)).groupBy("_bin", "_v").count()
        .withColumn("_end", F.sum("count").over(upto))
    )
    values = {}
    for r in ranks:
        b = counts[int(np.searchsorted(ends, r, side="right"))]["_bin"]
        at_rank = (F.col("_bin") == b) & (F.col("_end") > r - begin[b]) & (
            F.col("_end") - F.col("count") <= r - begin[b])
        values[r] = inside.where(at_rank).first()["_v"]
    result = []
    for p in probabilities:
        x = p * (n - 1)
        lo, hi = math.floor(x), math.ceil(x)
        result.append(float(values[lo] + (values[hi] - values[lo]) * (x - lo)))
    return result


def mean_vector(vectors: DataFrame) -> DataFrame:
    """One row: the mean of each feature."""
    return vectors.agg(*[F.avg(n).alias(n) for n in FEATURE_NAMES])


def _raw_scorer(nodes: pd.DataFrame, sample: int):
    """Vectorised walk of all trees over a batch of rows."""
    forest = []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
        forest.append(tuple(t[c].to_numpy() for c in (
            "feature", "threshold", "low", "high", "path")))
    depth = math.ceil(math.log2(max(sample, 2)))
    scale = average_path(sample) or 1.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in batches:
            x = pdf.to_numpy(dtype="float64")
            every = np.arange(len(x))
            total = np.zeros(len(x))
            for feature, threshold, low, high, path in forest:
                at = np.zeros(len(x), dtype="int64")
                for _ in range(depth):
                    f = feature[at]
                    goes_low = x[every, f] <= threshold[at]
                    at = np.where(f < 0, at, np.where(goes_low, low[at], high[at]))
                total += path[at]
            yield pd.Series(-np.exp2(-(total / max(len(forest), 1)) / scale))

    return F.pandas_udf(score, "double")


def raw_score(vectors: DataFrame, trees: DataFrame, sample: int) -> DataFrame:
    """Adds ``raw_score``: minus 2^(-mean path / expected path); lower is more anomalous."""
    nodes = trees.toPandas()  # bounded: trees x (2 x sample - 1) nodes
    if nodes["tree"].nunique() > MAX_TREES:
        raise ValueError(f"more than {MAX_TREES} trees")
    walk = _raw_scorer(nodes, sample)
    return vectors.withColumn("raw_score", walk(F.struct(*FEATURE_NAMES)))


def train_baseline(events: DataFrame, key: str = "event_id", n_trees: int = 100, seed: int = 42,
                   sample: int = SAMPLE) -> Baseline:
    """Forest on the events' features, their mean vector, and the 1st and 99th percentile of
    the training scores."""
    if n_trees > MAX_TREES:
        raise ValueError(f"at most {MAX_TREES} trees")
    n = events.count()
    if not n:
        raise ValueError("no training events")
    size = min(sample, n)
    limit = math.ceil(math.log2(max(size, 2)))
    # ids are drawn first; features are made for the drawn rows only, at most trees x sample of them
    drawn = checkpointed(tree_samples(events.select(key), key, n, n_trees, seed, size))
    asked = events.join(F.broadcast(drawn.select(key).distinct()), key, "left_semi")
    points = drawn.join(features(asked, keep=[key]).dropDuplicates([key]), key)
    trees = checkpointed(points.groupBy("_tree").applyInPandas(
        _tree_builder(FEATURE_NAMES, seed, limit), TREE_SCHEMA))
    bins = score_histogram(raw_score(features(events, keep=[key]), trees, size)).orderBy("bin").collect()
    low, high = histogram_quantiles([(b["low"], b["high"], b["n"]) for b in bins], [0.01, 0.99])
    total = np.sum([b["sums"] for b in bins], axis=0)
    return Baseline(trees, [float(x) / n for x in total], size, low, high, n)


def anomaly_score(raw, score_min: float, score_max: float):
    """Raw score to [0, 1] on the training range, 1 the most anomalous."""
    if score_max == score_min:
        return F.lit(0.5)
    return F.greatest(F.least((F.lit(score_max) - raw) / F.lit(score_max - score_min),
                              F.lit(1.0)), F.lit(0.0))


def score(events: DataFrame, model: Baseline, threshold: float = ANOMALY_THRESHOLD,
          n_top: int = 5) -> DataFrame:
    """Events with ``anomaly_score``, ``is_anomalous``, ``top_features`` and their tags."""
    vectors = raw_score(features(events), model.trees, model.sample)
    value = anomaly_score(F.col("raw_score"), model.score_min, model.score_max)
    rows = vectors.withColumn("anomaly_score", value).withColumn(
        "is_anomalous", F.col("anomaly_score") >= threshold)
    marks = F.array(F.lit("ml:anomalous"),
                    F.concat(F.lit("ml:score:"), F.format_string("%.2f", "anomaly_score")))
    return rows.select(
        *[c for c in events.columns if c not in ("tags", "anomaly_score")], "anomaly_score",
        "is_anomalous",
        F.when(F.col("is_anomalous"), F.array_union("tags", marks)).otherwise(F.col("tags"))
        .alias("tags"),
        top_features(model.mean, n_top).alias("top_features"))


def score_stats(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("events_scored"), F.count_if("is_anomalous")
        .alias("anomalies_detected"), F.avg("anomaly_score").alias("avg_score"),
        F.max("anomaly_score").alias("max_score"))


def save_model(model: Baseline, path: str) -> None:
    spark = model.trees.sparkSession
    model.trees.write.mode("overwrite").parquet(f"{path}/trees")
    row = (model.mean, model.sample, model.score_min, model.score_max, model.n_rows)
    spark.createDataFrame(
        [row], "mean array<double>, sample int, score_min double, score_max double, n_rows bigint"
    ).write.mode("overwrite").parquet(f"{path}/baseline")


def load_model(spark: SparkSession, path: str) -> Baseline:
    row = spark.read.parquet(f"{path}/baseline").first()
    return Baseline(spark.read.parquet(f"{path}/trees"), list(row["mean"]), row["sample"],
                    row["score_min"], row["score_max"], row["n_rows"])


def without_false_positives(events: DataFrame, alert_hits: DataFrame, fingerprints: DataFrame
                            ) -> DataFrame:
    """Events none of whose alerts (event_id, fingerprint) is marked a false positive."""
    wrong = alert_hits.join(fingerprints.select("fingerprint").distinct(), "fingerprint",
                            "left_semi").select("event_id").distinct()
    return events.join(wrong, "event_id", "left_anti")


def retrain_with_feedback(model: Baseline, events: DataFrame, alert_hits: DataFrame,
                          fingerprints: DataFrame, requested: int, **options
                          ) -> tuple[Baseline, bool]:
    """New model without the false positives, taken only if at least 90 % of the requested
    rows are left to train on."""
    left = checkpointed(without_false_positives(events, alert_hits, fingerprints))
    if left.count() < 0.9 * requested:
        return model, False
    return train_baseline(left, **options), True
