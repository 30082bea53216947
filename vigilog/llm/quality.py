"""Quality of documents: an additive model with pairwise interactions over lookup tables.

Every document becomes a row of shape features. Each feature is cut into quantile bins; shallow
trees are boosted one feature after the other, round after round, so each feature ends up with one
table (bin -> log odds). The pairs of features that explain most of what is left get tables over
two coarse bins in the same way. A score is a sum of looked-up values.
"""

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.llm.common import checkpointed, fold, query, table, utf8, whole_text, without
from vigilog.llm.learning import labelled_ids, sigmoid

FEATURES = [
    "log_bytes", "log_words", "mean_word", "distinct_words", "letters", "capitals", "digits",
    "punctuation", "symbols", "exclamations", "spaces", "non_ascii", "log_lines", "mean_line",
    "repeated_lines", "top_word", "odd_endings", "long_words", "distinct_triples", "mean_sentence",
]
TRAIN_ROWS = 20_000  # labelled documents the model is fitted on, at most

_ASCII = np.arange(256)
_CLASSES = {
    "letter": ((_ASCII >= 65) & (_ASCII <= 90)) | ((_ASCII >= 97) & (_ASCII <= 122)),
    "capital": (_ASCII >= 65) & (_ASCII <= 90),
    "digit": (_ASCII >= 48) & (_ASCII <= 57),
    "punctuation": np.isin(_ASCII, [ord(c) for c in ".,;:?'\"-()"]),
    "symbol": np.isin(_ASCII, [ord(c) for c in "#$%&*|<>{}[]=+^~@\\/_`"]),
    "exclamation": _ASCII == ord("!"),
    "space": np.isin(_ASCII, [32, 9, 10, 11, 12, 13]),
    "wide": _ASCII >= 128,
    "stop": np.isin(_ASCII, [ord(c) for c in ".!?"]),
}
_MASKS = np.stack([m for m in _CLASSES.values()], 1).astype(np.int64)


def shape(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per text."""
    counts = np.stack([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts])
    by = dict(zip(_CLASSES, (counts @ _MASKS).T, strict=True))
    size = np.maximum(counts.sum(1), 1)
    rows = np.empty((len(texts), 9))
    for i, t in enumerate(texts):
        words, lines = t.split(), t.split(b"\n")
        n = max(len(words), 1)
        triples = max(n - 2, 1)
        rows[i] = (
            len(words), sum(map(len, words)) / n, len(set(words)) / n,
            len(lines), 1 - len(set(lines)) / len(lines),
            max(Counter(words).values(), default=0) / n,
            sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1] not in b".,;:!?" for w in words) / n,
            sum(len(w) > 14 for w in words) / n,
            len(set(zip(words, words[1:], words[2:], strict=False))) / triples)
    share = {k: v / size for k, v in by.items()}
    return np.stack([
        np.log1p(counts.sum(1)), np.log1p(rows[:, 0]), rows[:, 1], rows[:, 2], share["letter"],
        by["capital"] / np.maximum(by["letter"], 1), share["digit"], share["punctuation"],
        share["symbol"], share["exclamation"], share["space"], share["wide"], np.log1p(rows[:, 3]),
        size / rows[:, 3], rows[:, 4], rows[:, 5], rows[:, 6], rows[:, 7], rows[:, 8],
        rows[:, 0] / np.maximum(by["stop"], 1)], 1)


def with_shape(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``shape`` (array of FEATURES) in place of the text; null texts count as empty."""
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def shapes(texts: pa.Array) -> pa.Array:
        rows = shape(utf8(texts)) if len(texts) else np.empty((0, len(FEATURES)))
        offsets = np.arange(0, rows.size + 1, len(FEATURES), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))

    return without(df, ["shape"]).withColumn("shape", shapes(whole_text(text))).drop(text)


@dataclass
class AdditiveModel:
    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, values in enumerate(self.tables):
            total += values[np.searchsorted(self.cuts[f], x[:, f], "right")]
        coarse = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.pair_cuts)]
        for (a, b), values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[coarse[a], coarse[b]]
        return sigmoid(total)


def _quantiles(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="higher"))


def _steps(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """A tree of the given depth over ordered bins: the value of its leaf, per bin."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        right_g, right_h = g.sum() - left_g, h.sum() - left_h
        gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
            return np.concatenate([_steps(g[:cut], h[:cut], depth - 1, ridge),
                                   _steps(g[cut:], h[cut:], depth - 1, ridge)])
    return np.full(len(g), g.sum() / (h.sum() + ridge))


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """A two-level tree over a grid: one cut on the first axis, then one on the second per side."""
    best, values = -1.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(gg)):
            sides = [_steps(gg[s].sum(0), hh[s].sum(0), 1, ridge) for s in (slice(cut), slice(cut, None))]
            gain = sum(float(v @ gg[s].sum(0)) for v, s in zip(sides, (slice(cut), slice(cut, None)), strict=True))
            if gain > best:
                own = np.vstack([np.tile(sides[0], (cut, 1)), np.tile(sides[1], (len(gg) - cut, 1))])
                best, values = gain, own.T if flip else own
    return values, best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, pair_bins: int = 6, n_pairs: int = 8,
        rounds: int = 150, pair_rounds: int = 30, rate: float = 0.1, ridge: float = 5.0) -> AdditiveModel:
    """Cyclic boosting. With no rows, or one label only, the score is that label's smoothed share."""
    share = (y.sum() + 1) / (len(y) + 2)
    n_features = x.shape[1]
    cuts = [_quantiles(x[:, f], bins) if len(x) else np.empty(0) for f in range(n_features)]
    pair_cuts = [_quantiles(x[:, f], pair_bins) if len(x) else np.empty(0) for f in range(n_features)]
    model = AdditiveModel(float(np.log(share / (1 - share))), cuts,
                          [np.zeros(len(c) + 1) for c in cuts], pair_cuts, [], [])
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    total = np.full(len(y), model.base)
    for _ in range(rounds):
        for f, values in enumerate(model.tables):
            p = sigmoid(total)
            step = rate * _steps(np.bincount(at[f], y - p, len(values)),
                                 np.bincount(at[f], p * (1 - p), len(values)), 2, ridge)
            values += step
            total += step[at[f]]
    coarse = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(pair_cuts)]

    def grid(a, b, weights):
        shape_ = (len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1)
        return np.bincount(coarse[a] * shape_[1] + coarse[b], weights, shape_[0] * shape_[1]).reshape(shape_)

    p = sigmoid(total)
    gains = sorted(((_cross(grid(a, b, y - p), grid(a, b, p * (1 - p)), ridge)[1], a, b)
                    for a in range(n_features) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for _, a, b in gains[:n_pairs]]
    model.pair_tables = [np.zeros((len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), values in zip(model.pairs, model.pair_tables, strict=True):
            p = sigmoid(total)
            step = rate * _cross(grid(a, b, y - p), grid(a, b, p * (1 - p)), ridge)[0]
            values += step
            total += step[coarse[a], coarse[b]]
    return model


def train(shapes: DataFrame, labels: DataFrame, learn, label: str = "quality",
          rows: int = TRAIN_ROWS) -> AdditiveModel:
    """A model fitted on at most ``rows`` labelled documents for which ``learn`` holds.

    ``shapes`` has (doc_id, shape). Only the sample's numbers reach the driver.
    """
    chosen = labelled_ids(labels, label, learn, rows)
    got = (shapes.join(F.broadcast(chosen), "doc_id")
           .groupBy("doc_id").agg(F.first("shape").alias("shape"), F.first("label").alias("label"))
           .orderBy("doc_id").select("shape", "label").toArrow())
    x = np.array(got["shape"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, np.array(got["label"].to_pylist(), float))


def with_score(shapes: DataFrame, model: AdditiveModel) -> DataFrame:
    """Adds ``score`` (0 to 1)."""
    @F.arrow_udf(T.DoubleType())
    def scores(rows: pa.Array) -> pa.Array:
        x = np.asarray(rows.flatten(), float).reshape(-1, len(FEATURES))
        return pa.array(model.score(x))

    return without(shapes, ["score"]).withColumn("score", scores("shape"))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0,
                  threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per row of ``docs``.

    Labels of the held-out fold are never learned from. Null and empty texts are scored as empty
    ones. Repeated rows get equal scores; an id that is null is scored and never learned from.
    Without any label every score is 0.5.
    """
    shapes = checkpointed(with_shape(docs.select("doc_id", "text")))
    model = train(shapes, labels, fold("doc_id", folds) != held_out)
    return with_score(shapes, model).select(
        "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op1_quality_additive")
def op1_quality_additive(spark, sf):
    return score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
