"""Toxic spans and scores by a linear-chain conditional random field.

Only whole documents are labelled, so tokens are labelled first: a word, or a beginning of words,
that many distinct sentences of toxic documents hold and those of clean documents hardly ever do
is evidence, and its tokens in toxic documents are toxic; all others are not. A chain of two
states is fitted to those labelled sentences. Over any text, forward and backward recursions give
each token's marginal and each sentence's chance to hold no toxic token at all; these make the
document's score and the offsets of its toxic spans.
"""

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.llm.common import checkpointed, fold, query, table, whole_text, without
from vigilog.llm.learning import labelled_ids, logistic, sigmoid

TRAIN_ROWS = 20_000    # labelled documents that are learned from, at most
EVIDENCE_KEPT = 4_096  # words and beginnings of words in the model, at most
CHAIN = 32             # tokens of a chain: longer sentences are several chains

_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"\w+")
_PREFIXES = (4, 5, 6)


def signs(word: str) -> list[str]:
    """What a token may be known by: itself and its beginnings."""
    word = word.lower()
    return [word] + [word[:n] + "*" for n in _PREFIXES if len(word) > n]


def chains(text: str):
    """The tokens of each sentence, at most CHAIN at a time."""
    for sentence in _SENTENCE.split(text):
        words = _WORD.findall(sentence)
        for at in range(0, len(words), CHAIN):
            yield words[at:at + CHAIN]


class Known(dict):
    """Evidence ids of the words met lately."""

    def __init__(self, evidence: dict[str, int]):
        super().__init__()
        self.evidence = evidence

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.evidence[s] for s in signs(word) if s in self.evidence)
        if len(self) >= 100_000:
            self.clear()
        self[word] = found
        return found


@dataclass
class ChainModel:
    """States: 0 clean, 1 toxic. ``weights``: of evidence for state 1; the last is for every token."""

    evidence: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray                     # (2, 2) from, to
    first: float                          # of starting toxic
    outer: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0]))

    def emissions(self, found: list[tuple[int, ...]]) -> list[float]:
        always = self.weights[-1]
        return [always + sum(self.weights[i] for i in f) for f in found]

    def marginals(self, e: list[float]) -> tuple[list[float], float]:
        """P(toxic) of each token, and log P(no token is toxic)."""
        (oo, ot), (to, tt) = self.moves.tolist()
        ahead = [(0.0, self.first + e[0])]
        for x in e[1:]:
            a, b = ahead[-1]
            ahead.append((_lse(a + oo, b + to), _lse(a + ot, b + tt) + x))
        z = _lse(*ahead[-1])
        back = [(0.0, 0.0)]
        for x in reversed(e[1:]):
            c, d = back[-1]
            back.append((_lse(oo + c, ot + x + d), _lse(to + c, tt + x + d)))
        back.reverse()
        toxic = [math.exp(min(0.0, a[1] + b[1] - z)) for a, b in zip(ahead, back, strict=True)]
        return toxic, oo * (len(e) - 1) - z

    def plain(self) -> list[tuple[float, float]]:
        """For chains of each length without evidence: expected toxic tokens, log P(none)."""
        out = [(0.0, 0.0)]
        for n in range(1, CHAIN + 1):
            toxic, none = self.marginals([float(self.weights[-1])] * n)
            out.append((sum(toxic), none))
        return out

    def read(self, text: str, known: Known, plain: list, spans: bool = True):
        """log P(no toxic token), expected toxic tokens, spans (start, end, probability)."""
        none, expected, hot = 0.0, 0.0, False
        for words in chains(text):
            found = [known[w] for w in words]
            if any(found):
                toxic, own = self.marginals(self.emissions(found))
                expected, none, hot = expected + sum(toxic), none + own, True
            else:
                expected, none = expected + plain[len(words)][0], none + plain[len(words)][1]
        return none, expected, self.spans(text, known) if hot and spans else []

    def spans(self, text: str, known: Known) -> list[dict]:
        out: list[dict] = []
        ends = [m.start() for m in _SENTENCE.finditer(text)] + [len(text)]
        at = 0
        for end in ends:
            tokens = [(m.start(), m.end()) for m in _WORD.finditer(text, at, end)]
            for k in range(0, len(tokens), CHAIN):
                part = tokens[k:k + CHAIN]
                found = [known[text[a:b]] for a, b in part]
                if not any(found):
                    continue
                run = False
                for (a, b), p in zip(part, self.marginals(self.emissions(found))[0], strict=True):
                    if p >= 0.5 and run:
                        out[-1] |= {"end": b, "probability": max(out[-1]["probability"], p)}
                    elif p >= 0.5:
                        out.append({"start": a, "end": b, "probability": p})
                    run = p >= 0.5
            at = end
        return out

    def outer_score(self, none, expected):
        """A document's score from log P(no toxic token) and the expected number of them."""
        return sigmoid(_outer_inputs(none, expected) @ self.outer[:-1] + self.outer[-1])


def _outer_inputs(none, expected) -> np.ndarray:
    none = np.minimum(np.asarray(none, float), -1e-12)
    some = np.log(-np.expm1(none))
    return np.stack([np.clip(some - none, -12, 12), np.log1p(np.asarray(expected, float))], -1)


def _lse(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def fit_chain(evidence: dict[str, int], tokens: np.ndarray, gold: np.ndarray, inside: np.ndarray,
              weight: np.ndarray, steps: int = 100, rate: float = 0.25, ridge: float = 0.2) -> ChainModel:
    """Penalised likelihood by gradient steps.

    ``tokens`` (chains, CHAIN, k): evidence ids, -1 for none; ``gold``: toxic tokens; ``inside``: real
    tokens; ``weight``: how many sentences a row stands for.
    """
    n = len(evidence)
    length = inside.sum(1)
    order = np.argsort(-length, kind="stable")
    tokens, gold, weight, length = tokens[order], gold[order], weight[order], length[order]
    alive = [int((length > t).sum()) for t in range(length.max(initial=1))]  # rows that reach t
    rows = np.arange(len(length))
    ids = np.where(tokens < 0, n + 6, tokens)[:, :len(alive)]
    real = inside[order][:, :len(alive)]
    gold = gold[:, :len(alive)]
    seen = np.array([[((gold[:, :-1] == i) & (gold[:, 1:] == j) & real[:, 1:]).sum(1) @ weight
                      for j in (0, 1)] for i in (0, 1)])
    values, speed, size = np.zeros(n + 7), np.zeros(n + 7), np.zeros(n + 7)
    values[n] = -3.0
    total = max(weight.sum(), 1.0)
    for step in range(1, steps + 1):
        moves = values[n + 1:n + 5].reshape(2, 2)
        e = values[ids].sum(2) + values[n]
        ahead, back = np.zeros((*e.shape, 2)), np.zeros((*e.shape, 2))
        ahead[:, 0, 1] = values[n + 5] + e[:, 0]
        for t, k in enumerate(alive[1:], 1):
            a, b = ahead[:k, t - 1, :1], ahead[:k, t - 1, 1:]
            ahead[:k, t] = np.logaddexp(a + moves[0], b + moves[1])
            ahead[:k, t, 1] += e[:k, t]
        z = np.logaddexp.reduce(ahead[rows, length - 1], axis=1)
        pairs = np.zeros((2, 2))
        for t in range(len(alive) - 1, 0, -1):
            k = alive[t]
            after = back[:k, t].copy()
            after[:, 1] += e[:k, t]
            joint = ahead[:k, t - 1, :, None] + moves + after[:, None, :]
            pairs += np.tensordot(weight[:k], np.exp(joint - z[:k, None, None]), 1)
            back[:k, t - 1] = np.logaddexp(moves[:, 0] + after[:, :1], moves[:, 1] + after[:, 1:])
        toxic = np.where(real, np.exp(ahead[:, :, 1] + back[:, :, 1] - z[:, None]), 0)
        off = (gold - toxic) * weight[:, None]
        grad = np.bincount(ids.ravel(), np.repeat(off.ravel(), ids.shape[2]), n + 7)
        grad[n:] = [off.sum(), *(seen - pairs).ravel(), off[:, 0].sum(), 0.0]
        grad = (grad - ridge * values) / total
        grad[n + 1] = 0.0  # clean to clean is the measure of the other moves
        speed = 0.9 * speed + 0.1 * grad
        size = 0.99 * size + 0.01 * grad**2
        values += rate * speed / (1 - 0.9**step) / (np.sqrt(size / (1 - 0.99**step)) + 1e-12)
        values[n + 6] = 0.0
    w, moves, first = values[:n + 1].copy(), values[n + 1:n + 5].reshape(2, 2).copy(), values[n + 5:]
    return ChainModel(evidence, w, moves, float(first[0]))


def _sentences(sample: DataFrame) -> DataFrame:
    """(sentence, toxic) of the sample: each distinct chain of words once, clean if any clean
    document holds it. Copies of a document would otherwise count as so much evidence."""
    def cut(batches):
        for batch in batches:
            seen = Counter()
            for text, toxic in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
                for words in chains(text):
                    seen[" ".join(words), toxic] += 1
            yield pa.RecordBatch.from_pydict(
                {"sentence": pa.array([k[0] for k in seen], pa.string()),
                 "toxic": pa.array([k[1] for k in seen], pa.int32())})

    return (sample.mapInArrow(cut, "sentence string, toxic int")
            .groupBy("sentence").agg(F.min("toxic").alias("toxic")))


def _evidence(sentences: DataFrame, least: int = 8, lift: float = 20.0) -> dict[str, int]:
    """Words and beginnings that tell toxic sentences from clean ones, the strongest first."""
    def count(batches):
        for batch in batches:
            seen = Counter()
            for words, toxic in zip(batch["sentence"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                for sign in {s for w in words.split(" ") for s in signs(w)}:
                    seen[sign, toxic] += 1
            yield pa.RecordBatch.from_pydict(
                {"sign": pa.array([k[0] for k in seen], pa.string()),
                 "toxic": pa.array([k[1] for k in seen], pa.int32()),
                 "n": pa.array(list(seen.values()), pa.int64())})

    counts = sentences.mapInArrow(count, "sign string, toxic int, n bigint").groupBy("sign").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    sizes = {r["toxic"]: r["count"] for r in sentences.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0) + 1, sizes.get(0, 0) + 1
    strength = (F.col("bad") + 0.5) / F.lit(bad) / ((F.col("good") + 0.5) / F.lit(good))
    rows = (counts.where((F.col("bad") >= least) & (strength >= lift))
            .orderBy(F.desc("bad"), "sign").limit(EVIDENCE_KEPT).collect())
    return {r["sign"]: i for i, r in enumerate(rows)}


def _training_chains(sentences: DataFrame, evidence: dict[str, int]):
    """Labelled chains as arrays: those with evidence one by one, the others counted by length."""
    kind = "toxic int, found string, n bigint"

    def encode(batches):
        known = Known(evidence)
        for batch in batches:
            seen = Counter()
            for words, toxic in zip(batch["sentence"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                found = [known[w] for w in words.split(" ")]
                row = ";".join(",".join(map(str, f)) for f in found)
                seen[toxic if any(found) else 0, row] += 1
            yield pa.RecordBatch.from_pydict(
                {"toxic": pa.array([k[0] for k in seen], pa.int32()),
                 "found": pa.array([k[1] for k in seen], pa.string()),
                 "n": pa.array(list(seen.values()), pa.int64())})

    rows = (sentences.mapInArrow(encode, kind).groupBy("toxic", "found").agg(F.sum("n").alias("n"))
            .orderBy("found", "toxic").collect())
    wide = len(_PREFIXES) + 1
    tokens = np.full((len(rows), CHAIN, wide), -1)
    gold = np.zeros((len(rows), CHAIN))
    inside = np.zeros((len(rows), CHAIN), bool)
    for i, row in enumerate(rows):
        parts = row["found"].split(";")
        inside[i, :len(parts)] = True
        for t, part in enumerate(parts):
            if part:
                ids = [int(x) for x in part.split(",")]
                tokens[i, t, :len(ids)] = ids
                gold[i, t] = row["toxic"]
    return tokens, gold, inside, np.array([r["n"] for r in rows], float)


def train(docs: DataFrame, labels: DataFrame, learn, label: str = "toxic",
          rows: int = TRAIN_ROWS) -> ChainModel:
    """A model from at most ``rows`` labelled documents for which ``learn`` holds."""
    chosen = labelled_ids(labels, label, learn, rows)
    sample = checkpointed(docs.select("doc_id", whole_text().alias("text"))
                          .join(F.broadcast(chosen), "doc_id"))
    sentences = checkpointed(_sentences(sample.select("text", "label")))
    evidence = _evidence(sentences)
    if evidence:
        model = fit_chain(evidence, *_training_chains(sentences, evidence))
    else:
        model = ChainModel({}, np.array([-20.0]), np.zeros((2, 2)), 0.0)
    got = _read(sample, model, spans=False).select("_read.none", "_read.expected", "label").toArrow()
    read = np.array([got[c].to_pylist() for c in ("none", "expected", "label")], float)
    none, expected, y = read[:, np.lexsort(read)]  # sums do not depend on the order of arrival
    if len(set(y)) == 2:
        model.outer = logistic(_outer_inputs(none, expected), y)
    else:
        model.outer = np.array([0.0, 0.0, math.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    return model


_READ = T.StructType([
    T.StructField("none", T.DoubleType()), T.StructField("expected", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("probability", T.DoubleType())])))])


def _read(df: DataFrame, model: ChainModel, spans: bool = True) -> DataFrame:
    kind = pa.struct([("none", pa.float64()), ("expected", pa.float64()), ("spans", pa.list_(pa.struct(
        [("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])))])
    plain = model.plain()
    cache: list[Known] = []

    @F.arrow_udf(_READ)
    def read(texts: pa.Array) -> pa.Array:
        if not cache:
            cache.append(Known(model.evidence))
        rows = (model.read(t, cache[0], plain, spans) for t in texts.to_pylist())
        return pa.array([dict(zip(("none", "expected", "spans"), r, strict=True)) for r in rows], kind)

    return without(df, ["_read"]).withColumn("_read", read(whole_text()))


def tag(docs: DataFrame, model: ChainModel) -> DataFrame:
    """Adds ``toxic_score`` (0 to 1), ``toxic_tokens`` (expected) and ``toxic_spans``
    (start, end, probability; offsets in characters of the text, end exclusive)."""
    names = ["toxic_score", "toxic_tokens", "toxic_spans"]
    rest = without(docs, names)
    a, b, c = (float(x) for x in model.outer)
    none = F.least(F.col("_read.none"), F.lit(-1e-12))
    odds = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), F.log(-F.expm1(none)) - none))
    score = 1 / (1 + F.exp(-(F.lit(a) * odds + F.lit(b) * F.log1p("_read.expected") + F.lit(c))))
    return _read(rest, model).select(
        *[f"`{x}`" for x in rest.columns], score.alias(names[0]),
        F.col("_read.expected").alias(names[1]), F.col("_read.spans").alias(names[2]))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2,
                   threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans), a row per row of ``docs``.

    Labels of the held-out fold are never learned from. Null and empty texts are scored as empty
    ones, repeated rows get equal scores, a null id is scored and never learned from. Without
    labels of both kinds the score is the smoothed share of toxic labels, and nothing is tagged.
    """
    docs = docs.select("doc_id", "text")
    model = train(docs, labels, fold("doc_id", folds) != held_out)
    return tag(docs, model).select(
        "doc_id", (fold("doc_id", folds) == held_out).alias("held_out"),
        F.col("toxic_score").alias("score"), (F.col("toxic_score") >= threshold).cast("int").alias("predicted"),
        F.col("toxic_spans").alias("spans"))


@query("op8_toxicity_chain")
def op8_toxicity_chain(spark, sf):
    return score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
