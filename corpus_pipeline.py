"""A training corpus from documents: five stages, each a table that the next one reads."""

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vigilog.llm import bpe, leaks, lines, neardup, toxicity  # noqa: E402
from vigilog.llm.common import fold, prepare, table  # noqa: E402
from vigilog.session import job_folder  # noqa: E402

TOXIC = 0.3  # documents of this score or more are rejected


def boxed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): no column of the documents can clash with those an operator adds."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC, learned from the labels outside the held-out fold."""
    prepare(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    if not model.evidence:  # no label tells documents apart: all have one score, and none is known to be toxic
        return docs
    return toxicity.tag(boxed(docs), model).where(F.col("toxic_score") < TOXIC).select("row.*")


def unique_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand in an earlier document; texts of nothing else go."""
    prepare(spark)
    cut = lines.dedup_lines(boxed(docs)).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
           .otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return cut.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the smallest id."""
    prepare(spark)
    found = neardup.near_copies(docs, size=5, percent=80)
    dropped = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    prepare(spark)
    return leaks.decontaminate(boxed(docs), table(spark, sf_dir, "benchmark")).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): packed token ids, and the text that they decode to."""
    prepare(spark)
    coded = bpe.round_trip(docs.select("doc_id", "text"))
    return coded.select("doc_id", "n_tokens", "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("toxicity", clean),
    ("line dedup", unique_passages),
    ("near-dedup", unique_documents),
    ("decontamination", without_benchmark),
    ("byte-level BPE", tokens),
]

# a fitted model decides in the first stage, so SQL cannot state the rows
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet, below this application's
    folder (``session.release`` deletes it), and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{job_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
