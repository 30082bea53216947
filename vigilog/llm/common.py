"""What the operators of this folder share."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.session import checkpointed, configure, shared_folder  # noqa: F401 - for the operators

QUERIES: dict = {}
SQL: dict[str, str] = {}

# rows of one Arrow batch: texts may be long, and an operator holds a batch at a time
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return configure(spark)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less the columns that a result's own columns would clash with (in any case)."""
    mine = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in mine])


def whole_text(column: str | Column = "text") -> Column:
    """A text, null counting as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls in no fold (-1)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds, F.lit(-1))


def utf8(texts: pa.Array) -> list[bytes]:
    """The texts as bytes, without going through Python strings."""
    return texts.cast(pa.binary()).to_pylist()
