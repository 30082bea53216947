"""Raw log lines from files, as a batch or as a stream."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vigilog.values import BLANKS, MAX_LINE_BYTES


def frame_lines(df: DataFrame, transport: str = "file", sender=None) -> DataFrame:
    """Lines as messages: cut at the byte limit, line ends off, blank JSON lines dropped."""
    cut = F.decode(F.substring(F.encode(F.col("value"), "UTF-8"), 1, MAX_LINE_BYTES), "UTF-8")
    text = F.when(F.octet_length("value") > MAX_LINE_BYTES, cut).otherwise(F.col("value"))
    text = F.trim(text, F.lit(BLANKS)) if transport == "tcp_json" else F.rtrim(text, F.lit("\r\n"))
    rows = df.select(
        *[c for c in df.columns if c != "value"], text.alias("raw"),
        (F.lit("localhost") if sender is None else sender).alias("source_host"),
        F.lit(transport).alias("transport"))
    if "ingested_at" not in df.columns:
        rows = rows.withColumn("ingested_at", F.current_timestamp())
    return rows.where("raw <> ''") if transport == "tcp_json" else rows


def with_positions(df: DataFrame, by_name: bool = False) -> DataFrame:
    """Adds ``event_id`` to lines of files: a hash of file, block of the file and position in it.

    Equal lines differ by their position; the same file read again in blocks of the same size
    gives the same ids. A file that may be delivered once more under another folder is known by
    its name and its lines' text (``by_name``) instead of its path.
    """
    file = F.regexp_extract("_metadata.file_path", "[^/]*$", 0) if by_name else F.col("_metadata.file_path")
    rows = df.select(*df.columns, file.alias("_file"), F.col("_metadata.file_block_start").alias("_block"))

    def number(batches):
        place, at = None, 0
        for batch in batches:
            files, blocks = batch["_file"].to_pylist(), batch["_block"].to_pylist()
            positions = []
            for here in zip(files, blocks, strict=True):
                at = at + 1 if here == place else 0
                place = here
                positions.append(at)
            yield batch.append_column("_position", pa.array(positions, pa.int64()))

    schema = StructType([*rows.schema.fields, StructField("_position", LongType())])
    told = ["_file", "_block", "_position"] + (["value"] if by_name else [])
    return rows.mapInArrow(number, schema).withColumn(
        "event_id", F.sha2(F.concat_ws("\x1f", *told), 256)).drop("_file", "_block", "_position")


def read_logs(spark: SparkSession, path: str, transport: str = "file", sender=None, where=None,
              by_name: bool = False) -> DataFrame:
    """Lines with ``event_id``. ``where``: a condition on partition columns, met before any file
    is opened."""
    rows = spark.read.text(path, lineSep="\n")
    rows = rows if where is None else rows.where(where)
    return frame_lines(with_positions(rows, by_name), transport, sender)


def stream_logs(spark: SparkSession, path: str, transport: str = "file", sender=None,
                by_name: bool = False) -> DataFrame:
    """New files of a folder as they land, with ``event_id``. Another source with a ``value``
    column goes through ``frame_lines``, and ``parse_logs`` is told what identifies its lines
    (of a queue: topic, partition, offset)."""
    rows = spark.readStream.text(path, lineSep="\n")
    return frame_lines(with_positions(rows, by_name), transport, sender)
