"""Session settings the jobs rely on, and the one way to cut a lineage."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SETTINGS = {
    # the JVM does not compile larger methods: below it stages run as several small ones
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # event times are instants; hours of day are derived from the line's own offset
    "spark.sql.session.timeZone": "UTC",
    # a JSON line may repeat a key: the last value counts
    "spark.sql.variant.allowDuplicateKeys": "true",
    # list state and timers of streams
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate results (``spark.checkpoint.dir``).

    Only on one machine (tests, a laptop) a temporary one is chosen where none is named;
    executors on other machines could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def job_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/vigilog-{spark.sparkContext.applicationId}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as a written table in the shared folder: computed once, lineage cut.

    Survives the loss of executors, and what reads it knows its size. ``release`` deletes it.
    """
    spark = df.sparkSession
    path = f"{job_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, rows_per_task: int = 25_000) -> DataFrame:
    """The rows dealt to tasks of about ``rows_per_task`` by ``key``, for work that takes longer than
    reading: a small file, or a file of one row group, is read by one task however many rows it has."""
    return df.repartition(max(1, -(-df.count() // rows_per_task)), key)


def with_position(ordered: DataFrame, name: str = "position") -> DataFrame:
    """Adds each row's number, from 1, in the order the rows are sorted in: the place within its
    part of the written table plus the sizes of the parts before, so no task sees all rows."""
    rows = checkpointed(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(
        name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_before", "_at")


def release(spark: SparkSession) -> None:
    """Deletes all tables that this application wrote by ``checkpointed``; call it when the
    results that read them are written."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(job_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
