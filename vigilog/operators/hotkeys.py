"""Cutting the timelines of hot keys into bounded pieces with exact overlap."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def time_pieces(df: DataFrame, keys: list[str], us: str, look_back: int,
                rows_per_piece: int = 200_000, slot_seconds: float = 60,
                counts: DataFrame | None = None) -> DataFrame:
    """Adds ``_piece`` and ``_own``; one window partition per (keys, _piece) stays bounded.

    Rows of a key are counted per time slot, and per instant within slots that hold much of a
    piece, so a burst is cut too. Slots are dealt to pieces of about ``rows_per_piece`` consecutive
    rows: a piece holds at most that many, its largest slot (an eighth of a piece, or one instant)
    and the rows looked back on. Every slot that holds one of the ``look_back``
    rows before a piece is copied into it (``_own`` false). A window that looks back at most
    ``look_back`` rows is therefore exact on the own rows of each piece. Keys below the limit
    keep one piece and are not copied; when no key is above it nothing is joined at all.
    ``counts`` (keys, n) may be passed where it is already known.
    """
    if rows_per_piece <= look_back:
        raise ValueError("rows_per_piece must exceed look_back")
    width = int(slot_seconds * 1_000_000)
    coarse = F.floor(F.col(us) / F.lit(width)) * F.lit(width)
    if counts is None:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = counts.where(F.col("n") > rows_per_piece).select(*keys)
    if hot.isEmpty():
        return df.select("*", F.lit(0).cast("bigint").alias("_piece"), F.lit(True).alias("_own"))
    dense = (df.join(hot, keys, "left_semi").groupBy(*keys, coarse.alias("_coarse"))
             .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_piece / 8)
             .select(*keys, "_coarse", F.lit(True).alias("_dense")))
    placed_rows = (df.withColumn("_coarse", coarse).join(dense, [*keys, "_coarse"], "left")
                   .withColumn("_slot", F.when(F.col("_dense"), F.col(us).cast("bigint")).otherwise(F.col("_coarse"))))
    slots = (placed_rows.select(*keys, "_slot").join(hot, keys, "left_semi")
             .groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n")))
    upto = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("_n").over(upto)
    size = F.lit(rows_per_piece)
    placed = slots.withColumn("_end", end).select(
        *keys, "_slot", F.floor((F.col("_end") - F.col("_n")) / size).alias("_home"), "_end")
    # a later piece starts at row _end or after; it still sees this slot if it starts within
    # look_back rows of it
    following = F.greatest(F.col("_home") + 1, F.floor(F.col("_end") / size))
    furthest = F.floor((F.col("_end") + look_back - 1) / size)
    copies = F.when(furthest >= following, F.sequence(following, furthest)).otherwise(
        F.array().cast("array<bigint>"))
    pieces = placed.select(
        *keys, "_slot",
        F.concat(
            F.array(F.struct(F.col("_home").alias("p"), F.lit(True).alias("own"))),
            F.transform(copies, lambda p: F.struct(p.alias("p"), F.lit(False).alias("own"))),
        ).alias("_pieces"),
    )
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("p"), F.lit(True).alias("own")))
    return (
        placed_rows.join(pieces, [*keys, "_slot"], "left")
        .withColumn("_p", F.explode(F.coalesce("_pieces", whole)))
        .select(*df.columns, F.col("_p.p").alias("_piece"), F.col("_p.own").alias("_own"))
    )
