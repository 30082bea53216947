"""Merging repeated hits, and letting a key fire only once per lockout."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilog.session import checkpointed

LARGE_ISLAND = 5_000  # instants folded in one row; more go in islands, then in pieces
PIECE_LOCKOUTS = 64  # length of such a piece, in lockouts


def _islands(df: DataFrame, keys: list[str], us: str, gap_us: int, extra: list[Column]):
    """Hits counted per slot of one gap length, slots joined to islands.

    Two hits in one slot are less than a gap apart, so a hot key shrinks to at most one row
    per slot before anything is ordered.
    """
    slots = df.groupBy(*keys, F.floor(F.col(us) / F.lit(gap_us)).alias("_slot")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(us).alias("_lo"), F.max(us).alias("_hi"), *extra
    )
    order = Window.partitionBy(*keys).orderBy("_slot")
    before = F.lag("_hi").over(order)
    starts = F.when(before.isNull() | (F.col("_lo") - before >= gap_us), 1).otherwise(0)
    return slots.withColumn("_starts", starts).withColumn(
        "_island", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )


def dedup_gap(df: DataFrame, keys: list[str], us: str, seconds: int, tie: list[str]) -> DataFrame:
    """Merge hits of a key that follow the previous hit in less than ``seconds``.

    The first hit (by time, then ``tie``) stands for the island, with ``hit_count``,
    ``first_us`` and ``last_us``. A gap of exactly ``seconds`` opens a new one.
    """
    gap_us = int(seconds * 1_000_000)
    row = F.struct(*[F.col(c) for c in df.columns])
    first = F.min_by(row, F.struct(us, *tie)).alias("_first")
    rows = _islands(df, keys, us, gap_us, [first])
    merged = rows.groupBy(*keys, "_island").agg(
        F.min_by("_first", "_slot").alias("_first"), F.sum("_n").alias("hit_count"),
        F.min("_lo").alias("first_us"), F.max("_hi").alias("last_us"),
    )
    return merged.select("_first.*", "hit_count", "first_us", "last_us")


def _last_fire(times: np.ndarray, start: np.ndarray, lock: int) -> np.ndarray:
    """Position of the last fire of the chains that begin at the positions ``start``."""
    following = np.searchsorted(times, times + lock)
    at = start.copy()
    while True:
        step = following[at]
        moving = step < len(times)
        if not moving.any():
            return at
        at = np.where(moving, step, at)


def _piece_summary(lock: int, key_columns: list[str]):
    """Per piece of a long island: which fire is the last one, by where firing begins."""

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_us"].to_numpy())
        begin = int(pdf["_piece"].iloc[0]) * PIECE_LOCKOUTS * lock
        entries = np.arange(min(np.searchsorted(times, begin + lock) + 1, len(times)))
        exits = times[_last_fire(times, entries, lock)]
        keep = np.append(exits[1:] != exits[:-1], True)  # latest entry of each exit
        out = pd.DataFrame({"_entry": times[entries][keep], "_exit": exits[keep]})
        for c in key_columns:
            out[c] = pdf[c].iloc[0]
        return out[[*key_columns, "_entry", "_exit"]]

    return summary


def _piece_starts(lock: int, key_columns: list[str]):
    """Last fire before each piece, walking the summaries of one island in order."""

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, last = [], np.iinfo(np.int64).min // 2
        for piece, part in pdf.sort_values(["_piece", "_entry"]).groupby("_piece", sort=True):
            rows.append((piece, last))
            entries = part["_entry"].to_numpy()
            at = np.searchsorted(entries, last + lock)
            if at < len(entries):
                last = int(part["_exit"].iloc[at])
        out = pd.DataFrame(rows, columns=["_piece", "_before"])
        for c in key_columns:
            out[c] = pdf[c].iloc[0]
        return out[[*key_columns, "_piece", "_before"]]

    return starts


def _piece_fires(lock: int, key_columns: list[str]):
    def fires(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_us"].to_numpy())
        at, out = np.searchsorted(times, int(pdf["_before"].iloc[0]) + lock), []
        while at < len(times):
            out.append(times[at])
            at = np.searchsorted(times, times[at] + lock)
        result = pd.DataFrame({"_us": np.array(out, dtype="int64")})
        for c in key_columns:
            result[c] = pdf[c].iloc[0]
        return result[[*key_columns, "_us"]]

    return fires


def _folded_fires(rows: DataFrame, group: list[str], keys: list[str], lock: int) -> DataFrame:
    kept = F.aggregate(
        F.array_sort(F.collect_list("_us")),
        F.array().cast("array<bigint>"),
        lambda kept, t: F.when(
            (F.size(kept) == 0) | (t - F.get(kept, F.size(kept) - 1) >= lock),
            F.concat(kept, F.array(t)),
        ).otherwise(kept),
    )
    return rows.groupBy(*group).agg(kept.alias("_kept")).select(
        *keys, F.explode("_kept").alias("_us"))


def _island_fires(instants: DataFrame, keys: list[str], lock: int, limit: int) -> DataFrame:
    slots = _islands(instants, keys, "_us", lock, [])
    sized = slots.withColumn(
        "_size", F.sum("_n").over(Window.partitionBy(*keys, "_island"))
    ).select(*keys, "_slot", F.col("_island").cast("bigint").alias("_island"), "_size")
    rows = instants.withColumn("_slot", F.floor(F.col("_us") / F.lit(lock))).join(
        sized, [*keys, "_slot"])
    island = [*keys, "_island"]
    short = _folded_fires(rows.where(F.col("_size") <= limit), island, keys, lock)

    types = dict(instants.dtypes)
    typed = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["_island bigint"])
    long = rows.where(F.col("_size") > limit).select(
        *island, "_us",
        F.floor(F.col("_us") / F.lit(lock * PIECE_LOCKOUTS)).cast("bigint").alias("_piece"))
    summaries = long.groupBy(*island, "_piece").applyInPandas(
        _piece_summary(lock, [*island, "_piece"]),
        f"{typed}, _piece bigint, _entry bigint, _exit bigint")
    starts = summaries.groupBy(*island).applyInPandas(
        _piece_starts(lock, island), f"{typed}, _piece bigint, _before bigint")
    fires = long.join(starts, [*island, "_piece"]).groupBy(*island, "_piece").applyInPandas(
        _piece_fires(lock, island), f"{typed}, _us bigint")
    return short.unionByName(fires.select(*keys, "_us"))


def throttle(df: DataFrame, keys: list[str], us: str, seconds: float, tie: list[str],
             large_island: int = LARGE_ISLAND) -> DataFrame:
    """Keep a row of a key only ``seconds`` or more after the last row *kept*.

    Keys with few instants are folded in one expression. Beyond that, a pause of ``seconds``
    frees a key whatever happened before, so the islands between pauses are independent. An
    island that is itself long (a hot key that never pauses) is cut into pieces; each piece
    says where it ends for every way of entering it, and those answers are chained.
    """
    lock = int(seconds * 1_000_000)
    first = checkpointed(df.groupBy(*keys, us).agg(
        F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*tie)).alias("_row")))
    instants = first.select(*keys, F.col(us).alias("_us"))
    busy = instants.groupBy(*keys).count().where(F.col("count") > large_island)
    if busy.isEmpty():
        kept = _folded_fires(instants, keys, keys, lock)
    else:
        kept = _island_fires(instants, keys, lock, large_island)
    return first.join(kept.withColumnRenamed("_us", us), [*keys, us], "left_semi").select(
        "_row.*")
