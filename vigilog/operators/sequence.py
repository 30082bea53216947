"""Ordered multi-step patterns per source in a sliding window."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilog.functions.text import all_of, any_of
from vigilog.operators.dedup import throttle
from vigilog.operators.hotkeys import time_pieces
from vigilog.operators.rules import TEXT_MARK
from vigilog.session import checkpointed
from vigilog.sources.catalog import CHAINS
from vigilog.values import DEDUP_SECONDS, WINDOW_CAP


def step_text() -> Column:
    """Fired titles, tags and message as one lower-case text, kept apart by marks."""
    return F.lower(F.concat_ws(TEXT_MARK, F.col("sigma_matches"), F.col("tags"), F.col("message")))


def step_matches(matchers: list[str]) -> Column:
    """Any matcher inside a fired title, a tag or the message, or equal to the program."""
    words = list(dict.fromkeys(m.lower() for m in matchers))
    return any_of([F.contains(step_text(), F.lit(w)) for w in words] + [
        F.coalesce(F.lower("program").isin(words), F.lit(False))])


def chain_steps(chains=CHAINS) -> list[tuple]:
    """(chain id, window seconds, step predicates) on the event columns."""
    return [
        (c["id"], c["window_seconds"], [step_matches(m) for _, m in c["steps"]]) for c in chains
    ]


def window_rows(df: DataFrame, keys: list[str], us: str, tie: list[str], seconds: float,
                cap: int = WINDOW_CAP, rows_per_piece: int = 200_000) -> DataFrame:
    """Adds what the window ending at each row holds: ``window_count``, ``window_first_us``.

    The window is every row of the key not older than ``seconds``, the newest ``cap`` of them.
    """
    width = int(seconds * 1_000_000)
    rows = time_pieces(df, keys, us, cap - 1, rows_per_piece)
    order = Window.partitionBy(*keys, "_piece").orderBy(us, *tie)
    older = Window.partitionBy(*keys, "_piece").orderBy(us).rangeBetween(
        Window.unboundedPreceding, -width - 1)
    number = F.row_number().over(order)
    start = F.greatest(F.count(us).over(older) + 1, number - (cap - 1))
    rows = rows.select("*", number.alias("_rn"), start.alias("_start"))
    at_start = rows.select(*keys, "_piece", F.col("_rn").alias("_start"),
                           F.col(us).alias("window_first_us"))
    return (
        rows.where("_own").join(at_start, [*keys, "_piece", "_start"])
        .select(*df.columns, (F.col("_rn") - F.col("_start") + 1).alias("window_count"),
                "window_first_us")
    )


def match_sequences(df: DataFrame, keys: list[str], us: str, tie: list[str], chains: list[tuple],
                    cap: int = WINDOW_CAP, lock_seconds: float = DEDUP_SECONDS,
                    fire_on: str = "any", rows_per_piece: int = 200_000,
                    throttled: bool = True, evidence: bool = True) -> DataFrame:
    """Fires of ordered step chains: (chain_id, keys, us, tie, first_us, steps); the last two
    only with ``evidence``.

    A chain holds at a row when the key's window (``window`` seconds, newest ``cap`` rows)
    contains its steps in order, gaps allowed, one step per row. ``fire_on='any'`` lets every
    row fire while the window still holds the chain, ``'completion'`` only rows of the last
    step. A chain fires once per key and lockout.

    Instead of scanning each window, every row carries per prefix of the chain the latest
    possible start of a completed prefix; the chain holds iff that start is in the window. All
    chains share one partitioning and one sort, and hot keys are cut into pieces.
    """
    base_columns = [*keys, us, *tie]
    flags = {}
    for c, (chain_id, _, steps) in enumerate(chains):
        for s, step in enumerate(steps):
            flags[f"_m{c}_{s}"] = F.coalesce(step, F.lit(False))
    rows = df.select(*base_columns, *[p.alias(n) for n, p in flags.items()])

    # only keys that have every step of some chain can fire at all
    seen = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.bool_or(n).alias(n) for n in flags])
    whole = any_of([
        all_of([F.col(f"_m{c}_{s}") for s in range(len(steps))])
        for c, (_, _, steps) in enumerate(chains)
    ])
    seen = checkpointed(seen.where(whole).select(*keys, "n"))
    rows = rows.join(seen, keys, "left_semi")

    rows = time_pieces(rows, keys, us, cap - 1, rows_per_piece, counts=seen)
    part = Window.partitionBy(*keys, "_piece")
    order = part.orderBy(us, *tie)
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_rn", F.row_number().over(order))
    longest = max(len(steps) for _, _, steps in chains)
    for s in range(longest):
        starts = []
        for c, (_, _, steps) in enumerate(chains):
            if s >= len(steps):
                continue
            hit = F.col(f"_m{c}_{s}")
            for what, own in (("rn", "_rn"), ("us", us)):
                value = F.col(own) if s == 0 else F.max(f"_{what}{c}_{s - 1}").over(before)
                starts.append(F.when(hit, value).alias(f"_{what}{c}_{s}"))
        rows = rows.select("*", *starts)
    # running maximum of the last step's start: the latest start of a whole chain so far
    held = []
    for c, (_, _, steps) in enumerate(chains):
        last = len(steps) - 1
        start_us = F.max(f"_us{c}_{last}").over(past)
        start_rn = F.max(f"_rn{c}_{last}").over(past)
        held += [start_us.alias(f"_start{c}"), start_rn.alias(f"_startrn{c}")]
    rows = rows.select("*", *held)
    fires = []
    for c, (chain_id, seconds, steps) in enumerate(chains):
        width = int(seconds * 1_000_000)
        holds = (F.col(f"_start{c}") >= F.col(us) - width) & (
            F.col("_rn") - F.col(f"_startrn{c}") <= cap - 1)
        if fire_on == "completion":
            holds = holds & F.col(f"_m{c}_{len(steps) - 1}")
        fires.append(F.when(holds, F.struct(
            F.lit(chain_id).alias("chain_id"), F.lit(c).alias("number"))))
    rows = checkpointed(rows.select(
        *base_columns, "_piece", "_rn", *flags,
        F.when(F.col("_own"), F.array_compact(F.array(*fires))).alias("_fires")))
    candidates = (
        rows.select(*base_columns, "_piece", "_rn", F.explode("_fires").alias("_fire"))
        .select(F.col("_fire.chain_id").alias("chain_id"), *base_columns,
                F.col("_fire.number").alias("_number"), "_piece", "_rn")
    )
    if throttled:
        candidates = throttle(candidates, ["chain_id", *keys], us, lock_seconds, tie)
    if not evidence:
        return candidates.drop("_number", "_piece", "_rn")
    return _with_evidence(candidates, rows, keys, us, tie, chains, cap)


def _with_evidence(fired: DataFrame, rows: DataFrame, keys: list[str], us: str, tie: list[str],
                   chains: list[tuple], cap: int) -> DataFrame:
    """Adds ``first_us``, the time of the oldest row of the fired row's window, and ``steps``,
    the greedy earliest row of each step inside it.

    A window reaches back less than ``cap`` rows, so its rows lie in two blocks of ``cap`` row
    numbers: an equality join on the block, bounded per fired row.
    """
    widths = F.array(*[F.lit(int(w * 1_000_000)) for _, w, _ in chains])
    counts = F.array(*[F.lit(len(steps)) for _, _, steps in chains])
    marks = F.array(*[
        F.array(*[F.col(f"_m{c}_{s}") for s in range(len(steps))])
        for c, (_, _, steps) in enumerate(chains)
    ])
    block = F.floor(F.col("_rn") / F.lit(cap))
    context = rows.select(
        *keys, "_piece", block.alias("_block"), F.col("_rn").alias("_row"),
        F.struct(F.col("_rn").alias("rn"), F.col(us).alias("us"),
                 *[F.col(t).alias(t) for t in tie]).alias("_at"), marks.alias("_marks"))
    asked = fired.withColumn("_block", F.explode(F.array(block, block - 1)))
    found = asked.join(context, [*keys, "_piece", "_block"]).where(
        (F.col("_row") <= F.col("_rn")) & (F.col("_row") > F.col("_rn") - cap)
        & (F.col("_at.us") >= F.col(us) - F.get(widths, F.col("_number"))))
    found = found.withColumn("_hit", F.get("_marks", F.col("_number")))
    gathered = found.groupBy("chain_id", *keys, us, *tie, "_number").agg(
        F.min("_at.us").alias("first_us"),
        F.array_sort(F.collect_list(F.when(
            F.exists("_hit", lambda m: m), F.struct("_at", "_hit")))).alias("_rows"))
    empty = F.slice(F.transform("_rows", lambda r: r["_at"]), 1, 0)
    steps = F.aggregate(
        "_rows", empty,
        lambda taken, r: F.when(
            (F.size(taken) < F.get(counts, F.col("_number")))
            & F.get(r["_hit"], F.size(taken)),
            F.concat(taken, F.array(r["_at"]))).otherwise(taken))
    return gathered.select("chain_id", *keys, us, *tie, "first_us", steps.alias("steps"))
