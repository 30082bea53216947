"""Incidents: merged from alerts, and folded from a log of actions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.functions.severity import severity_rank
from vigilog.functions.text import literal_map
from vigilog.operators.hotkeys import time_pieces
from vigilog.values import (
    INCIDENT_END_STATES, INCIDENT_MOVES, INCIDENT_STATES, RETRAIN_THRESHOLD,
)

ROWS_PER_PIECE = 10_000


def merge_incident(alerts: DataFrame, by: str) -> DataFrame:
    """One incident per value of ``by``: worst severity, earliest title, and the sets of
    techniques and tactics (each bounded by the catalogue)."""
    rows = alerts.withColumn("_rank", severity_rank("severity"))
    head = rows.groupBy(by).agg(
        F.min_by("title", F.struct("us", "alert_id")).alias("title"),
        F.max_by("severity", "_rank").alias("severity"),
        F.array_join(F.array_sort(F.collect_set(F.when(
            F.col("mitre_tactic") != "", F.col("mitre_tactic")))), " → ").alias("mitre_tactic"),
        F.min("us").alias("created_us"), F.count(F.lit(1)).alias("alerts"))
    techniques = rows.select(by, F.explode("mitre_techniques").alias("t")).groupBy(by).agg(
        F.array_sort(F.collect_set("t")).alias("mitre_techniques"))
    return head.join(techniques, by, "left").withColumn(
        "mitre_techniques", F.coalesce("mitre_techniques", F.array().cast("array<string>")))


def incident_members(alerts: DataFrame, by: str) -> DataFrame:
    """The alerts and sources of each incident, one row per alert."""
    return alerts.select(by, "alert_id", "source_key", "fingerprint")


def auto_incident(alerts: DataFrame) -> DataFrame:
    """Alerts to open an incident from: all critical and high chains, else the newest five."""
    worst = alerts.where(
        F.col("severity").isin("critical", "high") & (F.col("alert_type") == "correlation"))
    newest = alerts.orderBy(F.desc("us"), "alert_id").limit(5)
    none = worst.agg(F.count(F.lit(1)) == 0).scalar()
    return worst.unionByName(newest.where(none))


def _move(state: Column, target: Column) -> Column:
    allowed = F.create_map(*[
        x for s, targets in INCIDENT_MOVES.items()
        for x in (F.lit(s), F.array(*[F.lit(t) for t in targets]).cast("array<string>"))])
    return F.array_contains(F.element_at(allowed, state), target)


def fold_states(actions: DataFrame, rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Final state per incident of its ordered state changes; moves not allowed are refused.

    A run of changes is a function from the state before it to the state after it. Long logs
    are folded in pieces for every state they may begin in, and the pieces are then chained.
    """
    changes = actions.where("action = 'state'").select("incident_id", "us", "seq", "value")
    pieces = time_pieces(changes, ["incident_id"], "us", 0, rows_per_piece).where("_own")
    start = F.array(*[
        F.struct(F.lit(s).alias("state"), F.lit(None).cast("bigint").alias("closed_us"),
                 F.lit(None).cast("bigint").alias("changed_us"),
                 F.lit(0).cast("bigint").alias("moves"), F.lit(0).cast("bigint").alias("refused"))
        for s in INCIDENT_STATES])

    def step(table, change):
        return F.transform(table, lambda x: F.when(
            _move(x["state"], change["value"]),
            F.struct(change["value"].alias("state"),
                     F.when(change["value"].isin(INCIDENT_END_STATES), change["us"])
                     .otherwise(x["closed_us"]).alias("closed_us"),
                     change["us"].alias("changed_us"), (x["moves"] + 1).alias("moves"),
                     x["refused"].alias("refused")),
        ).otherwise(F.struct(
            x["state"].alias("state"), x["closed_us"].alias("closed_us"),
            x["changed_us"].alias("changed_us"), x["moves"].alias("moves"),
            (x["refused"] + 1).alias("refused"))))

    folded = pieces.groupBy("incident_id", "_piece").agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("us", "seq", "value"))), start, step)
        .alias("_table"))
    position = literal_map({s: i for i, s in enumerate(INCIDENT_STATES)})

    def chain(x, piece):
        y = F.get(piece["_table"], F.element_at(position, x["state"]))
        return F.struct(
            y["state"].alias("state"), F.coalesce(y["closed_us"], x["closed_us"])
            .alias("closed_us"), F.coalesce(y["changed_us"], x["changed_us"]).alias("changed_us"),
            (x["moves"] + y["moves"]).alias("moves"),
            (x["refused"] + y["refused"]).alias("refused"))

    first = F.get(start, F.lit(INCIDENT_STATES.index("new")))
    return folded.groupBy("incident_id").agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("_piece", "_table"))), first, chain)
        .alias("_final")).select("incident_id", "_final.*")


def fold_incidents(actions: DataFrame, now_us: int | None = None,
                   rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Current state of each incident from ``actions(incident_id, us, seq, action, value,
    author, fingerprints)``; actions are create, state, owner, note and disposition."""
    at = F.struct("us", "seq")
    of = lambda kind: F.col("action") == kind
    wrong = of("disposition") & (F.col("value") == "false_positive") & (
        F.size(F.coalesce("fingerprints", F.array().cast("array<string>"))) > 0)
    facts = actions.groupBy("incident_id").agg(
        F.min("us").alias("created_us"),
        F.max_by("value", F.when(of("owner"), at)).alias("owner"),
        F.max_by("value", F.when(of("disposition"), at)).alias("disposition"),
        F.max_by("fingerprints", F.when(wrong, at)).alias("fp_fingerprints"),
        F.count_if(of("note")).alias("notes"),
        F.max(F.when(~of("state"), F.col("us"))).alias("_touched"))
    rows = facts.join(fold_states(actions, rows_per_piece), "incident_id", "left")
    end = F.coalesce("closed_us", F.unix_micros(F.current_timestamp())
                     if now_us is None else F.lit(now_us))
    return rows.select(
        "incident_id", F.coalesce("state", F.lit("new")).alias("state"), "owner", "disposition",
        (F.coalesce("disposition", F.lit("")) == "false_positive").alias("is_false_positive"),
        "fp_fingerprints", "notes", F.coalesce("moves", F.lit(0)).alias("moves"),
        F.coalesce("refused", F.lit(0)).alias("refused"), "created_us",
        F.greatest("_touched", "changed_us").alias("updated_us"), "closed_us",
        ((end - F.col("created_us")) / 1_000_000).alias("age_seconds"))


def list_incidents(incidents: DataFrame, state: str | None = None, owner: str | None = None,
                   limit: int = 100) -> DataFrame:
    if state:
        incidents = incidents.where(F.col("state") == state)
    if owner:
        incidents = incidents.where(F.col("owner") == owner)
    return incidents.orderBy(F.desc("created_us"), "incident_id").limit(limit)


def incidents_by_state(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("state").agg(F.count(F.lit(1)).alias("incidents"))


def pending_false_positives(actions: DataFrame, threshold: int = RETRAIN_THRESHOLD,
                            store: str | None = None, rows_per_piece: int = ROWS_PER_PIECE
                            ) -> DataFrame:
    """Fingerprints waiting and retrainings so far, per store.

    Every false-positive disposition adds its fingerprints; at the threshold a retraining
    empties the count. The count before an action is below the threshold, so a piece of the
    log is a table over those few counts, and pieces are chained.
    """
    key = F.lit("all") if store is None else F.col(store)
    adds = actions.where("action = 'disposition' and value = 'false_positive'").select(
        key.alias("store"), "us", "seq", F.size("fingerprints").alias("n")).where("n > 0")
    pieces = time_pieces(adds, ["store"], "us", 0, rows_per_piece).where("_own")
    start = F.array(*[
        F.struct(F.lit(i).alias("pending"), F.lit(0).cast("bigint").alias("retrains"))
        for i in range(threshold)])

    def step(table, add):
        return F.transform(table, lambda x: F.when(
            x["pending"] + add["n"] >= threshold,
            F.struct(F.lit(0).alias("pending"), (x["retrains"] + 1).alias("retrains")),
        ).otherwise(F.struct((x["pending"] + add["n"]).alias("pending"),
                             x["retrains"].alias("retrains"))))

    folded = pieces.groupBy("store", "_piece").agg(
        F.sum("n").alias("n"),
        F.aggregate(F.array_sort(F.collect_list(F.struct("us", "seq", "n"))), start, step)
        .alias("_table"))

    def chain(x, piece):
        y = F.get(piece["_table"], x["pending"])
        return F.struct(y["pending"].alias("pending"),
                        (x["retrains"] + y["retrains"]).alias("retrains"))

    final = F.aggregate(F.array_sort(F.collect_list(F.struct("_piece", "_table"))),
                        F.get(start, F.lit(0)), chain)
    return folded.groupBy("store").agg(
        F.sum("n").alias("fingerprints"), final.alias("_f")).select(
        "store", "fingerprints", F.col("_f.pending").alias("pending"),
        F.col("_f.retrains").alias("retrains"))


def feedback_stats(incidents: DataFrame, pending: DataFrame) -> DataFrame:
    """False-positive incidents beside what waits for retraining; one row."""
    one = F.lit(1).alias("_one")
    counts = incidents.agg(
        F.count(F.lit(1)).alias("total_incidents"),
        F.count_if("is_false_positive").alias("false_positive_incidents")).select("*", one)
    waiting = pending.agg(
        F.coalesce(F.sum("pending"), F.lit(0)).alias("pending_fp_fingerprints"),
        F.coalesce(F.sum("retrains"), F.lit(0)).alias("retrain_count")).select("*", one)
    return counts.join(waiting, "_one").drop("_one")
