"""The whole batch path: lines to merged alerts."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.operators.alerts import alerts, with_alert_id, with_chain_tags
from vigilog.operators.forest import Baseline, score
from vigilog.operators.normalize import normalize, source_key
from vigilog.operators.parse import parse_logs
from vigilog.operators.rules import enrich_with_matches
from vigilog.operators.sequence import chain_steps, match_sequences
from vigilog.session import checkpointed
from vigilog.sources.catalog import CHAINS, RULES
from vigilog.values import ANOMALY_THRESHOLD, DEDUP_SECONDS, WINDOW_CAP


@dataclass
class Detection:
    events: DataFrame
    fires: DataFrame
    alerts: DataFrame


def find_chains(events: DataFrame, chains=CHAINS, cap: int = WINDOW_CAP,
                lock_seconds: int = DEDUP_SECONDS, **options) -> DataFrame:
    """Fires of attack chains per source over matched events."""
    keyed = events.withColumn("source_key", source_key()).withColumn(
        "us", F.unix_micros("timestamp"))
    return match_sequences(keyed, ["source_key"], "us", ["event_id"], chain_steps(chains), cap,
                           lock_seconds, **options)


def detect(lines: DataFrame, rules=RULES, chains=CHAINS, model: Baseline | None = None,
           reference_year: int | None = None, minimum: str = "low",
           dedup_seconds: int = DEDUP_SECONDS, threshold: float = ANOMALY_THRESHOLD) -> Detection:
    """Parse, match, correlate, score and alert one batch of raw lines.

    The matched events are written once to the shared folder, as three stages read them.
    """
    events = checkpointed(
        enrich_with_matches(normalize(parse_logs(lines, reference_year=reference_year)), rules)
        .drop("fired"))
    fires = checkpointed(find_chains(events, chains, lock_seconds=dedup_seconds))
    tagged = with_chain_tags(events, fires, chains)
    scored = None if model is None else score(tagged, model, threshold)
    rows = alerts(events, rules, fires, scored, chains, minimum, dedup_seconds)
    rows = checkpointed(rows)
    final = with_alert_id(tagged if scored is None else scored, rows)
    return Detection(final, fires, rows)
