"""Rules tested on lines whose verdict is known."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.operators.normalize import normalize
from vigilog.operators.parse import parse_logs
from vigilog.operators.rules import check_rules, match_rules


def test_rules(lines: DataFrame, rules: list[dict], reference_year: int | None = None) -> DataFrame:
    """``lines(case_id, title, should_match, raw)`` with ``matched`` and ``passed``.

    Lines are parsed and matched once, against all rules; a line asks about the rule it names.
    """
    rules, _ = check_rules(rules)
    titles = F.array(*[F.lit(r["title"]) for r in rules])
    events = normalize(parse_logs(lines.withColumn(
        "event_id", F.col("case_id").cast("string")), reference_year=reference_year))
    rows = match_rules(events, rules)
    matched = F.exists("fired", lambda f: F.get(titles, f["rule"]) == F.col("title"))
    return rows.select("case_id", "title", "should_match", matched.alias("matched")).withColumn(
        "passed", F.col("matched") == F.col("should_match"))


test_rules.__test__ = False  # not a test case of this repository


def rule_test_report(results: DataFrame) -> DataFrame:
    """Tests, passes and failures per rule."""
    return results.groupBy("title").agg(
        F.count(F.lit(1)).alias("tests"), F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"))
