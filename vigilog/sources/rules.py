"""Rule documents as tables, and what changed between two looks at their folder."""

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.operators.rules import detection_groups
from vigilog.sources.catalog import MATCHER_SCHEMA, RULE_SCHEMA, RULES
from vigilog.values import LEVEL_RANK, RULE_STATUSES

REQUIRED = ("title", "detection", "logsource")


def _texts(value) -> list[str]:
    if value is None:
        return []
    return [value] if isinstance(value, str) else [str(v) for v in value]


def _yaml(text: str):
    """The document, by libyaml where it is there; what that refuses, the plain loader judges."""
    import yaml

    if yaml.__with_libyaml__:
        try:
            return yaml.load(text, yaml.CSafeLoader)
        except yaml.YAMLError:
            pass
    return yaml.safe_load(text)


def read_document(text: str, path: str) -> dict:
    """One YAML rule document to a rule row; ``error`` says why it cannot be used."""
    import yaml

    row = dict.fromkeys([c.split()[0] for c in RULE_SCHEMA.split(", ")])
    row.update(source_file=path, error=None, tags=[], falsepositives=[])
    try:
        body = _yaml(text)
    except yaml.YAMLError as error:
        return row | {"error": f"not YAML: {type(error).__name__}"}
    if not isinstance(body, dict):
        return row | {"error": "not a mapping"}
    missing = [k for k in REQUIRED if k not in body]
    if "detection" in body and (
            not isinstance(body["detection"], dict) or "condition" not in body["detection"]):
        missing.append("detection.condition")
    if missing:
        return row | {"error": "missing: " + ", ".join(missing)}
    level = str(body.get("level", "medium")).lower()
    status = str(body.get("status", "experimental")).lower()
    return row | {
        "rule_id": str(body.get("id", "")), "title": str(body["title"]),
        "status": status if status in RULE_STATUSES else "experimental",
        "level": level if level in LEVEL_RANK else "medium",
        "description": str(body.get("description", "")).strip(),
        "author": str(body.get("author", "")), "tags": _texts(body.get("tags")),
        "falsepositives": _texts(body.get("falsepositives")),
        "condition": str(body["detection"]["condition"]).strip(),
        "detection": json.dumps(body["detection"]),
    }


def parse_rule_documents(documents: DataFrame) -> DataFrame:
    """``documents(path, value)`` to the rule table plus ``error``, one row per document.

    Documents take longer to parse than to read, so they are dealt to all tasks first: a small
    file of many of them would be one.
    """
    spark = documents.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def parse(batches):
        for pdf in batches:
            yield pd.DataFrame([read_document(t, p) for p, t in zip(pdf["path"], pdf["value"])])

    return documents.select("path", "value").repartition(tasks, "path").mapInPandas(parse, RULE_SCHEMA + ", error string")


def read_rules(spark: SparkSession, path: str, pattern: str = "*.yml") -> DataFrame:
    """All rule files below a folder; bad ones carry an ``error`` and no rule."""
    files = spark.read.option("recursiveFileLookup", "true").option(
        "pathGlobFilter", pattern).text(path, wholetext=True)
    return parse_rule_documents(files.select("value", F.col("_metadata.file_path").alias("path")))


def load_rule_set(rules: DataFrame) -> list[dict]:
    """The usable rules of a rule table as the list ``apply_rules`` takes, in file order."""
    rows = rules.where("error is null") if "error" in rules.columns else rules
    return [
        dict(id=r["rule_id"], title=r["title"], level=r["level"], status=r["status"],
             description=r["description"], tags=list(r["tags"]), file=r["source_file"],
             falsepositives=list(r["falsepositives"]), detection=json.loads(r["detection"]))
        for r in rows.orderBy("source_file").toLocalIterator()
    ]


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(
        [(r["id"], r["title"], r["status"], r["level"], r["description"],
          r.get("author", "vigilog"), r["tags"], r["falsepositives"],
          r["detection"]["condition"], r["file"], json.dumps(r["detection"])) for r in rules],
        RULE_SCHEMA)


def matcher_rows(rule_id: str, detection: dict) -> list[tuple]:
    """One row per literal of a rule; a group without any keeps one row with a null value."""
    rows = []
    for group, body in detection.items():
        if group == "condition":
            continue
        before = len(rows)
        if isinstance(body, dict):
            for key, value in body.items():
                field, _, modifier = str(key).partition("|")
                for v in value if isinstance(value, list) else [value]:
                    rows.append((rule_id, group, "field", field.strip(), modifier.strip() or None,
                                 None if v is None else str(v), isinstance(v, str)))
        else:
            for v in body if isinstance(body, list) else [body]:
                rows.append((rule_id, group, "keyword", None, None,
                             None if v is None else str(v), isinstance(v, str)))
        if len(rows) == before:
            kind = "field" if isinstance(body, dict) else "keyword"
            rows.append((rule_id, group, kind, None, None, None, False))
    return rows


def rule_matchers(rules: DataFrame) -> DataFrame:
    """The literals of a rule table's detection blocks."""

    def explode(batches):
        names = [c.split()[0] for c in MATCHER_SCHEMA.split(", ")]
        for pdf in batches:
            rows = []
            for rule_id, detection in zip(pdf["rule_id"], pdf["detection"]):
                rows += matcher_rows(rule_id, json.loads(detection))
            yield pd.DataFrame(rows, columns=names)

    return rules.where("detection is not null").select("rule_id", "detection").mapInPandas(
        explode, MATCHER_SCHEMA)


def usable_groups(detection: str) -> list[str]:
    return sorted(detection_groups(json.loads(detection)))


def file_snapshot(spark: SparkSession, path: str, pattern: str = "*.yml") -> DataFrame:
    """(path, modified) of the rule files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", pattern).load(path).select(
        "path", F.col("modificationTime").alias("modified"))


def rules_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files added, modified or deleted between two snapshots (path, modified)."""
    a = old.select("path", F.col("modified").alias("_old"))
    b = new.select("path", F.col("modified").alias("_new"))
    return a.join(b, "path", "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new"))).select(
        "path",
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted")
        .otherwise("modified").alias("change"))
