"""Many rule documents in a small file: dealt to all tasks, read as the plain loader reads them."""

import pytest
import yaml
from pyspark.sql import functions as F

from vigilog.sources import rules as R

BODY = "title: a {0}\nid: r{0}\nlevel: low\nlogsource: {{product: x}}\ndetection:\n  sel: [a, 1, null, 1e3, yes]\n  condition: sel\n"
ODD = ["", "a: [", "\tx: 1", "a: b: c", "- 1", "a: &x [1, *x]", "a: *gone", "a: 1\n---\nb: 2", "a: \x00", "a: \x85b", "\ufeffa: 1",
       "a: !!python/object:os.system x", "? [1, 2]\n: 3", "a: 'é\U0001f600'", "a: \"\\q\"", "%YAML 9.9\n---\na: 1", "a: 12:30:45",
       "a: 2024-02-30", "{a: 1, a: 2}", "a: |\n  x\n y", "a: 0o17", "a: 010", "a: .inf", "title: t\nlogsource: 1\ndetection: {s: [x]}"]


def test_odd_documents_are_read_as_by_the_plain_loader(monkeypatch):
    texts = ODD + [BODY.format(7)]
    got = [_tried(t) for t in texts]
    monkeypatch.setattr(yaml, "__with_libyaml__", False)
    assert got == [_tried(t) for t in texts]


def _tried(text):
    try:
        return repr(R.read_document(text, "p"))
    except Exception as error:  # noqa: BLE001 - what the plain loader lets through both let through
        return type(error).__name__


def test_libyaml_reads_what_it_can(monkeypatch):
    if not yaml.__with_libyaml__:
        pytest.skip("no libyaml")
    monkeypatch.setattr(yaml, "safe_load", lambda text: pytest.fail("slow loader"))
    assert R.read_document(BODY.format(1), "p")["title"] == "a 1"


def test_documents_of_one_partition_are_parsed_by_several_tasks(spark):
    documents = spark.range(400).coalesce(1).select(
        F.concat(F.lit("p"), "id").alias("path"), F.format_string(BODY.replace("{0}", "%1$d").replace("{{", "{").replace("}}", "}"), "id").alias("value"))
    rows = R.parse_rule_documents(documents)
    assert rows.where("error is null").count() == 400
    assert rows.select(F.spark_partition_id()).distinct().count() > 1
