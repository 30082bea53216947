import datetime as dt

from pyspark.sql import functions as F

from vigilog.operators.normalize import normalize
from vigilog.operators.parse import parse_logs
from vigilog.sources.lines import frame_lines, read_logs

NOW = dt.datetime(2024, 1, 1)
LINES = [
    "<34>1 2025-03-09T04:11:30Z relay-2 sshd 5150 - - Failed password for pia from 198.51.100.41 port 2200 ssh2",
    '<13>1 2026-06-02T10:00:00.5+05:30 h a 12 m [x k="v" k="w"][y z="1"] msg\nsecond line',
    "<34>1 - - - - - - hello",
    "<200>Foo 31 25:61:00 h p[12]: hi",
    "<30>Sep  7 23:59:08 vault-a crond[640]: job rotate-keys finished",
    "CEF:0|Example|Sensor|4.1|77|Odd Beacon|6|src=172.20.9.4 spt=0 dst=198.51.100.8 dpt=8443 msg=two words|cut here",
    "CEF:0|a|b",
    '{"@timestamp":"2025-03-09T05:00:00Z","hostname":"ledger","msg":"denied for user \\"kim\\"","severity":"ERROR","pid":"7"}',
    '{"a":1,"a":2,"src":"1.2.3.4","spt":0,"dpt":443.7,"host":null,"level":"","severity":"warn"}',
    '{"ts":1717322400.5,"message":"pid=9 /a/b/c GET status=404"}',
    '{"a":1} tail', "[1,2]", '{"broken":', "", "  plain text  ",
    "uid 1.2.3.4 then 5.6.7.8 for from ünï",
]


def rows(spark, lines=LINES):
    df = spark.createDataFrame([(i, l, NOW) for i, l in enumerate(lines)],
                               "event_id int, raw string, ingested_at timestamp")
    got = normalize(parse_logs(df, reference_year=2024)).withColumn(
        "us", F.unix_micros("timestamp")).collect()
    return {int(r.event_id): r for r in got}


def us(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp() * 1_000_000)


def test_formats(spark):
    r = rows(spark)
    assert [r[i].log_source for i in range(len(LINES))] == [
        "syslog_rfc5424", "syslog_rfc5424", "syslog_rfc5424", "syslog_rfc3164", "syslog_rfc3164",
        "cef", "cef", "json", "json", "json", "plaintext", "plaintext", "plaintext", "plaintext",
        "plaintext", "plaintext"]


def test_syslog_fields(spark):
    r = rows(spark)
    assert (r[0].host, r[0].program, r[0].pid, r[0].facility, r[0].severity) == (
        "relay-2", "sshd", 5150, "auth", "crit")
    assert (r[0].source_ip, r[0].dest_port, r[0].fields["username"]) == ("198.51.100.41", 2200, "pia")
    assert r[0].tags == ["category:auth", "auth:failure"]
    assert (r[1].us, r[1].tz_offset_min) == (us(2026, 6, 2, 4, 30, 0, 500000), 330)
    assert r[1].fields == {"k": "w"} and r[1].message == '[y z="1"] msg'
    assert (r[2].host, r[2].program, r[2].pid, r[2].us) == ("unknown", None, None, us(2024, 1, 1))
    assert (r[3].us, r[3].pid, r[3].facility) == (us(2024, 1, 1), 12, None)
    assert r[4].us == us(2024, 9, 7, 23, 59, 8)


def test_cef_and_json(spark):
    r = rows(spark)
    assert (r[5].message, r[5].program, r[5].source_port, r[5].dest_port) == ("Odd Beacon", "Sensor", 0, 8443)
    assert r[5].fields["msg"] == "two words"
    assert (r[6].message, r[6].fields) == ("", {})
    assert (r[7].host, r[7].pid, r[7].severity, r[7].fields["username"]) == ("ledger", 7, "ERROR", "user")
    assert (r[8].fields["a"], r[8].source_ip, r[8].source_port, r[8].dest_port) == (
        "2", "1.2.3.4", None, 443)
    assert (r[8].host, r[8].severity) == ("unknown", "warn")
    assert r[9].us == us(2024, 6, 2, 10, 0, 0, 500000)
    assert (r[9].pid, r[9].fields["http_method"], r[9].fields["http_status"]) == (9, "GET", "404")
    assert r[9].fields["file_paths"] == "/a/b/c"


def test_plain_text(spark):
    r = rows(spark)
    assert r[10].message == '{"a":1} tail' and r[13].message == "" and r[14].message == "plain text"
    assert (r[15].source_ip, r[15].dest_ip) == ("1.2.3.4", "5.6.7.8")
    assert "username" not in r[15].fields


def test_filter_on_derived_column_does_not_blow_up(spark):
    df = spark.createDataFrame([(l, NOW) for l in LINES], "raw string, ingested_at timestamp")
    out = normalize(parse_logs(df)).where("source_ip = '1.2.3.4' and size(tags) = 0")
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    assert out.count() == 2


def test_framing(spark):
    df = spark.createDataFrame([("a\r",), ("  ",), ("x" * 70000,)], "value string")
    got = [r.raw for r in frame_lines(df, "tcp_json").collect()]
    assert got == ["a", "x" * 65535]
    assert len(frame_lines(df).collect()) == 3


def test_equal_lines_are_events_of_their_own(spark, tmp_path):
    line = "<34>1 2025-03-09T04:11:30Z relay-2 sshd 5150 - - Failed password for pia from 198.51.100.41 port 2200\n"
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "same.log").write_text(line * 3 if name == "a" else line)
    read = lambda **o: [r.event_id for r in parse_logs(read_logs(spark, str(tmp_path / "*"), **o)).collect()]
    first = read()
    assert len(set(first)) == 4 and sorted(read()) == sorted(first)
    assert len(set(read(by_name=True))) == 3  # the file in the other folder is taken for the same
    plain = spark.createDataFrame([(line, NOW)] * 3, "raw string, ingested_at timestamp")
    assert len({r.event_id for r in parse_logs(plain).collect()}) == 3
    keyed = spark.createDataFrame([(line, 0, i % 2) for i in range(4)], "raw string, topic int, offset int")
    assert len({r.event_id for r in parse_logs(keyed, identity=["topic", "offset"]).collect()}) == 2


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(str(i), l, NOW, i % 3) for i, l in enumerate(LINES)],
                          "event_id string, raw string, ingested_at timestamp, day int").write.partitionBy("day").parquet(path)
    rows = normalize(parse_logs(spark.read.parquet(path))).where("day = 1 and event_id > '0' and source_ip = '1.2.3.4'")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThan(event_id,0)" in plan
    assert plan.count("try_parse_json") <= 1 and {r.day for r in rows.collect()} <= {1}
