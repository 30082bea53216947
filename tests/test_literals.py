"""The dictionary of literals against the rules as one expression."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilog.operators.literals import required_word, required_words
from vigilog.operators.rules import match_rules

PIECES = ["user", "USER7", "Failed", "lOgin", "sudo", "/etc/passwd", "root", "é", "ſtop", "K", "", "ad", "admin", "in"]


def rule(number, rng):
    def value():
        return rng.choice(PIECES) + rng.choice(["", "", rng.choice(PIECES), "x"])

    def body():
        kind = rng.randrange(6)
        if kind < 2:
            return [value() for _ in range(rng.randint(0, 3))]
        if kind == 2:
            return value()
        field = rng.choice(["message", "program", "host", "k"])
        modifier = rng.choice(["", "|contains", "|startswith", "|endswith", "|re", "|odd"])
        values = [value() for _ in range(rng.randint(1, 3))]
        if modifier == "|re":
            values = [rng.choice([r"fail\w+", r"^user\d?", "(root|sudo)", "[", r"s?top", "lo.in", "k+", r"(?:ad)+min", "a{0,2}d", "passwd$"])]
        return {f"{field}{modifier}": values, **({"severity": ["high", 3]} if rng.random() < 0.2 else {})}

    groups = {f"g{k}": body() for k in range(rng.randint(1, 4))}
    condition = rng.choice(["g0", "not g0", "g0 and not g1", "1 of g*", "all of them", "g0 or (g1 and not g2)", "1 of zz*",
                            "not (g0 and g1) and 1 of them", "g9 or g0", "g1 and g0 or not g3"])
    return {"id": str(number), "title": f"T{number}", "level": "low", "tags": [], "detection": groups | {"condition": condition}}


def events(spark, rng):
    word = lambda: rng.choice(PIECES) + rng.choice(["", " ", "x", "\n"])
    text = lambda: None if rng.random() < 0.1 else "".join(word() for _ in range(rng.randint(0, 6)))
    rows = [(str(i), text(), text(), text(), text(), rng.choice(["HIGH", "low", None]), {"k": text()} if i % 3 else None) for i in range(300)]
    return spark.createDataFrame(rows, "event_id string, raw string, message string, program string, host string, severity string, fields map<string,string>")


def test_same_rules_fire_for_the_same_groups(spark):
    rng = random.Random(21)
    rules, df = [rule(i, rng) for i in range(150)], events(spark, rng).repartition(3)
    rows = lambda n: {r.event_id: [(f.rule, list(f.groups)) for f in r.fired] for r in match_rules(df, rules, n).collect()}
    want = rows(1 << 30)
    assert rows(0) == want and sum(map(len, want.values())) > 1000
    got = match_rules(df.limit(0), rules, 0)
    assert got.count() == 0 and got.dtypes == match_rules(df, rules, 1 << 30).dtypes
    assert match_rules(df, [], 0).where(F.size("fired") > 0).count() == 0


@pytest.mark.parametrize("pattern,words", [
    ("abc", ["abc"]), ("AB.cd", ["ab", "cd"]), ("a(bc)d", ["abcd"]), ("(ab)+c", ["ab", "c"]), ("(ab)*c", ["c"]), ("ab?c", ["a", "c"]),
    ("a|b", []), ("x(a|b)y", ["x", "y"]), (r"^foo\b bar$", ["foo bar"]), ("(?=zz)a", ["a"]), ("[ab]c{2,}", ["c"]), ("é1", ["1"]),
    ("(?i:AbC)x", ["abcx"]), ("", []), (r"a\.b", ["a.b"])])
def test_required_words(pattern, words):
    assert required_words(pattern) == words


def test_required_words_are_required():
    rng = np.random.default_rng(2)
    for pattern in ("fo+(b|c)a", "(ab){2}x?y", "a.c|abc", r"\bfo", "(?:x|)yz*", "a(?!b)c"):
        for _ in range(4000):
            text = "".join(rng.choice(list("abcfoxyz "), 6))
            if re.search(pattern, text):
                assert all(w in text for w in required_words(pattern))


def test_a_regex_runs_only_where_its_word_stands(spark):
    """On 1,000 lines of which 10 hold the word, the pattern is tried on those and on the lines beyond ASCII."""
    pattern = r"(a+)+ failed for \w+$"
    assert required_word(pattern) == " failed for "
    rows = [(str(i), "aaaa failed for x" if i % 100 == 0 else "é" if i % 250 == 1 else "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa!") for i in range(1000)]
    df = spark.createDataFrame(rows, "event_id string, message string").withColumn("raw", F.col("message"))
    one = [{"id": "1", "title": "T", "level": "low", "tags": [], "detection": {"g": {"message|re": pattern}, "condition": "g"}}]
    tried = df.where(F.contains(F.lower("message"), F.lit(required_word(pattern))) | (F.octet_length("message") != F.length("message")))
    assert tried.count() == 14
    assert match_rules(df, one).where(F.size("fired") > 0).count() == 10
