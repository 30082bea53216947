"""Boolean detection rules over events, all of them in one scan."""

import ast
import fnmatch
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.functions.text import all_of, any_of, hold
from vigilog.operators.literals import dictionary, required_word
from vigilog.operators.normalize import get_field

TEXT_MARK = "\ue0f1\ue0f2"  # private-use characters no keyword holds
LITERALS_IN_PLAN = 250  # rule sets with more literals are matched by a dictionary of them


class RuleError(ValueError):
    """A rule that cannot be evaluated."""


# -- conditions ------------------------------------------------------------------------------

def condition_tree(condition: str, group_names: list[str]):
    """Condition text to (boolean expression tree, names by placeholder).

    Group words become placeholders, ``1 of x`` / ``all of x`` one call each; and/or/not and
    parentheses are already Python's, with the same precedence, so its own parser reads it.
    """
    words = [w for w in re.split(r"\s+|([()])", condition) if w]
    names, out, i = {}, [], 0
    while i < len(words):
        word = words[i]
        if word.lower() in ("1", "all") and i + 2 < len(words) and words[i + 1].lower() == "of":
            selector = words[i + 2]
            chosen = [g for g in group_names
                      if selector.lower() == "them" or fnmatch.fnmatch(g, selector)]
            mark = f"s{len(names)}"
            names[mark] = ("any" if word == "1" else "all", chosen)
            i += 3
        elif word in "()" or word.lower() in ("and", "or", "not"):
            mark = word.lower()
            i += 1
        elif word.lower() in ("1", "all"):
            raise RuleError(f"quantifier without 'of' in condition {condition!r}")
        else:
            mark = f"s{len(names)}"
            names[mark] = ("group", [word])
            i += 1
        out.append(mark)
    try:
        tree = ast.parse(" ".join(out), mode="eval").body
    except SyntaxError as error:
        raise RuleError(f"condition {condition!r} does not parse") from error
    if any(not isinstance(n, (ast.BoolOp, ast.UnaryOp, ast.Name, ast.boolop, ast.unaryop,
                              ast.expr_context)) for n in ast.walk(tree)):
        raise RuleError(f"condition {condition!r} does not parse")
    return tree, names


def condition_parses(condition: str) -> bool:
    try:
        condition_tree(condition, [])
        return bool(condition.strip())
    except RuleError:
        return False


def _truth(node, leaf) -> Column:
    if isinstance(node, ast.Name):
        return leaf(node.id)
    if isinstance(node, ast.UnaryOp):
        return ~_truth(node.operand, leaf)
    parts = [_truth(v, leaf) for v in node.values]
    return all_of(parts) if isinstance(node.op, ast.And) else any_of(parts)


def _reached(node, leaf, reach):
    """(leaf, condition under which it is looked at): an AND stops at its first false side."""
    if isinstance(node, ast.Name):
        return [(node.id, reach)]
    if isinstance(node, ast.UnaryOp):
        return _reached(node.operand, leaf, reach)
    found = []
    for value in node.values:
        found += _reached(value, leaf, reach)
        if isinstance(node.op, ast.And):
            reach = reach & _truth(value, leaf)
    return found


# -- matchers --------------------------------------------------------------------------------

def detection_groups(detection: dict) -> dict[str, list[tuple]]:
    """Detection block to group -> matchers (kind, field, modifier, values).

    A value of a kind that cannot be matched drops its matcher, a group left without any
    matcher drops out; an empty keyword list stays and never fires.
    """
    groups = {}
    for name, body in detection.items():
        if name == "condition":
            continue
        if isinstance(body, str):
            groups[name] = [("keyword", None, None, [body])]
        elif isinstance(body, list) and all(isinstance(v, str) for v in body):
            groups[name] = [("keyword", None, None, list(body))]
        elif isinstance(body, dict):
            matchers = []
            for key, value in body.items():
                field, _, modifier = str(key).partition("|")
                if isinstance(value, (str, int, float, bool)):
                    value = [value]
                if isinstance(value, list):
                    matchers.append(("field", field.strip(), modifier.strip().lower() or "exact",
                                     [str(v) for v in value]))
            if matchers:
                groups[name] = matchers
    return groups


def valid_regex(spark: SparkSession, pattern: str) -> bool:
    """Both Python and the JVM must accept it; a bad regex matches nothing."""
    try:
        re.compile(pattern)
        spark.sparkContext._jvm.java.util.regex.Pattern.compile("(?idU)" + pattern)
        return True
    except Exception:  # the JVM's own error class is not importable here
        return False


def keyword_text(message: Column, raw: Column) -> Column:
    """One lower-case text to search keywords in: the raw line, with the message put before
    it where the line does not spell it out."""
    return F.lower(F.when(F.contains(raw, message), raw).otherwise(
        F.concat(message, F.lit(TEXT_MARK), raw)))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _either(tests: list[str]) -> Column:
    """One expression for all literals of a matcher: large rule sets are built quickly."""
    return F.expr(" or ".join(f"coalesce({t}, false)" for t in tests)) if tests else F.lit(False)


def keyword_matches(text: str, keywords: list[str]) -> Column:
    """Any keyword in the column made by ``keyword_text``: in the message, else the raw line."""
    words = dict.fromkeys(k.lower() for k in keywords)
    return _either([f"contains({text}, {_quoted(w)})" for w in words])


def regex_test(lower: str, text: str, pattern: str) -> str:
    """The pattern anywhere in the text, whatever the case; it runs only where the longest word that
    a match must hold stands (and on texts beyond ASCII, whose letters may match others)."""
    test = f"{text} rlike {_quoted('(?idU)' + pattern)}"
    word = required_word(pattern)
    if not word:
        return test
    return f"((contains({lower}, {_quoted(word)}) or octet_length({text}) <> length({text})) and {test})"


def field_matches(lower: str, text: str, modifier: str, values: list[str],
                  spark: SparkSession) -> Column:
    """Any value matches the field per modifier; a missing field never matches.

    ``lower`` and ``text`` name columns with the field's text, lower-case and as it is.
    """
    wanted = [_quoted(v) for v in dict.fromkeys(v.lower() for v in values)]
    if modifier in ("startswith", "endswith"):
        return _either([f"{modifier}({lower}, {v})" for v in wanted])
    if modifier == "re":
        return _either([regex_test(lower, text, v) for v in values if valid_regex(spark, v)])
    if modifier == "exact":
        return _either([f"{lower} = {v}" for v in wanted])
    return _either([f"contains({lower}, {v})" for v in wanted])  # and any modifier not known


# -- rule sets -------------------------------------------------------------------------------

def check_rules(rules: list[dict]) -> tuple[list[dict], list[str]]:
    """(usable rules, what is wrong with the others); a repeated id is refused."""
    usable, errors, seen = [], [], set()
    for rule in rules:
        key = rule.get("id") or rule["title"]
        try:
            condition = str(rule["detection"].get("condition", "")).strip()
            if not condition:
                raise RuleError("empty condition")
            condition_tree(condition, list(detection_groups(rule["detection"])))
            if key in seen:
                raise RuleError("repeated rule id")
            seen.add(key)
            usable.append(rule)
        except RuleError as error:
            errors.append(f"{key}: {error}")
    return usable, errors


def match_rules(events: DataFrame, rules: list[dict], literals_in_plan: int = LITERALS_IN_PLAN) -> DataFrame:
    """Adds ``fired``: array of (rule number, fired groups), in rule order.

    Sets of up to ``literals_in_plan`` literals are one expression of the plan; larger ones are
    matched by a dictionary of their literals, with the same result.
    """
    rules, _ = check_rules(rules)
    spark = events.sparkSession
    grouped = [detection_groups(r["detection"]) for r in rules]
    paths = sorted({m[1] for g in grouped for ms in g.values() for m in ms if m[0] == "field"})
    texts = {p: f"_text_{i}" for i, p in enumerate(paths)}
    lowers = {p: f"_lower_{i}" for i, p in enumerate(paths)}
    staged = events.select(
        "*",
        keyword_text(F.coalesce("message", F.lit("")), F.coalesce("raw", F.lit("")))
        .alias("_keyword_text"),
        *[get_field(events, p).alias(texts[p]) for p in paths],
    )
    staged = staged.select("*", *[F.lower(F.col(texts[p])).alias(lowers[p]) for p in paths])

    hidden = ["_keyword_text", *texts.values(), *lowers.values()]
    if sum(len(m[3]) for g in grouped for ms in g.values() for m in ms) > literals_in_plan:
        fired = _dictionary_matches(rules, grouped, texts, lowers, spark)
        return hold(staged.withColumn("fired", fired).drop(*hidden), events.columns)

    def matcher(kind, field, modifier, values):
        if kind == "keyword":
            return keyword_matches("_keyword_text", values)
        return field_matches(lowers[field], texts[field], modifier, values, spark)

    fired = []
    for number, (rule, groups) in enumerate(zip(rules, grouped)):
        truth = {name: all_of([matcher(*m) for m in ms]) for name, ms in groups.items()}
        tree, names = condition_tree(str(rule["detection"]["condition"]).strip(), list(groups))

        def leaf(mark, truth=truth, names=names):
            kind, chosen = names[mark]
            tests = [truth.get(g, F.lit(False)) for g in chosen]
            if not tests:
                return F.lit(False)
            return all_of(tests) if kind == "all" else any_of(tests)

        seen = {}
        for mark, reach in _reached(tree, leaf, F.lit(True)):
            for g in names[mark][1]:
                if g in truth:
                    seen.setdefault(g, []).append(reach & leaf(mark) & truth[g])
        groups_fired = F.array_compact(F.array(*[
            F.when(any_of(tests), F.lit(g)) for g, tests in sorted(seen.items())
        ])) if seen else F.array().cast("array<string>")
        fired.append(F.when(_truth(tree, leaf), F.struct(
            F.lit(number).alias("rule"), groups_fired.alias("groups"))))
    if not fired:
        return events.withColumn("fired", F.array().cast(
            "array<struct<rule:int,groups:array<string>>>"))
    matched = staged.withColumn("fired", F.array_compact(F.array(*fired))).drop(*hidden)
    return hold(matched, events.columns)


class _Groups(dict):
    """Detection groups that can be told apart by their text, as a part of a rule set's key."""

    def __hash__(self):
        return hash(repr(sorted(self.items())))


def _dictionary_matches(rules, grouped, texts: dict, lowers: dict, spark: SparkSession) -> Column:
    """``fired`` by a dictionary of literals, in batches of events."""
    patterns = dict.fromkeys(
        (m[1], v) for g in grouped for ms in g.values() for m in ms if m[0] == "field" and m[2] == "re" for v in m[3])
    patterns = tuple(p for p in patterns if valid_regex(spark, p[1]))
    tests = [F.expr(f"coalesce({regex_test(lowers[f], texts[f], v)}, false)") for f, v in patterns]
    names = (None, *texts)
    spec = (tuple(_Groups(g) for g in grouped), tuple(str(r["detection"]["condition"]).strip() for r in rules), names, patterns)

    @F.arrow_udf("array<struct<rule:int,groups:array<string>>>")
    def fired(rows: pa.Array) -> pa.Array:
        *columns, bits = (rows.field(k) for k in range(len(names) + 1))
        found = np.array(bits.flatten().to_numpy(zero_copy_only=False), bool).reshape(len(rows), len(patterns))
        kind = pa.list_(pa.struct([("rule", pa.int32()), ("groups", pa.list_(pa.string()))]))
        return pa.array(dictionary(*spec).fired(columns, found), kind)

    return fired(F.struct(F.col("_keyword_text"), *[F.col(lowers[f]) for f in texts],
                          F.array(*tests).cast("array<boolean>").alias("patterns")))


def rule_attributes(rules: list[dict]) -> Column:
    """The rules' attributes as one literal array, indexed by rule number."""
    return F.array(*[
        F.struct(
            F.lit(r.get("id") or r["title"]).alias("rule_id"), F.lit(r["title"]).alias("title"),
            F.lit(r["level"]).alias("level"), F.lit(r.get("description", "")).alias("description"),
            F.array(*[F.lit(t) for t in r["tags"]]).cast("array<string>").alias("tags"),
        ) for r in rules
    ])


def apply_rules(events: DataFrame, rules: list[dict], keep=("event_id",)) -> DataFrame:
    """One row per event and fired rule: kept columns, rule attributes, fired groups."""
    rules, _ = check_rules(rules)
    attributes = rule_attributes(rules)
    return (
        match_rules(events, rules)
        .where(F.size("fired") > 0)
        .select(*keep, F.explode("fired").alias("_f"))
        .select(*keep, F.get(attributes, F.col("_f.rule")).alias("_r"),
                F.col("_f.rule").alias("rule_number"), F.col("_f.groups").alias("matched_groups"))
        .select(*keep, "rule_number", F.col("_r.rule_id").alias("rule_id"),
                F.col("_r.title").alias("title"), F.col("_r.level").alias("level"),
                F.col("_r.description").alias("description"), F.col("_r.tags").alias("rule_tags"),
                "matched_groups")
    )


def rule_tag(title: Column) -> Column:
    return F.concat(F.lit("sigma:"), F.substring(F.replace(F.lower(title), F.lit(" "), F.lit("_")),
                                                 1, 40))


def enrich_with_matches(events: DataFrame, rules: list[dict]) -> DataFrame:
    """Titles of the fired rules in ``sigma_matches``, their tags in ``tags``; keeps ``fired``."""
    rules, _ = check_rules(rules)
    attributes = rule_attributes(rules)
    rows = match_rules(events, rules)
    if not rules:
        return rows
    hits = F.transform("fired", lambda f: F.get(attributes, f["rule"]))
    return rows.withColumn("_hits", hits).select(
        *[c for c in rows.columns if c not in ("tags", "sigma_matches")],
        F.array_union("tags", F.flatten(F.transform("_hits", lambda h: F.array(
            rule_tag(h["title"]), F.concat(F.lit("level:"), h["level"]))))).alias("tags"),
        F.concat("sigma_matches", F.transform("_hits", lambda h: h["title"]))
        .alias("sigma_matches"),
    )
