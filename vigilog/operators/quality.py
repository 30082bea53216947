"""What a rule table covers, how good its rules are, and what is wrong with them.

Rules are ``rules`` (rule_id, title, level, tags, condition, ...) and ``matchers``, one row per
literal (see ``vigilog.sources.rules``), so all of this is joins and grouped counts.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vigilog.functions.severity import level_rank
from vigilog.functions.text import non_empty
from vigilog.operators.rules import condition_parses
from vigilog.session import with_position

OVERLAP = 0.3
PIECE = 4000  # sets of a word that meet another piece of its sets in one group
HELD = 20_000  # rows of groups that are paired at a time
PAIRS = 200_000  # pairs that are judged at a time
WORDS = 2_000_000  # of the smaller sets of pairs that are counted at a time
BITS = 256  # of a set, for its words


def technique_of(tag: Column) -> Column:
    """Tag to technique id: upper case, without ``ATTACK.``."""
    return F.regexp_replace(F.upper(F.trim(tag)), r"^ATTACK\.", "")


# -- coverage --------------------------------------------------------------------------------

def rule_techniques(rules: DataFrame, techniques: DataFrame) -> DataFrame:
    """(rule_id, title, technique_id, name, tactic) of the known techniques in the tags."""
    tags = rules.select("rule_id", "title", F.explode("tags").alias("_tag")).select(
        "rule_id", "title", technique_of(F.col("_tag")).alias("technique_id")).distinct()
    return tags.join(techniques.select("technique_id", "name", "tactic"), "technique_id")


def unknown_technique_tags(rules: DataFrame, techniques: DataFrame) -> DataFrame:
    """(rule_id, tag) of ``attack.`` tags with a digit that name no known technique."""
    tags = rules.select("rule_id", F.explode("tags").alias("tag")).where(
        F.startswith(F.lower("tag"), F.lit("attack.")) & F.col("tag").rlike(r"\d"))
    return tags.withColumn("technique_id", technique_of(F.col("tag"))).join(
        techniques.select("technique_id"), "technique_id", "left_anti").select("rule_id", "tag")


def coverage_pairs(rules: DataFrame, chains: DataFrame, techniques: DataFrame) -> DataFrame:
    """(technique_id, name, tactic, kind, title): what covers each technique."""
    by_rule = rule_techniques(rules, techniques).select(
        "technique_id", "name", "tactic", F.lit("rule").alias("kind"), "title")
    by_chain = chains.select("title", F.explode("techniques").alias("_t")).select(
        "title", technique_of(F.col("_t")).alias("technique_id")).join(
        techniques.select("technique_id", "name", "tactic"), "technique_id").select(
        "technique_id", "name", "tactic", F.lit("chain").alias("kind"), "title")
    return by_rule.unionByName(by_chain)


def coverage_by_technique(rules: DataFrame, chains: DataFrame, techniques: DataFrame
                          ) -> DataFrame:
    return coverage_pairs(rules, chains, techniques).groupBy(
        "technique_id", "name", "tactic").agg(
        F.count_if(F.col("kind") == "rule").alias("rules"),
        F.count_if(F.col("kind") == "chain").alias("chains"))


def uncovered_techniques(rules: DataFrame, chains: DataFrame, techniques: DataFrame) -> DataFrame:
    covered = coverage_pairs(rules, chains, techniques).select("technique_id").distinct()
    return techniques.join(covered, "technique_id", "left_anti")


def coverage_by_tactic(rules: DataFrame, chains: DataFrame, techniques: DataFrame) -> DataFrame:
    """Techniques covered per tactic, and their share of all known ones."""
    known = techniques.agg(F.count(F.lit(1))).scalar()
    return coverage_by_technique(rules, chains, techniques).groupBy("tactic").agg(
        F.count(F.lit(1)).alias("techniques")).select(
        "tactic", "techniques",
        F.round(F.col("techniques") * 100 / known, 1).alias("percent_of_known"))


# -- quality ---------------------------------------------------------------------------------

def _parses(condition: Column) -> Column:
    @F.pandas_udf("boolean")
    def parses(conditions: pd.Series) -> pd.Series:
        return conditions.map(lambda c: c is not None and condition_parses(c))

    return parses(condition)


def condition_words(condition: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(condition, "[()]", " "), r"\s+"), lambda w: w != "")


def rule_complexity(rules: DataFrame, matchers: DataFrame) -> DataFrame:
    """Nodes of the condition (groups, selectors and operators) plus fields with a modifier."""
    words = condition_words(F.col("condition"))
    # "1 of x" is three words and one node
    nodes = F.size(words) - 2 * F.size(F.filter(words, lambda w: F.lower(w) == "of"))
    fields = matchers.where("kind = 'field' and modifier is not null").select(
        "rule_id", "group", "field", "modifier").distinct().groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("_fields"))
    return rules.join(fields, "rule_id", "left").select(
        "rule_id", F.when(_parses(F.col("condition")), nodes + F.coalesce("_fields", F.lit(0)))
        .otherwise(0).cast("bigint").alias("complexity"))


def rule_specificity(rules: DataFrame, matchers: DataFrame) -> DataFrame:
    """0 to 100: 50, up to 20 for matching fields, up to -30 for short words, 10 for a NOT."""
    counts = matchers.where("value is not null or field is not null").groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(F.col("kind") == "field").alias("_fields"),
        F.count_if(F.col("is_text") & (F.length("value") < 5)).alias("_short"))
    bonus = F.when(F.contains(F.concat(F.lit(" "), "condition", F.lit(" ")), F.lit(" not ")), 10.0
                   ).otherwise(0.0)
    value = 50.0 + F.col("_fields") / F.col("_all") * 20 - F.col("_short") / F.col("_all") * 30
    return rules.join(counts, "rule_id", "left").select("rule_id", F.coalesce(
        F.greatest(F.least(value + bonus, F.lit(100.0)), F.lit(0.0)), F.lit(50.0))
        .alias("specificity"))


def fp_risk(rows: DataFrame) -> DataFrame:
    """Adds ``fp_risk`` and its reasons to rows with specificity and the rule columns."""
    specificity = F.col("specificity")
    vague = specificity < 40
    undocumented = F.size("falsepositives") == 0
    broad = F.contains(F.lower("condition"), F.lit(" or ")) & (specificity < 50)
    points = (
        F.when(vague, 2).otherwise(0) + F.when(undocumented, 1).otherwise(0)
        + F.when(broad, 1).otherwise(0)
        - F.when(F.col("level").isin("low", "informational"), 1).otherwise(0))
    reasons = F.array_compact(F.array(
        F.when(vague, "low specificity"), F.when(undocumented, "no documented false positives"),
        F.when(broad, "broad OR condition")))
    risk = F.when(points >= 3, "high").when(points >= 1, "medium").otherwise("low")
    return rows.select("*", risk.alias("fp_risk"), F.when(
        (points < 1) & (F.size(reasons) == 0), F.array(F.lit("well specified and documented"))
    ).otherwise(reasons).alias("fp_risk_reasons"))


def keyword_sets(matchers: DataFrame) -> DataFrame:
    """(rule_id, tokens, set_id): each rule's distinct lower-case literals."""
    sets = matchers.where("is_text").groupBy("rule_id").agg(
        F.array_sort(F.collect_set(F.lower("value"))).alias("tokens"))
    return sets.withColumn("set_id", F.sha2(F.to_json("tokens"), 256))


def overlapping_sets(sets: DataFrame, threshold: float = OVERLAP, keep: tuple = ()) -> DataFrame:
    """(set_a, set_b, jaccard) of distinct keyword sets more alike than the threshold, and the
    columns ``keep`` of either set, as x_a and x_b.

    Equal sets are collapsed before, so copies of a rule cost nothing. Two sets above the
    threshold must share one of their rarest words (the prefix), so only those meet. A row
    carries its words, as numbers from the rarest on, and a pair is made at the rarest word it
    shares, so candidates are judged where they meet and never written. The sets of a frequent
    word are cut into pieces, and each two of them meet in a group of their own.
    """
    spark = sets.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    distinct = sets.select("set_id", "tokens", *keep).dropDuplicates(["set_id"])
    words = distinct.where("set_id is not null").select("set_id", F.explode("tokens").alias("word"), *keep)
    often = words.where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("_often"))
    numbered = with_position(often.orderBy("_often", "word"), "_number")
    ranked = words.join(numbered, "word").groupBy("set_id", *keep).agg(
        F.array_sort(F.collect_list(F.struct("_number", "_often"))).alias("_rare"))
    n = F.size("_rare")
    prefix = F.slice("_rare", 1, (n - F.floor(n * threshold)).cast("int"))
    pieces = F.ceil(F.col("_p._often") / PIECE)
    met = ranked.select("set_id", *keep, F.col("_rare._number").alias("_words"), F.posexplode(prefix).alias("_at", "_p")).select(
        "set_id", *keep, "_words", "_at", F.col("_p._number").alias("_word"), F.pmod(F.xxhash64("set_id"), pieces).alias("_piece"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)).alias("_other"))
    group = ["_word", F.least("_piece", "_other").alias("_low"), F.greatest("_piece", "_other").alias("_high")]
    rows = met.select("set_id", *keep, "_words", "_at", "_piece", *group).repartition(
        tasks, "_word", "_low", "_high").sortWithinPartitions("_word", "_low", "_high", "_piece")
    kinds = {f.name: f.dataType for f in distinct.schema}
    schema = StructType([StructField("set_a", kinds["set_id"]), StructField("set_b", kinds["set_id"]), StructField(
        "jaccard", DoubleType()), *[StructField(f"{c}_{x}", kinds[c]) for c in keep for x in "ab"]])

    def alike(batches):
        for part in _whole_groups(batches):
            yield from _alike(part, threshold, keep)

    return rows.mapInArrow(alike, schema)


def _whole_groups(batches):
    """Tables of whole groups, of ``HELD`` rows or a little more, or of one larger group."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= HELD:
            table = pa.Table.from_batches(held)
            starts = _group_starts(table)
            if len(starts) > 1:
                yield table.slice(0, starts[-1])
                held = table.slice(starts[-1]).to_batches()
                rows = table.num_rows - int(starts[-1])
    if rows:
        yield pa.Table.from_batches(held)


def _group_starts(table: pa.Table) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    new[1:] = np.logical_or.reduce([np.diff(table[c].to_numpy()) != 0 for c in ("_word", "_low", "_high")])
    return np.flatnonzero(new)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each start so many numbers from it on."""
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def _alike(table: pa.Table, threshold: float, keep: tuple):
    """The pairs of each group that are alike, at the rarest word that they share.

    Each row is paired with those before it in its group (of another piece, if there are two). A pair
    is left out where the words behind its place cannot be enough, then where the words' bits show
    too few in common; of the others the common words are counted.
    """
    table = table.combine_chunks()
    rows = table.num_rows
    starts = _group_starts(table)
    sizes = np.diff(np.append(starts, rows))
    start = np.repeat(starts, sizes)
    low, high, piece = (table[c].to_numpy() for c in ("_low", "_high", "_piece"))
    firsts = np.repeat(np.add.reduceat((piece == low).astype(np.int64), starts), sizes)
    before = np.where(low == high, np.arange(rows) - start, np.where(piece == low, 0, firsts))

    lists = table["_words"].chunk(0)
    n = np.asarray(lists.value_lengths(), np.int64)
    kinds, words = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    offsets = np.cumsum(n) - n
    owner = np.repeat(np.arange(rows), n)
    codes = owner * len(kinds) + words  # ascending: a set's words are
    bits = np.zeros((rows, BITS // 64), np.uint64)
    np.bitwise_or.at(bits, (owner, words % BITS // 64), np.uint64(1) << (words % 64).astype(np.uint64))
    hidden = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)  # words that share a bit with another one of the set
    at = table["_at"].to_numpy().astype(np.int64)
    left = n - at
    part = threshold / (1 + threshold) * n - 5e-10  # a pair has more words in common than both parts together
    order = np.empty(rows, np.int64)
    order[pc.sort_indices(table["set_id"]).to_numpy()] = np.arange(rows)

    ends = np.cumsum(before)
    row = 0
    while row < rows:
        done = ends[row] - before[row]
        last = max(row + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        counts = before[row:last]
        a, b = _ranges(start[row:last], counts), np.repeat(np.arange(row, last), counts)
        row = last
        able = np.minimum(left[a], left[b]) > part[a] + part[b]
        a, b = a[able], b[able]
        able = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64) + np.minimum(hidden[a], hidden[b]) > part[a] + part[b]
        a, b = a[able], b[able]
        a, b = np.where(n[a] <= n[b], a, b), np.where(n[a] <= n[b], b, a)
        cuts = np.flatnonzero(np.diff(np.cumsum(n[a]) // WORDS)) + 1
        for a, b in zip(np.split(a, cuts), np.split(b, cuts)):
            if not len(a):
                continue
            own = _ranges(offsets[a], n[a])
            wanted = np.repeat(b, n[a]) * len(kinds) + words[own]
            found = codes[np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)] == wanted
            first = np.cumsum(n[a]) - n[a]
            shared = np.add.reduceat(found.astype(np.int64), first)
            rarer = np.add.reduceat((found & (own < np.repeat(offsets[a] + at[a], n[a]))).astype(np.int64), first)
            jaccard = shared / (n[a] + n[b] - shared)
            good = (rarer == 0) & (jaccard > threshold)
            a, b, jaccard = a[good], b[good], jaccard[good]
            a, b = np.where(order[a] < order[b], a, b), np.where(order[a] < order[b], b, a)
            columns = {"set_a": table["set_id"].take(a), "set_b": table["set_id"].take(b), "jaccard": jaccard}
            columns |= {f"{c}_{x}": table[c].take(rows_) for c in keep for x, rows_ in (("a", a), ("b", b))}
            yield from pa.table(columns).to_batches()


def overlap_counts(matchers: DataFrame, threshold: float = OVERLAP) -> DataFrame:
    """(rule_id, overlaps): how many other rules each rule overlaps; no pair of copies is
    ever formed."""
    sets = keyword_sets(matchers)
    sizes = sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("members"), F.first("tokens").alias("tokens"))
    alike = overlapping_sets(sizes, threshold, ("members",))
    others = alike.select(F.explode(F.array(
        F.struct(F.col("set_a").alias("set_id"), F.col("members_b").alias("n")),
        F.struct(F.col("set_b").alias("set_id"), F.col("members_a").alias("n")))).alias("_l")).groupBy(
        F.col("_l.set_id").alias("set_id")).agg(F.sum("_l.n").alias("_others"))
    per_set = sizes.join(others, "set_id", "left").select(
        "set_id", (F.col("members") - 1 + F.coalesce("_others", F.lit(0))).alias("overlaps"))
    return sets.select("rule_id", "set_id").join(per_set, "set_id").select("rule_id", "overlaps")


def rule_quality(rules: DataFrame, matchers: DataFrame, threshold: float = OVERLAP) -> DataFrame:
    """Complexity, specificity, false-positive risk, overlaps and the composite score."""
    rows = (
        rules.select("rule_id", "title", "level", "condition", "falsepositives", "source_file")
        .join(rule_complexity(rules, matchers), "rule_id")
        .join(rule_specificity(rules, matchers), "rule_id")
        .join(overlap_counts(matchers, threshold), "rule_id", "left")
        .withColumn("overlaps", F.coalesce("overlaps", F.lit(0)))
    )
    risk_score = F.when(F.col("fp_risk") == "low", 100).when(
        F.col("fp_risk") == "medium", 60).otherwise(20)
    penalty = lambda c, by: F.greatest(F.lit(100) - F.col(c) * by, F.lit(0))
    total = (F.col("specificity") * 0.40 + risk_score * 0.30 + penalty("complexity", 5) * 0.15
             + penalty("overlaps", 25) * 0.15)
    score = F.greatest(F.least(F.bround(total), F.lit(100.0)), F.lit(0.0)).cast("bigint")
    return fp_risk(rows).select(
        "rule_id", "title", "level", "source_file", "complexity", "specificity", "fp_risk",
        "fp_risk_reasons", "overlaps", score.alias("maintenance_score"))


def quality_summary(quality: DataFrame) -> DataFrame:
    return quality.agg(
        F.round(F.avg("maintenance_score"), 1).alias("average_maintenance_score"),
        F.count_if(F.col("fp_risk") == "high").alias("high_fp_risk_count"))


def sort_quality(quality: DataFrame, by: str = "maintenance") -> DataFrame:
    keys = {
        "maintenance": ["maintenance_score"], "specificity": ["specificity"],
        "complexity": [F.desc("complexity")],
        "fp_risk": [F.when(F.col("fp_risk") == "high", 0).when(F.col("fp_risk") == "medium", 1)
                    .otherwise(2)]}
    return quality.orderBy(*keys[by], "rule_id")


def filter_rules(rules: DataFrame, level: str) -> DataFrame:
    return rules.where(F.lower("level") == level.lower())


def rule_summary(rules: DataFrame) -> DataFrame:
    """Rules for display, highest level first, with their first three tags."""
    return rules.orderBy(F.desc(level_rank("level")), "rule_id").select(
        "rule_id", "title", "level", "status",
        F.array_join(F.slice("tags", 1, 3), ", ").alias("tags"),
        F.substring_index("source_file", "/", -1).alias("file"))


# -- findings --------------------------------------------------------------------------------

def undefined_groups(rules: DataFrame, matchers: DataFrame) -> DataFrame:
    """(rule_id, word) of condition words that name no group of the rule.

    A group that ends up without matchers (an empty mapping) counts as not there.
    """
    word = F.explode(F.array_distinct(condition_words(F.col("condition"))))
    words = rules.select("rule_id", word.alias("word")).where(
        ~F.lower("word").isin("and", "or", "not", "1", "of", "all", "them")
        & ~F.contains("word", F.lit("*")))
    groups = matchers.where("not (kind = 'field' and field is null)").select(
        "rule_id", F.col("group").alias("word")).distinct()
    return words.join(groups, ["rule_id", "word"], "left_anti")


def rule_findings(rules: DataFrame, matchers: DataFrame, techniques: DataFrame,
                  fixtures: DataFrame | None = None) -> DataFrame:
    """(rule_id, severity, check, message): everything to say about each rule."""
    def finding(rows, severity, check, message):
        text = message if isinstance(message, Column) else F.lit(message)
        return rows.select("rule_id", F.lit(severity).alias("severity"),
                           F.lit(check).alias("check"), text.alias("message"))

    missing = lambda c: non_empty(F.col(c)).isNull()
    attack = F.filter("tags", lambda t: F.startswith(F.lower(t), F.lit("attack.")))
    known = rules.select("rule_id", F.explode(attack).alias("tag")).where(
        F.col("tag").rlike(r"\d")).withColumn("technique_id", technique_of(F.col("tag"))).join(
        techniques.select("technique_id", "name", "tactic"), "technique_id")
    groups = matchers.select("rule_id").distinct()
    repeated = rules.where(~missing("rule_id")).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = [
        finding(rules.where(missing("description") | (F.length("description") < 20)), "WARNING",
                "completeness", "description is missing or shorter than 20 characters"),
        finding(rules.where(missing("author")), "WARNING", "completeness", "author is missing"),
        finding(rules.where(F.size("tags") == 0), "WARNING", "completeness", "no tags"),
        finding(rules.where(F.size("falsepositives") == 0), "WARNING", "completeness",
                "falsepositives is missing"),
        finding(rules.where(missing("rule_id")), "WARNING", "completeness", "id is missing"),
        finding(rules.where(F.size(attack) == 0), "WARNING", "mitre", "no technique tags"),
        finding(unknown_technique_tags(rules, techniques), "WARNING", "mitre",
                F.concat(F.lit("unknown technique tag '"), "tag", F.lit("'"))),
        finding(known, "INFO", "mitre", F.concat(
            F.lit("mapped to "), "technique_id", F.lit(": "), "name", F.lit(" ["), "tactic",
            F.lit("]"))),
        finding(rules.where(~_parses(F.col("condition"))), "ERROR", "condition",
                "condition does not parse"),
        finding(undefined_groups(rules, matchers), "ERROR", "condition",
                F.concat(F.lit("condition references undefined group '"), "word", F.lit("'"))),
        finding(rules.join(groups, "rule_id", "left_anti"), "ERROR", "logic",
                "detection has no groups"),
        finding(matchers.where("value is null and field is null"), "ERROR", "logic",
                F.concat(F.lit("group '"), "group", F.lit("' is empty"))),
        finding(repeated, "ERROR", "logic", "rule id is used more than once"),
    ]
    if fixtures is not None:
        parts.append(finding(rules.join(fixtures.select("rule_id").distinct(), "rule_id",
                                        "left_anti"),
                             "WARNING", "test_fixture", "no labelled lines for this rule"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def rule_verdicts(rules: DataFrame, findings: DataFrame, strict: bool = False) -> DataFrame:
    """Errors and warnings per rule; it passes without errors (strict: without warnings too)."""
    counts = findings.groupBy("rule_id").agg(
        F.count_if(F.col("severity") == "ERROR").alias("errors"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    bad = zero("errors") + (zero("warnings") if strict else F.lit(0))
    return rules.select("rule_id", "title").join(counts, "rule_id", "left").select(
        "rule_id", "title", zero("errors").alias("errors"), zero("warnings").alias("warnings"),
        (bad == 0).alias("passed"))
