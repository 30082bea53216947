"""Rule tables made from parts: reading, coverage, quality, findings."""

from pyspark.sql import functions as F

from vigilog.operators import quality as Q
from vigilog.session import with_position
from vigilog.sources.catalog import chains_table, techniques_table
from vigilog.sources.rules import parse_rule_documents, rule_matchers, rules_changed
from vigilog.values import TECHNIQUES
from workload.base import query, stage, table

IDS = [t[0] for t in TECHNIQUES]
LEVELS = ["informational", "low", "medium", "high", "critical", "odd"]
CONDITIONS = ["sel", "sel and flt", "sel or flt", "sel and not flt", "1 of them", "all of f*",
              "sel and gone", "(sel or flt", "not (sel and flt) or sel"]

# every part is a rule document: its name's words are keywords, type and brand are fields
DOCUMENT = """concat(
  case when p_partkey % 97 = 0 then '' else concat('title: ', p_name, ' ', p_partkey, '\\n') end,
  case when p_partkey % 13 = 0 then '' else concat('id: r', p_partkey, '\\n') end,
  'level: ', element_at(array({levels}), cast(p_partkey % 6 + 1 as int)), '\\n',
  case when p_partkey % 11 = 0 then '' else 'author: someone\\n' end,
  'description: ', repeat('word ', cast(p_partkey % 7 as int)), 'end\\n',
  case when p_partkey % 5 = 0 then '' else 'falsepositives: [known]\\n' end,
  case when p_partkey % 9 = 0 then '' else concat('tags: [attack.execution, attack.',
    lower(element_at(array({ids}), cast(p_partkey % 28 + 1 as int))), ']\\n') end,
  'logsource: {{product: x}}\\ndetection:\\n  sel: [', concat_ws(', ', split(p_name, ' ')), ']\\n  flt:\\n',
  '    message|contains: [', p_type, ', "', p_size, '"]\\n    host: ', p_brand, '\\n  condition: ',
  element_at(array({conditions}), cast(p_partkey % 9 + 1 as int)), '\\n')"""


def _texts(values):
    return ", ".join("'" + v + "'" for v in values)


def documents(spark, sf):
    text = DOCUMENT.format(levels=_texts(LEVELS), ids=_texts([*IDS, "T9999", "T8888.001", "T7"]),
                           conditions=_texts(CONDITIONS))
    return table(spark, sf, "part").selectExpr(
        "concat('rules/p', p_partkey, '.yml') as path", f"{text} as value")


def rule_rows(spark, sf):
    return stage(spark, sf, "rules", lambda: parse_rule_documents(documents(spark, sf)))


def usable(spark, sf):
    """Rules that load; those without an id are named by their file."""
    rows = rule_rows(spark, sf).where("error is null")
    return rows.withColumn("rule_id", F.when(F.col("rule_id") == "", F.col("source_file"))
                           .otherwise(F.col("rule_id")))


def matchers(spark, sf):
    return stage(spark, sf, "matchers", lambda: rule_matchers(usable(spark, sf)))


def _list(values):
    return "[" + _texts(values) + "]"


RULES_SQL = f"""WITH known AS (SELECT * FROM (VALUES {', '.join(f"('{i}', '{n}', '{t}')" for i, n, t, _ in TECHNIQUES)})
  k(technique_id, name, tactic)),
cover_chains AS (SELECT * FROM (VALUES ('chain-001', 'T1110.001'), ('chain-001', 'T1078'), ('chain-002', 'T1046'),
  ('chain-002', 'T1110'), ('chain-003', 'T1078'), ('chain-003', 'T1548.003'), ('chain-004', 'T1046'),
  ('chain-004', 'T1190'), ('chain-005', 'T1046'), ('chain-005', 'T1110'), ('chain-005', 'T1078'),
  ('chain-005', 'T1548'), ('chain-006', 'T1110')) c(chain_id, technique_id)),
rules AS (SELECT p_partkey AS k, p_name || ' ' || p_partkey AS title,
  CASE WHEN p_partkey % 13 = 0 THEN 'rules/p' || p_partkey || '.yml' ELSE 'r' || p_partkey END AS rule_id,
  'p' || p_partkey || '.yml' AS file,
  CASE WHEN p_partkey % 6 = 5 THEN 'medium' ELSE {_list(LEVELS)}[p_partkey % 6 + 1] END AS level,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'someone' END AS author, (p_partkey % 7) * 5 + 3 AS len,
  p_partkey % 5 = 0 AS undocumented, {_list(CONDITIONS)}[p_partkey % 9 + 1] AS condition,
  CASE WHEN p_partkey % 9 <> 0 THEN {_list([*IDS, 'T9999', 'T8888.001', 'T7'])}[p_partkey % 28 + 1] END AS tech,
  string_split(p_name, ' ') AS words, [p_type, CAST(p_size AS VARCHAR), p_brand] AS fields
  FROM part WHERE p_partkey % 97 <> 0),
lits AS (SELECT rule_id, unnest(list_distinct(list_transform(list_concat(words, fields), lambda w: lower(w)))) AS w
  FROM rules),
sizes AS (SELECT rule_id, count(*) AS n FROM lits GROUP BY rule_id),
sigs AS (SELECT rule_id, string_agg(w, '|' ORDER BY w) AS sig, count(*) AS n FROM lits GROUP BY rule_id),
groups_ AS (SELECT sig, any_value(n) AS n, count(*) AS members FROM sigs GROUP BY sig),
gw AS (SELECT sig, unnest(string_split(sig, '|')) AS w FROM groups_),
both_ AS (SELECT a.sig AS sa, b.sig AS sb, count(*) AS c FROM gw a JOIN gw b USING (w) WHERE a.sig <> b.sig GROUP BY ALL),
alike AS (SELECT sa, sb, c / (ga.n + gb.n - c) AS jaccard FROM both_ JOIN groups_ ga ON ga.sig = sa
  JOIN groups_ gb ON gb.sig = sb WHERE c / (ga.n + gb.n - c) > 0.3),
overs AS (SELECT s.rule_id, g.members - 1 + coalesce(o.n, 0) AS "overlaps" FROM sigs s JOIN groups_ g USING (sig)
  LEFT JOIN (SELECT sa AS sig, CAST(sum(gb.members) AS BIGINT) AS n FROM alike JOIN groups_ gb ON gb.sig = sb GROUP BY sa) o USING (sig)),
spec AS (SELECT *, CASE WHEN k % 9 = 7 THEN 0 ELSE
    CASE k % 9 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 3
      WHEN 8 THEN 6 END + 1 END AS complexity,
  greatest(least(50 + 3 / (len(words) + 3) * 20 - len(list_filter(list_concat(words, fields), lambda w: length(w) < 5))
    / (len(words) + 3) * 30 + CASE WHEN contains(' ' || condition || ' ', ' not ') THEN 10 ELSE 0 END, 100), 0) AS specificity
  FROM rules),
points AS (SELECT *, CASE WHEN specificity < 40 THEN 2 ELSE 0 END + CASE WHEN undocumented THEN 1 ELSE 0 END
  + CASE WHEN contains(condition, ' or ') AND specificity < 50 THEN 1 ELSE 0 END
  - CASE WHEN level IN ('low', 'informational') THEN 1 ELSE 0 END AS points FROM spec),
graded AS (SELECT *, CASE WHEN points >= 3 THEN 'high' WHEN points >= 1 THEN 'medium' ELSE 'low' END AS fp_risk FROM points),
quality AS (SELECT graded.*, "overlaps", CAST(round_even(specificity * 0.40 + (CASE fp_risk WHEN 'low' THEN 100
  WHEN 'medium' THEN 60 ELSE 20 END) * 0.30 + greatest(100 - complexity * 5, 0) * 0.15
  + greatest(100 - "overlaps" * 25, 0) * 0.15, 0) AS BIGINT) AS maintenance_score FROM graded JOIN overs USING (rule_id)),
pairs_ AS (SELECT technique_id, name, tactic, 'rule' AS kind, title FROM rules JOIN known ON technique_id = tech
  UNION ALL SELECT technique_id, name, tactic, 'chain', chain_id FROM cover_chains JOIN known USING (technique_id))
"""


def sql(body: str) -> str:
    return RULES_SQL + body


@query("s7_read_rules", """SELECT 'rules/p' || p_partkey || '.yml' AS path, p_partkey % 97 <> 0 AS loaded,
  CASE WHEN p_partkey % 97 <> 0 THEN CASE WHEN p_partkey % 6 = 5 THEN 'medium' ELSE
  ['informational','low','medium','high','critical'][p_partkey % 6 + 1] END END AS level FROM part""")
def read(spark, sf):
    return rule_rows(spark, sf).select(
        F.col("source_file").alias("path"), F.col("error").isNull().alias("loaded"), "level")


@query("s8_rules_changed", """SELECT 'p' || p_partkey AS path, CASE WHEN p_partkey % 10 = 0 THEN 'added'
  WHEN p_partkey % 10 = 1 THEN 'deleted' ELSE 'modified' END AS change FROM part WHERE p_partkey % 10 <= 2""")
def changed(spark, sf):
    p = table(spark, sf, "part").withColumn("path", F.concat(F.lit("p"), "p_partkey"))
    old = p.where("p_partkey % 10 <> 0").select("path", F.col("p_size").alias("modified"))
    new = p.where("p_partkey % 10 <> 1").select("path", F.expr(
        "case when p_partkey % 10 = 2 then p_size + 1 else p_size end").alias("modified"))
    return rules_changed(old, new)


@query("j1_rule_techniques", sql("SELECT rule_id, technique_id, name, tactic FROM rules JOIN known ON technique_id = tech"))
def techniques(spark, sf):
    return Q.rule_techniques(usable(spark, sf), techniques_table(spark)).drop("title")


@query("j2_unknown_techniques", sql("""SELECT rule_id, 'attack.' || lower(tech) AS tag FROM rules
  WHERE tech IN ('T9999', 'T8888.001', 'T7')"""))
def unknown(spark, sf):
    return Q.unknown_technique_tags(usable(spark, sf), techniques_table(spark))


@query("j3_uncovered_techniques", sql("""SELECT technique_id FROM known WHERE technique_id NOT IN (
  SELECT technique_id FROM cover_chains) AND technique_id NOT IN (
  SELECT tech FROM rules WHERE level = 'critical' AND tech IS NOT NULL)"""))
def uncovered(spark, sf):
    """Techniques for which there is neither a chain nor a critical rule."""
    return Q.uncovered_techniques(Q.filter_rules(usable(spark, sf), "critical"), chains_table(spark),
                                  techniques_table(spark)).select("technique_id")


@query("u4_known_but_uncovered", sql("""SELECT tactic, count(*) AS known, count(*) FILTER (technique_id NOT IN (
    SELECT tech FROM rules WHERE tech IS NOT NULL) AND technique_id NOT IN (SELECT technique_id FROM cover_chains)) AS uncovered
  FROM known GROUP BY tactic"""))
def uncovered_by_tactic(spark, sf):
    known = techniques_table(spark)
    open_ = Q.uncovered_techniques(usable(spark, sf), chains_table(spark), known).select(
        "technique_id", F.lit(True).alias("open"))
    return known.join(open_, "technique_id", "left").groupBy("tactic").agg(
        F.count(F.lit(1)).alias("known"), F.count("open").alias("uncovered"))


@query("a6_coverage_by_technique", sql("""SELECT technique_id, tactic, count(*) FILTER (WHERE kind = 'rule') AS rules,
  count(*) FILTER (WHERE kind = 'chain') AS chains FROM pairs_ GROUP BY ALL"""))
def coverage(spark, sf):
    return Q.coverage_by_technique(usable(spark, sf), chains_table(spark), techniques_table(spark)
                                   ).select("technique_id", "tactic", "rules", "chains")


@query("a7_coverage_by_tactic", sql("""SELECT tactic, count(DISTINCT technique_id) AS techniques,
  round(count(DISTINCT technique_id) * 100 / 25, 1) AS percent_of_known FROM pairs_ GROUP BY tactic"""))
def by_tactic(spark, sf):
    return Q.coverage_by_tactic(usable(spark, sf), chains_table(spark), techniques_table(spark))


@query("a8_rule_summary", sql("""SELECT rule_id, level, file, CASE WHEN tech IS NULL THEN '' ELSE
  'attack.execution, attack.' || lower(tech) END AS tags FROM rules"""))
def summary(spark, sf):
    return Q.rule_summary(usable(spark, sf)).select("rule_id", "level", "file", "tags")


@query("f15_filter_rules", sql("SELECT rule_id FROM rules WHERE level = 'high'"))
def high(spark, sf):
    return Q.filter_rules(usable(spark, sf), "HIGH").select("rule_id")


@query("a9_rule_complexity", sql("SELECT rule_id, complexity FROM spec"))
def complexity(spark, sf):
    return Q.rule_complexity(usable(spark, sf), matchers(spark, sf))


@query("a10_rule_specificity", sql("SELECT rule_id, round(specificity, 4) AS specificity FROM spec"))
def specificity(spark, sf):
    return Q.rule_specificity(usable(spark, sf), matchers(spark, sf)).withColumn(
        "specificity", F.round("specificity", 4))


def quality(spark, sf):
    return stage(spark, sf, "quality", lambda: Q.rule_quality(usable(spark, sf), matchers(spark, sf)))


@query("a11_fp_risk", sql("SELECT rule_id, fp_risk FROM graded"))
def risk(spark, sf):
    return quality(spark, sf).select("rule_id", "fp_risk")


@query("a12_maintenance_score", sql('SELECT rule_id, "overlaps", maintenance_score FROM quality'))
def maintenance(spark, sf):
    return quality(spark, sf).select("rule_id", "overlaps", "maintenance_score")


@query("a13_quality_summary", sql("""SELECT round(avg(maintenance_score), 1) AS average_maintenance_score,
  count(*) FILTER (WHERE fp_risk = 'high') AS high_fp_risk_count FROM quality"""))
def quality_summary(spark, sf):
    return Q.quality_summary(quality(spark, sf))


@query("t4_rules_by_quality", sql("""SELECT rule_id, maintenance_score, row_number() OVER (ORDER BY maintenance_score, rule_id) AS position FROM quality"""))
def sorted_quality(spark, sf):
    return with_position(Q.sort_quality(quality(spark, sf)).select("rule_id", "maintenance_score"))


@query("j8_overlapping_sets", sql("""SELECT least(sa, sb) AS set_a, greatest(sa, sb) AS set_b,
  round(jaccard, 6) AS jaccard FROM alike WHERE sa < sb"""))
def overlap(spark, sf):
    sets = Q.keyword_sets(matchers(spark, sf)).withColumn("t", F.array_join("tokens", "|"))
    return Q.overlapping_sets(sets, keep=("t",)).select(
        F.least("t_a", "t_b").alias("set_a"), F.greatest("t_a", "t_b").alias("set_b"), F.round("jaccard", 6).alias("jaccard"))


@query("j8_rule_overlap_counts", sql('SELECT rule_id, "overlaps" FROM overs'))
def overlap_counts(spark, sf):
    return Q.overlap_counts(matchers(spark, sf))


@query("u3_set_sizes", """SELECT c.conv_id, len(list_intersect(a, b)) AS common, len(list_distinct(list_concat(a, b))) AS either
  FROM (SELECT conv_id, list(DISTINCT role) AS a, list(DISTINCT CASE WHEN turn % 2 = 0 THEN 'user' ELSE role END) AS b
  FROM conversations GROUP BY conv_id) c""")
def set_sizes(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.collect_set("role").alias("a"), F.collect_set(
            F.when(F.col("turn") % 2 == 0, "user").otherwise(F.col("role"))).alias("b"))
    return rows.select("conv_id", F.size(F.array_intersect("a", "b")).cast("bigint").alias("common"),
                       F.size(F.array_union("a", "b")).cast("bigint").alias("either"))


@query("j11_undefined_groups", sql("SELECT rule_id, 'gone' AS word FROM rules WHERE k % 9 = 6"))
def undefined(spark, sf):
    return Q.undefined_groups(usable(spark, sf), matchers(spark, sf))


@query("a15_rule_findings", sql("""SELECT severity, check_ AS "check", count(*) AS n FROM (
  SELECT 'WARNING' AS severity, 'completeness' AS check_ FROM rules WHERE len < 20
  UNION ALL SELECT 'WARNING', 'completeness' FROM rules WHERE author = ''
  UNION ALL SELECT 'WARNING', 'completeness' FROM rules WHERE tech IS NULL
  UNION ALL SELECT 'WARNING', 'completeness' FROM rules WHERE undocumented
  UNION ALL SELECT 'WARNING', 'mitre' FROM rules WHERE tech IS NULL OR tech IN ('T9999', 'T8888.001', 'T7')
  UNION ALL SELECT 'INFO', 'mitre' FROM rules JOIN known ON technique_id = tech
  UNION ALL SELECT 'ERROR', 'condition' FROM rules WHERE k % 9 IN (6, 7)) GROUP BY ALL"""))
def findings(spark, sf):
    return Q.rule_findings(usable(spark, sf), matchers(spark, sf), techniques_table(spark)).groupBy(
        "severity", "check").agg(F.count(F.lit(1)).alias("n"))


@query("a15_rule_verdicts", sql("""SELECT rule_id, k % 9 NOT IN (6, 7) AS passed FROM rules"""))
def verdicts(spark, sf):
    found = Q.rule_findings(usable(spark, sf), matchers(spark, sf), techniques_table(spark))
    return Q.rule_verdicts(usable(spark, sf), found).select("rule_id", "passed")
