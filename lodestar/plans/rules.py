"""SQL rules: named, parameterised SELECTs over the index views, run with bound parameters.

A rule's SQL is the same in Spark and DuckDB.  ``run`` binds missing parameters as null, keeps a failing
rule from stopping the others, and renders each row's message from its columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codeindex import WITH, views
from .registry import query

_QUOTED = re.compile(r"'(?:[^']|'')*'|--[^\n]*|/\*[\s\S]*?\*/")
_NAME = re.compile(r"(?<!:):([A-Za-z_]\w*)")


@dataclass(frozen=True)
class Rule:
    """id, severity (None: disabled), SELECT and message with {column} places; parameters have defaults."""

    id: str
    sql: str
    message: str = ""
    severity: str | None = "warning"
    parameters: dict = field(default_factory=dict)


def parameter_names(sql: str) -> set[str]:
    """The :names of a statement outside of strings and comments."""
    return set(_NAME.findall(_QUOTED.sub(" ", sql)))


def run(spark: SparkSession, rule: Rule, **given) -> DataFrame:
    """The rule's rows with its parameters bound, by default to the rule's own, else to null; and their message."""
    args = {n: given.get(n, rule.parameters.get(n)) for n in parameter_names(rule.sql)}
    rows = spark.sql(rule.sql, args=args)
    if not rule.message:
        return rows
    parts = re.split(r"\{(\w+)\}", rule.message)
    pieces = [F.coalesce(F.col(x).cast("string"), F.lit("")) if i % 2 and x in rows.columns else F.lit("{" + x + "}" if i % 2 else x) for i, x in enumerate(parts) if x or i % 2]
    return rows.withColumn("message", F.concat(*pieces))


def run_all(spark: SparkSession, rules: list[Rule]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Rows by rule, and what failed by rule: one rule's error doesn't stop the others."""
    rows, failed = {}, {}
    for rule in rules:
        if rule.severity is None:
            continue
        try:
            rows[rule.id] = run(spark, rule)
        except Exception as e:  # noqa: BLE001 - any error of a rule is its diagnostic
            failed[rule.id] = str(e).split("\n")[0]
    return rows, failed


def with_overrides(rules: list[Rule], user: dict[str, dict], project: dict[str, dict]) -> tuple[list[Rule], list[str]]:
    """Rules with severities and parameters overridden, the project's over the user's; and the ids disabled by a null severity."""
    out, disabled = [], []
    for rule in rules:
        change = {**user.get(rule.id, {}), **project.get(rule.id, {})}
        severity = change.get("severity", rule.severity)
        if severity is None:
            disabled.append(rule.id)
            continue
        out.append(Rule(rule.id, rule.sql, rule.message, severity, {**rule.parameters, **change.get("parameters", {})}))
    return out, disabled


RULES = {
    r.id: r
    for r in (
        Rule("R03_method_override_ratio", """
SELECT c.id, f.path AS file, c.start_byte AS line, m.n AS methods, o.n AS overrides
FROM entities c JOIN files f ON f.id = c.file_id
JOIN (SELECT e.file_id, e.owner_type, count(*) AS n FROM entities e WHERE e.kind = 1 GROUP BY e.file_id, e.owner_type) m ON m.file_id = c.file_id AND m.owner_type = c.owner_type
JOIN (SELECT e.file_id, e.owner_type, count(*) AS n FROM entities e WHERE e.kind = 1 AND e.name IN (SELECT name FROM entities WHERE kind = 3) GROUP BY e.file_id, e.owner_type) o ON o.file_id = c.file_id AND o.owner_type = c.owner_type
WHERE c.kind = 0 AND o.n < :ratio * m.n + 1""", parameters={"ratio": 0.5}),
        Rule("R04_interface_segregation", """
SELECT f.path AS file, min(e.start_byte) AS line, e.owner_type, count(*) AS methods, sum(CASE WHEN c.id IS NULL AND e.line_span < :short THEN 1 ELSE 0 END) AS idle
FROM entities e JOIN files f ON f.id = e.file_id
LEFT JOIN (SELECT DISTINCT a.id FROM entities a JOIN entities b ON a.file_id = b.file_id AND b.kind = 4 AND a.start_byte <= b.start_byte AND a.end_byte >= b.end_byte WHERE a.kind = 1) c ON c.id = e.id
WHERE e.kind = 1 AND e.owner_type IS NOT NULL GROUP BY f.path, e.owner_type
HAVING sum(CASE WHEN c.id IS NULL AND e.line_span < :short THEN 1 ELSE 0 END) > :share * count(*)""", parameters={"short": 20, "share": 0.5}),
        Rule("R05_fat_interface", """
SELECT i.id, f.path AS file, i.start_byte AS line, count(*) AS members FROM entities i JOIN files f ON f.id = i.file_id
JOIN entities m ON m.file_id = i.file_id AND m.kind = 1 AND m.start_byte >= i.start_byte AND m.end_byte <= i.end_byte
WHERE i.kind = 3 AND NOT EXISTS (SELECT 1 FROM entities n WHERE n.file_id = m.file_id AND n.kind = 0 AND n.id <> i.id AND n.start_byte <= m.start_byte AND n.end_byte >= m.end_byte)
GROUP BY i.id, f.path, i.start_byte HAVING count(*) > :most""", parameters={"most": 1}),
        Rule("R06_too_many_interfaces", """
SELECT c.id, f.path AS file, c.start_byte AS line, count(DISTINCT i.name) AS interfaces FROM entities c JOIN files f ON f.id = c.file_id
JOIN entities i ON i.file_id = c.file_id AND i.kind = 3 WHERE c.kind = 0 GROUP BY c.id, f.path, c.start_byte HAVING interfaces > :most""", parameters={"most": 8}),
        Rule("R08_file_complexity_hotspot", """
WITH counted AS (SELECT f.id, f.path, f.complexity, count(DISTINCT e.name) AS names FROM files f JOIN entities e ON e.file_id = f.id
 WHERE NOT EXISTS (SELECT 1 FROM entities o WHERE o.file_id = e.file_id AND o.kind = 0 AND o.id <> e.id AND o.start_byte <= e.start_byte AND o.end_byte >= e.end_byte) GROUP BY f.id, f.path, f.complexity)
SELECT path AS file, 1 AS line, complexity, names FROM counted WHERE complexity > (SELECT avg(complexity) FROM files) * :times""", parameters={"times": 1.5}),
        Rule("R09_churn_complexity", "SELECT path AS file, 1 AS line, complexity, churn FROM files WHERE complexity > :complexity AND churn > :churn", "{file}: complexity {complexity}, {churn} changes", parameters={"complexity": 30, "churn": 8}),
        Rule("R10_function_gate", """
SELECT f.path AS file, e.start_byte AS line, e.name, e.cyclomatic, e.cognitive FROM entities e JOIN files f ON f.id = e.file_id
WHERE e.kind = 1 AND e.confidence = 'high' AND (e.cyclomatic > :cyclomatic OR e.cognitive > :cognitive)""", parameters={"cyclomatic": 20, "cognitive": 15}),
        Rule("R11_function_length", """
SELECT f.path AS file, e.start_byte AS line, e.name, e.line_span FROM entities e JOIN files f ON f.id = e.file_id
WHERE e.kind = 1 AND e.confidence = 'high' AND NOT f.is_test_path AND NOT f.is_tooling_path AND e.line_span * :scale > :length
  AND e.cyclomatic <= :cyclomatic AND e.cognitive <= :cognitive""", parameters={"length": 60, "scale": 3, "cyclomatic": 20, "cognitive": 15}),
        Rule("R12_function_advisory", """
SELECT f.path AS file, e.start_byte AS line, e.id, e.cyclomatic FROM entities e JOIN files f ON f.id = e.file_id
WHERE e.kind = 1 AND e.confidence <> 'high' ORDER BY e.cyclomatic DESC, e.id LIMIT CAST(:max_findings AS INT)""", parameters={"max_findings": 25}),
        Rule("R13_low_in_high_out", """
WITH o AS (SELECT from_unit, count(DISTINCT to_unit) AS n FROM dependency_facts WHERE certainty = 'certified' GROUP BY from_unit),
 i AS (SELECT to_unit, count(DISTINCT from_unit) AS n FROM dependency_facts WHERE certainty = 'certified' GROUP BY to_unit)
SELECT f.path AS file, 1 AS line, o.n AS fan_out, coalesce(i.n, 0) AS fan_in FROM o JOIN files f ON f.id = o.from_unit LEFT JOIN i ON i.to_unit = o.from_unit
WHERE o.n >= :out AND coalesce(i.n, 0) <= :in_""", parameters={"out": 15, "in_": 2}),
        Rule("R14_circular_import", """
WITH certain AS (SELECT from_unit, to_unit, min(source_id) AS line FROM dependency_facts WHERE certainty = 'certified' GROUP BY from_unit, to_unit)
SELECT f.path AS file, x.line, x.from_unit, x.to_unit FROM certain x JOIN certain y ON y.from_unit = x.to_unit AND y.to_unit = x.from_unit JOIN files f ON f.id = x.from_unit
WHERE x.from_unit < x.to_unit""", "direct dependency cycle between {from_unit} and {to_unit}"),
        Rule("R15_slice_sprawl", """
SELECT f.path AS file, e.name, min(e.start_byte) AS line, count(DISTINCT t.community_id) AS communities FROM entities e JOIN files f ON f.id = e.file_id
JOIN edges d ON d.from_file_id = e.file_id AND d.resolved = 1 AND d.id % 1000 BETWEEN e.start_byte AND e.end_byte JOIN files t ON t.id = d.to_file_id
WHERE e.kind = 1 GROUP BY f.path, e.name HAVING count(DISTINCT t.community_id) >= :least""", parameters={"least": 5}),
        Rule("R16_unresolved_import", "SELECT f.path AS file, e.id AS line FROM edges e JOIN files f ON f.id = e.from_file_id WHERE e.resolved = 0 AND e.kind = 1 AND f.language = :language", parameters={"language": "python"}),
        Rule("R17_dependency_boundary", """
SELECT a.path AS file, e.id AS line, b.path AS target FROM edges e JOIN files a ON a.id = e.from_file_id JOIN files b ON b.id = e.to_file_id
WHERE e.resolved = 1 AND :from_prefix <> '' AND :to_prefix <> '' AND (:from_prefix = '.' OR instr(a.path, :from_prefix) = 1) AND (:to_prefix = '.' OR instr(b.path, :to_prefix) = 1)""", parameters={"from_prefix": "lib/", "to_prefix": "src/vendor/"}),
        Rule("R18_clone_candidates", """
SELECT name, line_span, cyclomatic, count(*) AS members, min(id) AS line FROM entities WHERE kind = 1 AND line_span > :lines GROUP BY name, line_span, cyclomatic HAVING count(*) >= :members""", parameters={"lines": 8, "members": 3}),
        Rule("R20_file_floor", "SELECT path AS file, 1 AS line, 1000000 * (100 - complexity) AS score FROM files WHERE 100 - complexity < :floor AND NOT is_tooling_path", parameters={"floor": 55}),
        Rule("R21_function_cap", "SELECT f.path AS file, e.id AS line, e.cyclomatic * e.line_span AS debt FROM entities e JOIN files f ON f.id = e.file_id WHERE e.kind = 1 AND e.cyclomatic * e.line_span > :cap ORDER BY debt DESC, line", parameters={"cap": 500}),
        Rule("R22_scope_mean", "SELECT language AS file, 1 AS line, avg(100 - complexity) AS mean FROM files WHERE churn IS NOT NULL GROUP BY language HAVING avg(100 - complexity) < :floor", parameters={"floor": 90}),
        Rule("R23_unscored_share", """
WITH tokens AS (SELECT language, CAST(sum(CASE WHEN is_tooling_path OR churn = 0 THEN complexity ELSE 0 END) AS BIGINT) AS unscored, CAST(sum(complexity) AS BIGINT) AS n FROM files GROUP BY language)
SELECT language AS file, 1 AS line, unscored, n FROM tokens WHERE 10 * unscored > n"""),
        Rule("R24_suppressed", "SELECT language AS file, 1 AS line, CAST(sum(CASE WHEN churn = 0 THEN 1 ELSE 0 END) AS BIGINT) AS suppressed FROM files GROUP BY language HAVING sum(CASE WHEN churn = 0 THEN 1 ELSE 0 END) > 0"),
    )
}


def bound(rule: Rule) -> str:
    """The rule's SQL with its parameters written in, for another engine."""

    def literal(m: re.Match) -> str:
        v = rule.parameters.get(m[1])
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    return _NAME.sub(literal, rule.sql)


def _oracle(rule: Rule) -> str:
    sql, message = bound(rule), rule.message
    if message:
        parts = re.split(r"\{(\w+)\}", message)
        text = " || ".join(f"CAST({x} AS VARCHAR)" if i % 2 else f"'{x}'" for i, x in enumerate(parts) if x)
        sql = f"SELECT *, {text} AS message FROM ({sql}) rule_rows"
    return f"{WITH} SELECT * FROM ({sql}) found"


for _rule in RULES.values():

    def _build(t, rule=_rule):
        views(t)
        return run(t.spark, rule)

    query(_rule.id, _oracle(_rule))(_build)


@query("R07_deep_inheritance", """
WITH RECURSIVE up AS (
  SELECT s_suppkey AS id, s_suppkey // 2 AS parent, 0 AS depth, ',' || CAST(s_suppkey AS VARCHAR) || ',' AS seen FROM supplier
  UNION ALL SELECT up.id, up.parent // 2, up.depth + 1, up.seen || CAST(up.parent AS VARCHAR) || ',' FROM up WHERE instr(up.seen, ',' || CAST(up.parent AS VARCHAR) || ',') = 0 AND up.depth < 20)
SELECT id, max(depth) AS depth FROM up GROUP BY id HAVING max(depth) > 4""")
def _(t):
    t.supplier.createOrReplaceTempView("supplier")
    return t.spark.sql("""
WITH RECURSIVE up AS (
  SELECT s_suppkey AS id, s_suppkey div 2 AS parent, 0 AS depth, concat(',', s_suppkey, ',') AS seen FROM supplier
  UNION ALL SELECT up.id, up.parent div 2, up.depth + 1, concat(up.seen, up.parent, ',') FROM up WHERE instr(up.seen, concat(',', up.parent, ',')) = 0 AND up.depth < :cap)
SELECT id, max(depth) AS depth FROM up GROUP BY id HAVING max(depth) > :most""", args={"cap": 20, "most": 4})


