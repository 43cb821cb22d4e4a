"""Queries of the rule language."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.plans.registry import query
from corpusloom.plans.relations import ENTRIES, entries, spread, table


def _where(name: str, condition: str, sql: str) -> None:
    """A rule over orders against the same condition in SQL."""

    @query(name, f"SELECT o_orderkey FROM orders WHERE {sql}")
    def run(spark, sf, condition=condition):
        o = table(spark, sf, "orders")
        return o.where(rules.condition(condition, o.schema, ascii_only=True)).select("o_orderkey")


_where("rule_compare", 'o_totalprice > 100000 and o_orderstatus == "f" or not o_orderkey >= 100', "(o_totalprice > 100000 AND o_orderstatus = 'F') OR NOT o_orderkey >= 100")
_where("rule_members", 'o_orderpriority in ["1-URGENT", "5-low"] and o_orderstatus not in ["P"]', "o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus <> 'P'")
_where("rule_text", 'o_orderpriority contains "high" or o_orderpriority matches /^[45]-[A-Z]+/', "contains(lower(o_orderpriority), 'high') OR regexp_matches(o_orderpriority, '^[45]-[A-Z]+')")
_where("rule_dates", 'o_orderdate after "1997-01-01" and o_orderdate before "1998-06-15"', "o_orderdate > TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-06-15'")

RULES = [
    {"id": 1, "name": "long", "trigger": "*", "condition": "word_count > 300", "actions": [{"type": "tag", "value": "long"}], "enabled": True},
    {"id": 2, "name": "pinned articles", "trigger": "entry.created", "condition": 'source_type == "ARTICLE" and is_pinned', "actions": [{"type": "pin"}, {"type": "tag", "value": "Top"}], "enabled": True},
    {"id": 3, "name": "english", "trigger": "entry.created", "condition": 'tags contains "en"', "actions": [{"type": "archive"}], "enabled": True},
    {"id": 4, "name": "off", "trigger": "*", "condition": "word_count > 0", "actions": [{"type": "archive"}], "enabled": False},
    {"id": 5, "name": "elsewhere", "trigger": "entry.deleted", "condition": "word_count > 0", "actions": [{"type": "archive"}], "enabled": True},
    {"id": 6, "name": "broken", "trigger": "*", "condition": "no_such_field == 1", "actions": [{"type": "archive"}], "enabled": True},
]


def rows(spark, sf):
    from corpusloom.operators.library import word_count

    return entries(spark, sf).withColumn("word_count", word_count(F.col("summary")))


W = "CASE WHEN trim(regexp_replace(summary, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(summary, '\\s+', ' ', 'g')), ' ')) END"
HITS = f"w AS (SELECT *, {W} AS wc FROM entries), h AS (SELECT id, 1 AS rule_id, wc > 300 AS matched FROM w UNION ALL SELECT id, 2, coalesce(source_type = 'article', false) AND is_pinned FROM w UNION ALL SELECT id, 3, contains(lower(tags), 'en') FROM w UNION ALL SELECT id, unnest([4, 5, 6]), false FROM w)"


@query("run_rules", f"WITH {ENTRIES}, {HITS} SELECT id, CAST(rule_id AS BIGINT) AS rule_id, matched, rule_id = 6 AS failed FROM h")
def run_rules(spark, sf):
    return rules.run_rules(rows(spark, sf), RULES, "entry.created", ascii_only=True).select("id", "rule_id", "matched", F.col("error").isNotNull().alias("failed"))


@query("apply_rule_actions", f"WITH {ENTRIES}, {HITS} SELECT e.id, CASE WHEN exists (SELECT 1 FROM h WHERE h.id = e.id AND rule_id = 3 AND matched) THEN true ELSE is_archived END AS is_archived, CASE WHEN exists (SELECT 1 FROM h WHERE h.id = e.id AND rule_id = 2 AND matched) THEN true ELSE is_pinned END AS is_pinned FROM entries e")
def apply_rule_actions(spark, sf):
    e = rows(spark, sf)
    return rules.apply_actions(e, rules.run_rules(e, RULES, "entry.created", ascii_only=True), RULES).select("id", "is_archived", "is_pinned")


def _over_documents(name: str, condition: str, sql: str) -> None:
    """A rule over whole documents, with accents folded, against the same condition in SQL."""

    @query(name, f"WITH a AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), b AS (SELECT doc_id, text, array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN strip_accents(c) <> c THEN strip_accents(c) || '~' ELSE c END), '') AS t FROM a) SELECT doc_id FROM b WHERE {sql}")
    def run(spark, sf, condition=condition):
        d = spread(table(spark, sf, "documents").select("doc_id", "text"))
        return d.where(rules.condition(condition, d.schema)).select("doc_id")


WORDS = "regexp_extract_all(lower(t), '[a-z0-9]+(?:''[a-z]+)?')"

# words with the stem "sch" or "nicht" are those and their plurals, and what a silent or past ending makes of the latter
_over_documents("rule_mentions", 'text mentions "SCH" or text mentions "nicht aulich"', f"list_has_any({WORDS}, ['sch', 'schs']) OR regexp_matches(' ' || array_to_string({WORDS}, ' ') || ' ', ' (nicht|nichts|nichte|nichtes|nichted|nichting) (aulich|aulichs|auliche|auliches|auliched|auliching) ')")
# a pattern sees the first 20 000 characters, which bounds what a rule may cost
_over_documents("rule_matches", "text matches /[0-9]{4} [0-9]{4}/ or text matches /DIE/i", "regexp_matches(left(text, 20000), '[0-9]{4} [0-9]{4}') OR regexp_matches(left(text, 20000), '(?i)DIE')")


@query("rule_explain", "SELECT o_orderkey AS id, 'total is more than ' || CAST(o_orderkey % 50 AS VARCHAR) || ' and not (status is F)' AS explain FROM orders")
def rule_explain(spark, sf):
    """What fifty rules say in words."""
    said = spark.createDataFrame([(k, rules.describe(rules.parse(f'total > {k} and not status == "F"')).replace("'", "")) for k in range(50)], "k int, explain string")
    return table(spark, sf, "orders").selectExpr("o_orderkey AS id", "CAST(o_orderkey % 50 AS INT) AS k").join(said, "k").select("id", "explain")
