"""Queries over extracted dates, quantities and claims: prose is rendered from rows, and extracted back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import quantities as qt
from corpusloom.functions import temporal as tm
from corpusloom.functions import units
from corpusloom.plans.registry import query
from corpusloom.plans.relations import spread, table


def dated(spark, sf):
    """A note per order with its date in one of four forms."""
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 4
    form = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "MMMM d, yyyy")).when(k == 2, F.date_format(d, "MMMM yyyy")).otherwise(F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), F.year(d).cast("string")))
    return spread(table(spark, sf, "orders").select("o_orderkey", "o_orderdate")).select(F.col("o_orderkey").alias("id"), F.concat(F.lit("The order was placed on "), form, F.lit(" by post. Nothing else happened.")).alias("text"), F.lit("2024-06-15").alias("created_at"))


DATED = """x AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_orderkey % 4 AS k FROM orders),
 e AS (SELECT id, CASE WHEN k < 2 THEN d WHEN k = 2 THEN date_trunc('month', d) ELSE date_trunc('quarter', d) END::DATE AS s, CASE WHEN k < 2 THEN d WHEN k = 2 THEN last_day(d) ELSE last_day((date_trunc('quarter', d) + INTERVAL 2 MONTH)::DATE) END::DATE AS t, CASE WHEN k < 2 THEN 'day' WHEN k = 2 THEN 'month' ELSE 'quarter' END AS precision, CASE k WHEN 0 THEN 0.99 WHEN 1 THEN 0.97 WHEN 2 THEN 0.93 ELSE 0.92 END::DOUBLE AS confidence FROM x)"""


@query("extract_dates", f"WITH {DATED} SELECT id AS document_id, CAST(s AS VARCHAR) AS start_date, CAST(t AS VARCHAR) AS end_date, precision, confidence FROM e")
def extract_dates(spark, sf):
    e = tm.events(dated(spark, sf))
    return e.select("document_id", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"), "precision", "confidence")


@query("timeline_years", f"WITH {DATED} SELECT CAST(year(s) AS VARCHAR) AS year, count(*) AS n FROM e GROUP BY 1")
def timeline_years(spark, sf):
    return tm.buckets(tm.events(dated(spark, sf)), "year")


@query("timeline_decades", f"WITH {DATED} SELECT CAST(year(s) // 10 * 10 AS VARCHAR) || 's' AS decade, count(*) AS n FROM e GROUP BY 1")
def timeline_decades(spark, sf):
    return tm.buckets(tm.events(dated(spark, sf)), "decade")


@query("timeline_span", f"WITH {DATED} SELECT CAST(min(s) AS VARCHAR) AS earliest, CAST(max(t) AS VARCHAR) AS latest, count(*) AS total FROM e")
def timeline_span(spark, sf):
    return tm.span(tm.events(dated(spark, sf))).select(F.col("earliest").cast("string").alias("earliest"), F.col("latest").cast("string").alias("latest"), "total")


@query("timeline", f"WITH {DATED} SELECT id AS document_id, CAST(s AS VARCHAR) AS start_date FROM e WHERE confidence >= 0.95")
def timeline(spark, sf):
    return tm.timeline(tm.events(dated(spark, sf)), 0.95).select("document_id", F.col("start_date").cast("string").alias("start_date"))


@query("event_sentences", "SELECT o_orderkey AS document_id, starts_with('The order was placed on', 'The order') AS first_sentence FROM orders")
def event_sentences(spark, sf):
    e = tm.events(dated(spark, sf))
    return e.select("document_id", (F.col("sentence").startswith("The order was placed on ") & F.col("sentence").endswith(" by post.") & F.col("sentence").contains(F.col("text"))).alias("first_sentence"))


@query("relative_dates", "SELECT event_id AS document_id, CAST(CASE event_id % 3 WHEN 0 THEN CAST(ts AS DATE) - 1 WHEN 1 THEN CAST(ts AS DATE) - 21 ELSE CAST(ts AS DATE) - ((isodow(CAST(ts AS DATE)) - 2 + 7) % 7 + CASE WHEN isodow(CAST(ts AS DATE)) = 2 THEN 7 ELSE 0 END)::INT END AS VARCHAR) AS start_date FROM events")
def relative_dates(spark, sf):
    k = F.col("event_id") % 3
    text = F.when(k == 0, "We spoke yesterday about it.").when(k == 1, "Filed three weeks ago already.").otherwise("We met last Tuesday in town.")
    docs = spread(table(spark, sf, "events").select("event_id", "ts")).select(F.col("event_id").alias("id"), text.alias("text"), F.col("ts").alias("created_at"))
    return tm.events(docs).select("document_id", F.col("start_date").cast("string").alias("start_date"))


@query(
    "date_forms",
    """WITH x AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_orderkey % 9 AS k FROM orders), y AS (SELECT *, year(d) AS y, month(d) AS m, day(d) AS a FROM x)
 SELECT id, CAST(CASE WHEN k < 2 AND a <= 12 THEN least(make_date(y, m, a), make_date(y, a, m)) WHEN k < 2 THEN d WHEN k = 2 THEN make_date(y, m, 1) WHEN k = 3 THEN make_date(y, m, 11) WHEN k = 4 THEN make_date(y, m, 21) WHEN k = 5 THEN make_date(y - 1, m, 1) WHEN k = 6 THEN make_date(y, 3, 1) WHEN k = 7 THEN make_date(y // 10 * 10, 1, 1) ELSE make_date(y - 2, 1, 1) END AS VARCHAR) AS start_date,
 CAST(CASE WHEN k < 2 AND a <= 12 THEN greatest(make_date(y, m, a), make_date(y, a, m)) WHEN k < 2 THEN d WHEN k = 2 THEN make_date(y, m, 10) WHEN k = 3 THEN make_date(y, m, 20) WHEN k IN (4, 5) THEN last_day(d) WHEN k = 6 THEN make_date(y, 5, 31) WHEN k = 7 THEN make_date(y // 10 * 10 + 9, 12, 31) ELSE make_date(y, 12, 31) END AS VARCHAR) AS end_date,
 CASE k WHEN 0 THEN 'absolute' WHEN 1 THEN 'absolute' WHEN 5 THEN 'range' WHEN 6 THEN 'season' WHEN 7 THEN 'decade' WHEN 8 THEN 'range' ELSE 'partial' END AS kind FROM y""",
)
def date_forms(spark, sf):
    """Ambiguous and dotted dates, parts of months, ranges, seasons and decades, one a note."""
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 9
    y, named = F.year(d), F.date_format(d, "MMMM yyyy")
    forms = [F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "dd.MM.yyyy"), F.concat(F.lit("early "), named), F.concat(F.lit("mid-"), named), F.concat(F.lit("late "), named)]
    forms += [F.concat(F.lit("between "), F.date_format(F.add_months(d, -12), "MMMM yyyy"), F.lit(" and "), named), F.concat(F.lit("the spring of "), y.cast("string")), F.concat(F.lit("the "), (y - y % 10).cast("string"), F.lit("s"))]
    form = F.concat(F.lit("from "), (y - 2).cast("string"), F.lit(" to "), y.cast("string"))
    for n, f in enumerate(forms):
        form = F.when(k == n, f).otherwise(form)
    notes = spread(table(spark, sf, "orders").select("o_orderkey", "o_orderdate")).select(F.col("o_orderkey").alias("id"), F.concat(F.lit("The work was done in this time: "), form, F.lit(" by post. It ended well.")).alias("text"), F.lit("2024-06-15").alias("created_at"))
    return tm.events(notes).select(F.col("document_id").alias("id"), F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"), "kind")


def weights(spark, sf):
    """Notes that quote an order line's weight in one of three units."""
    k = F.col("l_orderkey") % 3
    q = F.col("l_quantity").cast("int")
    text = F.concat(F.lit("The shipment weighs "), F.when(k == 0, F.concat(q.cast("string"), F.lit(" kg"))).when(k == 1, F.concat((q * 1000).cast("string"), F.lit(" grams"))).otherwise(F.concat(q.cast("string"), F.lit(" lb"))), F.lit("."))
    return spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), text.alias("text"))


WEIGHT = "w AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_orderkey % 3 = 2 THEN CAST(l_quantity AS INT) * 0.45359237::DOUBLE ELSE CAST(l_quantity AS INT)::DOUBLE END AS kg, l_orderkey % 3 AS k FROM lineitem)"


@query("extract_quantities", f"WITH {WEIGHT} SELECT id AS document_id, round(kg, 6) AS canonical_value, CASE k WHEN 0 THEN 'kilogram' WHEN 1 THEN 'gram' ELSE 'pound' END AS unit, 'shipment' AS subject, 'mass' AS dimension FROM w")
def extract_quantities(spark, sf):
    return qt.quantities(weights(spark, sf), columns=("canonical_value", "unit", "subject", "dimension")).select("document_id", F.round("canonical_value", 6).alias("canonical_value"), "unit", "subject", "dimension")


@query(
    "quantity_forms",
    """WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_quantity AS INT) + 2 AS q, (l_orderkey + l_linenumber) % 6 AS k FROM lineitem)
 SELECT id, CASE k WHEN 0 THEN q + 2 WHEN 4 THEN q * 1000 WHEN 5 THEN q * 1e6 ELSE q END::DOUBLE AS value, CASE WHEN k = 0 THEN q END::DOUBLE AS low, CASE WHEN k = 0 THEN q + 4 END::DOUBLE AS high, CASE k WHEN 0 THEN 'kilogram' WHEN 3 THEN 'percent' WHEN 4 THEN 'usd' WHEN 5 THEN 'usd' END AS unit, CASE k WHEN 1 THEN 'lower_bound' WHEN 2 THEN 'upper_bound' END AS marker FROM x""",
)
def quantity_forms(spark, sf):
    """Ranges, bounds, percentages and sums of money, one a note."""
    q, k = (F.col("l_quantity").cast("int") + 2).cast("string"), (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    high = (F.col("l_quantity").cast("int") + 6).cast("string")
    text = F.when(k == 0, F.concat(F.lit("The shipment weighs between "), q, F.lit(" and "), high, F.lit(" kg."))).when(k == 1, F.concat(F.lit("At least "), q, F.lit(" boxes are missing.")))
    text = text.when(k == 2, F.concat(F.lit("No more than "), q, F.lit(" boxes are missing."))).when(k == 3, F.concat(F.lit("Costs rose by "), q, F.lit(" percent."))).when(k == 4, F.concat(F.lit("The fee is $"), q, F.lit(",000."))).otherwise(F.concat(F.lit("The fee is "), q, F.lit(" million dollars.")))
    notes = spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), text.alias("text"))
    return qt.quantities(notes, columns=("value", "value_low", "value_high", "unit", "marker")).select(F.col("document_id").alias("id"), "value", F.col("value_low").alias("low"), F.col("value_high").alias("high"), "unit", "marker")


@query("unit_conversion", "SELECT l_orderkey * 10 + l_linenumber AS id, round(CASE l_orderkey % 4 WHEN 0 THEN l_quantity * 1609.344::DOUBLE WHEN 1 THEN (l_quantity - 32) * 5::DOUBLE / 9 + 273.15::DOUBLE WHEN 2 THEN l_quantity * 1024 ELSE l_quantity END, 6) AS canonical_value, CASE l_orderkey % 4 WHEN 0 THEN 'meter' WHEN 1 THEN 'kelvin' WHEN 2 THEN 'byte' ELSE 'widgets' END AS base_unit FROM lineitem")
def unit_conversion(spark, sf):
    k = F.col("l_orderkey") % 4
    df = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("value"), F.when(k == 0, "Miles").when(k == 1, "°F").when(k == 2, "KiB").otherwise("widgets").alias("unit"))
    return units.normalize_units(df).select("id", F.round("canonical_value", 6).alias("canonical_value"), "base_unit")


def quotes(spark, sf):
    """Two sources a part state its weight; the second in another scale."""
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    word = F.concat(F.lit("widget"), F.translate(F.repeat(F.col("p_partkey").cast("string"), 3), "0123456789", "abcdfhjklm"), F.lit("x"))  # no ending that stemming cuts
    first = p.select((F.col("p_partkey") * 2).alias("id"), F.concat(F.lit("The "), word, F.lit(" weighs "), (F.col("p_size") + 10).cast("string"), F.lit(" kg.")).alias("text"))
    second = p.select((F.col("p_partkey") * 2 + 1).alias("id"), F.concat(F.lit("The "), word, F.lit(" weighs "), ((F.col("p_size") + 10) * (1000 + F.col("p_partkey") % 5 * 300)).cast("string"), F.lit(" grams.")).alias("text"))
    return spread(first.unionByName(second))


@query("contradictions", "SELECT round(p_size + 10, 6)::DOUBLE AS min, round((p_size + 10) * (1000 + p_partkey % 5 * 300) / 1000.0::DOUBLE, 6) AS max, CASE p_partkey % 5 WHEN 0 THEN 'none' WHEN 4 THEN 'major' ELSE 'minor' END AS severity, CAST(2 AS BIGINT) AS claims FROM part")
def contradictions(spark, sf):
    """Each part's two statements form one group; the names are three times as long as an edit, so that parts stay apart."""
    g = qt.summarize_groups(qt.group_claims(qt.quantities(quotes(spark, sf))), 2)
    return g.select(F.round("min", 6).alias("min"), F.round("max", 6).alias("max"), "severity", "claims")


@query("claim_severity", "SELECT o_orderkey AS id, CASE WHEN n < 2 OR (pct AND hi - lo <= 1) OR r <= 1 + CASE WHEN ap THEN 0.25::DOUBLE ELSE 0.05::DOUBLE END THEN 'none' WHEN r < 2 THEN 'minor' ELSE 'major' END AS severity FROM (SELECT *, CASE WHEN lo > 0 THEN hi / lo ELSE 1 + abs(hi - lo) / greatest(abs(lo), abs(hi), 1e-9::DOUBLE) END AS r FROM (SELECT o_orderkey, o_orderkey % 4 AS n, o_orderkey % 5 = 0 AS pct, o_orderkey % 3 = 0 AS ap, CAST(o_custkey % 20 - 3 AS DOUBLE) AS lo, CAST(o_custkey % 20 - 3 AS DOUBLE) + o_orderkey % 11 AS hi FROM orders))")
def claim_severity(spark, sf):
    o = table(spark, sf, "orders")
    lo = (F.col("o_custkey") % 20 - 3).cast("double")
    sev = qt.severity(F.when(F.col("o_orderkey") % 5 == 0, "percent").otherwise("mass"), lo, lo + F.col("o_orderkey") % 11, F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 4)
    return o.select(F.col("o_orderkey").alias("id"), sev.alias("severity"))


@query("document_quantities")
def document_quantities(spark, sf):
    return qt.quantities(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", columns=tuple(c.split()[0] for c in qt.QUANTITY_SCHEMA.split(", ")))


@query("document_dates", "SELECT doc_id AS document_id, CAST(DATE '2001-01-01' + CAST(doc_id % 8000 AS INT) AS VARCHAR) AS start_date, 'day' AS precision FROM documents")
def document_dates(spark, sf):
    """Whole documents, each with a dated last line."""
    import datetime as dt

    day = F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), (F.col("doc_id") % 8000).cast("int")), "d MMMM yyyy")
    docs = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\nWritten on "), day, F.lit(".")).alias("text"))
    return tm.events(docs, dt.date(2024, 6, 15), "doc_id", created_col=None).select("document_id", F.col("start_date").cast("string").alias("start_date"), "precision")
