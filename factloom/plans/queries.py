"""Registered queries, each over its whole tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import numbers as N
from factloom.functions import text as X
from factloom.operators import chunks, facts, gates, grids, retrieval, rowsets, signals, traces
from factloom.plans.registry import ORACLES, QUERIES, query, table
from factloom.sources import sinks
from factloom.sources.stage import dealt, staged

# Facts of the comparison queries: an order's truth is the sum of its lines; what was extracted for it differs
# from the truth by a defect that the order's priority decides; orders of status P were not extracted.
TRUTH = "truth AS (SELECT 'line' AS taxonomy, l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS value FROM lineitem GROUP BY l_orderkey)"
EXTRACTED = """extracted AS (SELECT 'line' AS taxonomy, o_orderkey AS k, o_custkey AS cust, o_orderstatus AS status,
 CAST(CASE substr(o_orderpriority, 1, 1) WHEN '2' THEN -t.value WHEN '3' THEN t.value * 1000 WHEN '4' THEN t.value + 7.77
 ELSE coalesce(t.value, CAST(o_totalprice AS DECIMAL(18,2))) END AS DECIMAL(24,2)) AS value
 FROM orders LEFT JOIN truth t ON t.k = o_orderkey WHERE o_orderstatus <> 'P')"""
CLASSED = f"""{TRUTH}, {EXTRACTED}, classed AS (SELECT e.*, t.value AS gold, CASE WHEN t.k IS NULL THEN 'untagged' WHEN e.value = t.value THEN 'exact'
 WHEN e.value = -t.value THEN 'sign' WHEN abs(e.value) = abs(t.value) * 1000 THEN 'scale' ELSE 'other' END AS class FROM extracted e LEFT JOIN truth t USING (k))"""


def truth_facts(spark, sf) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(price).alias("value")).select(F.lit("line").alias("taxonomy"), "k", "value")


def extracted_facts(spark, sf) -> DataFrame:
    t = truth_facts(spark, sf).select("k", F.col("value").alias("gold"))
    o = table(spark, sf, "orders").where("o_orderstatus <> 'P'").withColumnRenamed("o_orderkey", "k").join(t, "k", "left")
    p, g = F.substring("o_orderpriority", 1, 1), F.col("gold")
    value = F.when(p == "2", -g).when(p == "3", g * 1000).when(p == "4", g + F.lit(7.77).cast("decimal(4,2)")).otherwise(F.coalesce(g, F.col("o_totalprice").cast("decimal(18,2)")))
    return o.select(F.lit("line").alias("taxonomy"), "k", F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), value.cast("decimal(24,2)").alias("value"))


@query(f"WITH {CLASSED} SELECT status, class, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM classed GROUP BY ALL")
def truth_compare(spark, sf):
    c = facts.classify(extracted_facts(spark, sf), truth_facts(spark, sf), ["taxonomy", "k"])
    return c.groupBy("status", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("double").alias("total"))


@query(f"WITH {TRUTH}, {EXTRACTED} SELECT l_shipmode_year AS year, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM (SELECT t.k, t.value, year(o_orderdate) AS l_shipmode_year FROM truth t JOIN orders ON o_orderkey = t.k WHERE o_custkey IN (SELECT cust FROM extracted) AND t.k NOT IN (SELECT k FROM extracted)) GROUP BY ALL")
def truth_missed_in_scope(spark, sf):
    e = extracted_facts(spark, sf)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("year"))
    m = facts.missed(truth_facts(spark, sf).join(o, "k"), e, ["taxonomy", "k"], e, ["cust"])
    return m.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("double").alias("total"))


@query(f"""WITH {CLASSED} SELECT r_name AS region, n_name AS nation, count(*) AS extracted, count(*) FILTER (class <> 'untagged') AS comparable, count(*) FILTER (class = 'exact') AS exact,
 grouping(r_name, n_name) AS level, round(count(*) FILTER (class = 'exact') / nullif(count(*) FILTER (class <> 'untagged'), 0), 6) AS precision, round(count(*) FILTER (class <> 'untagged') / count(*), 6) AS verifiability,
 round(count(*) FILTER (class = 'exact') / count(*), 6) AS trust FROM classed JOIN customer ON cust = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def trust_rollup(spark, sf):
    c = facts.classify(extracted_facts(spark, sf), truth_facts(spark, sf), ["taxonomy", "k"])
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    owners = table(spark, sf, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("cust"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"))
    return facts.scorecard(c.join(owners, "cust"), ["region", "nation"])


def _money_text(sep: str):
    """Prices as printed with thousands groups; returned lines in parentheses, zero discounts as a dash."""
    plain = F.format_number(F.col("l_extendedprice"), 2)
    shown = plain if sep == "." else F.translate(F.translate(F.translate(plain, ".", "#"), ",", "."), "#", ",")
    return F.when(F.col("l_discount") == 0, "–").when(F.col("l_tax") == 0, F.concat(F.lit("(-"), shown, F.lit(")"))).when(F.col("l_returnflag") == "R", F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)


_PARSED = "SELECT l_returnflag, CASE WHEN l_discount = 0 THEN 'nil' WHEN l_tax = 0 THEN 'reject' ELSE 'value' END AS state, count(*) AS n, CAST(sum(CASE WHEN l_discount = 0 OR l_tax = 0 THEN NULL WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(18,2)) ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS total FROM lineitem GROUP BY ALL"


def _number_parse(spark, sf, sep):
    p = N.parse_strict(F.col("token"), sep)
    rows = table(spark, sf, "lineitem").select("l_returnflag", _money_text(sep).alias("token")).select("l_returnflag", p.alias("p"))
    state = F.when(F.col("p.is_nil"), "nil").when(F.col("p.value").isNull(), "reject").otherwise("value")
    return rows.groupBy("l_returnflag", state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum("p.value").cast("double").alias("total"))


@query(_PARSED)
def number_parse_us(spark, sf):
    return _number_parse(spark, sf, ".")


@query(_PARSED)
def number_parse_eu(spark, sf):
    return _number_parse(spark, sf, ",")


@query(r"""SELECT doc_id, CASE WHEN length(regexp_extract_all(text, '\d{1,3}(?:\.\d{3})+,\d+|\d{1,3}(?:\.\d{3}){2,}')) > length(regexp_extract_all(text, '\d{1,3}(?:,\d{3})+\.\d+|\d{1,3}(?:,\d{3}){2,}')) THEN ',' ELSE '.' END AS sep,
 CAST(length(regexp_extract_all(text, '\(?[-–−+]?[$€£]?\d[\d.,]*\d%?\)?|\(?[-–−+]?\d%?\)?')) AS INTEGER) AS n_tokens FROM documents""")
def locale_detect(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.detect_separator(F.col("text")).alias("sep"), F.size(N.tokens_of(F.col("text"))).alias("n_tokens"))


@query("SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE o_totalprice END, 2) AS v_en, round(CASE WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE o_totalprice END, 2) AS v_eu FROM orders")
def number_lenient(spark, sf):
    t = F.format_number("o_totalprice", 2)
    swap = F.translate(F.translate(F.translate(t, ".", "#"), ",", "."), "#", ",")
    wrap = lambda c: F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("("), c, F.lit(")"))).otherwise(F.concat(F.lit("$"), c))
    return table(spark, sf, "orders").select("o_orderkey", N.parse_lenient(wrap(t), F.lit(".")).alias("v_en"), N.parse_lenient(wrap(swap), F.lit(",")).alias("v_eu"))


@query("""SELECT k, count(*) AS n FROM (SELECT CASE WHEN r > 0 AND abs(r / power(10.0, round(log10(r))) - 1) <= 0.005 AND round(log10(r)) <> 0 AND abs(round(log10(r))) <= 9 THEN CAST(round(log10(r)) AS INTEGER) END AS k
 FROM (SELECT l_extendedprice / nullif(l_quantity * 1000, 0) AS r FROM lineitem)) GROUP BY k""")
def scale_exponent(spark, sf):
    k = N.scale_exponent(F.col("l_extendedprice"), F.col("l_quantity") * 1000)
    return table(spark, sf, "lineitem").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH z AS (SELECT o_custkey AS cust, least(length(v) - length(rtrim(v, '0')), 9) AS zeros FROM (SELECT o_custkey, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS v FROM orders WHERE round(o_totalprice * 100) >= 1000000)),
 c AS (SELECT cust, zeros, count(*) AS n_facts FROM z GROUP BY ALL) SELECT cust, CAST(zeros AS INTEGER) AS zeros, n_facts, CAST(-zeros AS INTEGER) AS decimals, power(10.0, zeros) / 2 AS tol FROM c QUALIFY row_number() OVER (PARTITION BY cust ORDER BY n_facts DESC, zeros) = 1""")
def infer_precision(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), F.round(F.col("o_totalprice") * 100).cast("decimal(38,0)").alias("value"))
    return facts.infer_precision(o, "cust", "value")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def dedupe_last(spark, sf):
    return facts.keep_one(table(spark, sf, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id", "value")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) = 1")
def dedupe_first(spark, sf):
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")]
    return facts.keep_one(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("SELECT l_orderkey, l_linenumber, count(DISTINCT l_extendedprice) AS n_values, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_extendedprice) > 1")
def duplicate_conflicts(spark, sf):
    lines = table(spark, sf, "lineitem")
    return facts.conflicts(dealt(lines, lines.count(), "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], "l_extendedprice")


@query("""WITH u AS (SELECT l_partkey AS part, l_suppkey AS supp, l_extendedprice AS price, (l_shipdate, l_orderkey, l_linenumber) AS pt FROM lineitem),
 e AS (SELECT part, supp, arg_min(price, pt) AS first_value, arg_max(price, pt) AS last_value, count(DISTINCT price) AS n_values, count(*) AS n_filings FROM u GROUP BY ALL)
 SELECT *, round(abs(last_value - first_value) / nullif(abs(first_value), 0), 6) AS rel_delta, CASE WHEN first_value = -last_value THEN 'sign_flip' ELSE 'value_change' END AS kind FROM e WHERE n_values > 1 AND first_value <> last_value""")
def restatements(spark, sf):
    u = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"), "l_shipdate", "l_orderkey", "l_linenumber")
    return facts.restatements(u, ["part", "supp"], "price", ["l_shipdate", "l_orderkey", "l_linenumber"])


@query("SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 2")
def topn_per_group(spark, sf):
    return facts.top_n(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey", "o_totalprice", "rank")


# An order's header (net, discount and tax parts, total) rebuilt from its lines in cents; a defect by priority.
HEADER = """lines AS (SELECT l_orderkey AS k, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS gross, sum(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT)) AS discount, sum(CAST(round(l_extendedprice * l_tax * 100) AS BIGINT)) AS tax FROM lineitem GROUP BY 1),
 header AS (SELECT o_orderkey AS k, o_orderpriority AS p, gross, discount, CASE substr(o_orderpriority, 1, 1) WHEN '2' THEN -tax ELSE tax END AS tax, gross - discount + CASE substr(o_orderpriority, 1, 1) WHEN '3' THEN tax + 1 WHEN '4' THEN tax + 50 ELSE tax END AS total FROM orders LEFT JOIN lines ON k = o_orderkey)"""


def header_facts(spark, sf) -> DataFrame:
    cents = lambda c: F.sum(F.round(c * 100).cast("long"))
    price = F.col("l_extendedprice")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(cents(price).alias("gross"), cents(price * F.col("l_discount")).alias("discount"), cents(price * F.col("l_tax")).alias("tax"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"), F.col("o_orderdate").alias("filed")).join(lines, "k", "left")
    p = F.substring("p", 1, 1)
    total = F.col("gross") - F.col("discount") + F.when(p == "3", F.col("tax") + 1).when(p == "4", F.col("tax") + 50).otherwise(F.col("tax"))
    h = o.select("k", "p", "filed", "gross", "discount", F.when(p == "2", -F.col("tax")).otherwise(F.col("tax")).alias("tax"), total.alias("total"))
    parts = F.array(*[F.struct(F.lit(c).alias("concept"), F.col(c).alias("value")) for c in ("gross", "discount", "tax", "total")])
    return h.select(F.col("k").alias("period"), F.col("k").alias("accn"), "filed", "p", F.lit("USD").alias("unit"), F.lit(0.25).alias("tol"), F.inline(parts)).where("value is not null")


TERMS = [("net", "gross", 1, 0), ("net", "discount", -1, 1), ("net", "tax", 1, 2), ("net", "total", 0, 3)]


def _checked(spark, sf):
    terms = spark.createDataFrame(TERMS, "rule string, concept string, coef int, ord int")
    f = header_facts(spark, sf)
    done = facts.check(facts.resolve(f, terms))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("period"), F.col("o_orderpriority").alias("p")).join(done, "period", "left").withColumn("status", F.coalesce("status", F.lit("SKIP")))


_STATUS = "CASE WHEN gross IS NULL THEN 'SKIP' WHEN abs(gross - discount + tax - total) <= 1 THEN 'PASS' ELSE 'FAIL' END"


@query(f"WITH {HEADER} SELECT p, {_STATUS} AS status, count(*) AS n, CAST(sum(gross - discount + tax - total) AS BIGINT) AS delta FROM header GROUP BY ALL")
def identity_check(spark, sf):
    return _checked(spark, sf).groupBy("p", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("delta").cast("long").alias("delta"))


@query(f"""WITH {HEADER} SELECT suspect, count(*) AS n FROM (SELECT CASE WHEN {_STATUS} <> 'FAIL' THEN NULL WHEN abs(d - 2 * gross) <= 1 THEN 'gross' WHEN abs(d + 2 * discount) <= 1 THEN 'discount' WHEN abs(d - 2 * tax) <= 1 THEN 'tax' END AS suspect
 FROM (SELECT *, gross - discount + tax - total AS d FROM header)) GROUP BY ALL""")
def identity_sign_suspect(spark, sf):
    return _checked(spark, sf).groupBy("suspect").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {HEADER} SELECT rule, status, count(*) AS n FROM (SELECT 'net' AS rule, {_STATUS} AS status FROM header
 UNION ALL SELECT 'fallback', CASE WHEN o_totalprice > 0 THEN 'PASS' ELSE 'FAIL' END FROM header JOIN orders ON o_orderkey = k WHERE gross IS NULL) WHERE NOT (rule = 'net' AND status = 'SKIP') GROUP BY ALL""")
def identity_fallback_variants(spark, sf):
    primary = _checked(spark, sf).select(F.lit("net").alias("rule"), "period", "status")
    second = table(spark, sf, "orders").select(F.lit("fallback").alias("rule"), F.col("o_orderkey").alias("period"), F.when(F.col("o_totalprice") > 0, "PASS").otherwise("FAIL").alias("status"))
    return facts.with_fallback(primary, second).groupBy("rule", "status").agg(F.count(F.lit(1)).alias("n"))


_BALANCE = """b AS (SELECT o_custkey AS owner, year(o_orderdate) AS year, sum(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(round(o_totalprice) AS BIGINT) END) AS change, sum(CAST(round(o_totalprice) AS BIGINT)) AS real FROM orders GROUP BY ALL),
 c AS (SELECT owner, year, change, sum(real) OVER (PARTITION BY owner ORDER BY year) AS closing FROM b)"""


@query(f"WITH {_BALANCE} SELECT status, count(*) AS n FROM (SELECT CASE WHEN p.closing IS NULL THEN 'SKIP' WHEN abs(c.closing - p.closing - c.change) <= 0.5 THEN 'PASS' ELSE 'WARN' END AS status FROM c LEFT JOIN c p ON p.owner = c.owner AND p.year = c.year - 1) GROUP BY ALL")
def cash_continuity(spark, sf):
    from pyspark.sql import Window

    whole = F.round("o_totalprice").cast("long")
    b = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("owner"), F.year("o_orderdate").alias("year")).agg(F.sum(F.when(F.col("o_orderstatus") == "P", 0).otherwise(whole)).alias("change"), F.sum(whole).alias("real"))
    c = b.withColumn("closing", F.sum("real").over(Window.partitionBy("owner").orderBy("year"))).drop("real")
    return facts.continuity(c).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, count(*) AS n_rows, max(p_type) AS concept, bool_and(p_retailprice > 1000) AS flip FROM (SELECT *, p_name || '|' || p_brand || '|' || p_size AS label FROM part) GROUP BY label HAVING count(DISTINCT p_type) = 1")
def label_map_build(spark, sf):
    rows = table(spark, sf, "part").select(F.concat_ws("|", "p_name", "p_brand", F.col("p_size").cast("string")).alias("label"), F.col("p_type").alias("concept"), (F.col("p_retailprice") > 1000).alias("flip"))
    return facts.label_map(rows)


@query("""WITH r AS (SELECT p_partkey, p_name || ' ' || p_brand AS noisy, CASE WHEN p_type = 'ECONOMY' THEN p_name || ' ' || p_brand WHEN p_type = 'STANDARD' THEN upper(replace(p_name, ' ', '')) || p_brand ELSE 'unknown ' || p_name END AS raw FROM part),
 l AS (SELECT p_name || ' ' || p_brand AS exact, lower(replace(p_name || p_brand, ' ', '')) AS squashed, p_partkey AS ord, p_type AS concept FROM part),
 e AS (SELECT exact, arg_min(concept, ord) AS c FROM l GROUP BY 1), s AS (SELECT squashed, arg_min(concept, ord) AS c FROM l GROUP BY 1)
 SELECT CASE WHEN e.c IS NOT NULL THEN 'exact' WHEN s.c IS NOT NULL THEN 'squashed' ELSE 'none' END AS tier, coalesce(e.c, s.c) AS concept, count(*) AS n FROM r LEFT JOIN e ON r.raw = e.exact LEFT JOIN s ON lower(replace(r.raw, ' ', '')) = s.squashed GROUP BY ALL""")
def label_lookup_two_tier(spark, sf):
    p = table(spark, sf, "part")
    name = F.concat_ws(" ", "p_name", "p_brand")
    raw = F.when(F.col("p_type") == "ECONOMY", name).when(F.col("p_type") == "STANDARD", F.concat(F.upper(F.regexp_replace("p_name", " ", "")), F.col("p_brand"))).otherwise(F.concat(F.lit("unknown "), F.col("p_name")))
    # a footnote mark at the end is cut before labels are compared
    rows = p.select(X.norm_label(F.concat(raw, F.lit(" 1)"))).alias("exact")).withColumn("squashed", X.squash(F.col("exact")))
    labels = p.select(X.norm_label(name).alias("exact"), X.squash(name).alias("squashed"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("concept"))
    return facts.two_tier_lookup(rows, labels).groupBy("tier", "concept").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH y AS (SELECT o_custkey AS doc, year(o_orderdate) AS y, count(*) AS n FROM orders WHERE year(o_orderdate) >= 2000 GROUP BY ALL)
 SELECT doc, y AS year, CAST(1 AS INTEGER) AS ri, CAST(row_number() OVER (PARTITION BY doc ORDER BY y) AS INTEGER) AS ci FROM y""")
def header_detect(spark, sf):
    """Each customer's orders per year as a text grid: a title row, then the header, then counts. Years of
    20xx come first, so that their columns are numbered as in the SQL; the others stand right of them."""
    from pyspark.sql import Window

    per = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    col = F.row_number().over(Window.partitionBy("doc").orderBy(F.col("y") < 2000, "y"))
    cell = lambda r, t: F.struct(F.lit(r).alias("ri"), t.alias("text"))
    title = F.when(F.col("ci") == 1, F.lit("Orders by year")).otherwise(F.lit(""))
    cells = per.withColumn("ci", col).select("doc", "ci", F.inline(F.array(cell(0, title), cell(1, F.concat(F.col("y").cast("string"), F.lit(" 1"))), cell(2, F.concat(F.lit("12."), F.col("n").cast("string"))))))
    return grids.header_columns(cells).select("doc", F.col("year").cast("long").alias("year"), "ri", "ci")


@query("SELECT p.event_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts")
def nearest_above(spark, sf):
    e = table(spark, sf, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return grids.nearest_before(left, right, "user_id", "ts", ["click_id"]).select("event_id", F.col("found.click_id").alias("click_id"))


@query("""WITH i AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM events)
 SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, island ORDER BY ts) AS carried FROM i""")
def carry_forward(spark, sf):
    e = table(spark, sf, "events").withColumn("seen", F.when(F.col("event_type") == "view", F.col("value")))
    return grids.carry_forward(e, "user_id", [F.col("ts")], "seen", F.col("event_type") == "error", "carried").select("event_id", "carried")


@query("SELECT o_custkey AS cust, min(o_orderstatus) AS value, count(*) AS n_rows FROM orders GROUP BY ALL HAVING min(o_orderstatus) = max(o_orderstatus)")
def doc_scale_uniform(spark, sf):
    return grids.uniform(table(spark, sf, "orders").withColumnRenamed("o_custkey", "cust"), "cust", "o_orderstatus")


@query("""SELECT errors, count(*) AS n FROM (SELECT concat_ws(';', CASE WHEN text IS NULL THEN 'text: required' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'lang: not in enum' END, CASE WHEN NOT regexp_matches(source, '^src[0-9]$') THEN 'source: pattern' END) AS errors FROM documents) GROUP BY ALL""")
def contract_errors(spark, sf):
    out = sinks.contract_errors(table(spark, sf, "documents"), ["text"], {"lang": ["en", "de", "fr"]}, {"source": "^src[0-9]$"})
    return out.groupBy(F.concat_ws(";", "errors").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT flags, count(*) AS n FROM (SELECT concat_ws(';', CASE WHEN o_orderkey = 0 THEN 'missing_source_ref' END, CASE WHEN o_orderpriority LIKE '3%' THEN 'scale_arithmetic_mismatch:1000x' END,
 CASE WHEN year(o_orderdate) <> 1998 THEN 'header_period_mismatch' END, CASE WHEN o_orderstatus = 'P' THEN 'scale_inferred' END) AS flags FROM orders) GROUP BY ALL""")
def gate_flags(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    row = {
        "span": F.lit("as printed"), "page_no": F.col("o_orderkey"), "grounded": F.lit(True), "raw": F.format_number(cents, 0), "separator": F.lit("."), "scale": F.lit(1000), "sign_rule": F.lit("as_printed"),
        "value": F.when(F.col("o_orderpriority").like("3%"), cents * 1000000).otherwise(cents * 1000), "header_path": F.array(F.lit("FY 1998")), "period_end": F.col("o_orderdate"),
        "scale_source": F.when(F.col("o_orderstatus") == "P", "inferred").otherwise("table"), "period_basis": F.lit("audited"),
    }
    return table(spark, sf, "orders").groupBy(F.concat_ws(";", gates.flags(row)).alias("flags")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT page_id, CAST(length(regexp_extract_all(html, '<a\b[^>]*>')) AS INTEGER) AS n_links, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def page_tags(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.size(F.regexp_extract_all(h, F.lit(r"<a\b[^>]*>"), F.lit(0))).alias("n_links"), F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"))


@query(r"""WITH x AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a href="/([^"]+)"', 1))) AS code, lower(regexp_extract(html, '(?s)<article>(.*?)</article>', 1)) AS body FROM pages)
 SELECT page_id, count(*) AS n_codes, count(*) FILTER (contains(body, lower(code))) AS n_found, count(*) FILTER (contains(body, lower(code))) / count(*) >= 0.2 AS conclusive FROM x GROUP BY ALL""")
def index_reconcile(spark, sf):
    h = F.col("html")
    x = table(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract(h, "(?s)<article>(.*?)</article>", 1)).alias("body"), F.explode(F.array_distinct(F.regexp_extract_all(h, F.lit('<a href="/([^"]+)"'), F.lit(1)))).alias("code"))
    found = F.count_if(F.col("body").contains(F.lower("code")))
    return x.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_codes"), found.alias("n_found"), (found / F.count(F.lit(1)) >= 0.2).alias("conclusive"))


# Two series per nation: order value (as o) and the smaller part of urgent orders (as u), in whole units.
SERIES = """s AS (SELECT c_nationkey AS nation, part, year(o_orderdate) AS year, sum(CAST(round(o_totalprice) AS BIGINT)) AS value FROM orders JOIN customer ON o_custkey = c_custkey, (VALUES ('o'), ('u')) p(part) WHERE part = 'o' OR o_orderpriority LIKE '1%' GROUP BY ALL),
 e AS (SELECT nation, part, arg_min(value, year) AS first_value, arg_max(value, year) AS last_value, count(*) AS n_years, max(year) AS last_year FROM s GROUP BY ALL),
 ch AS (SELECT *, CASE WHEN n_years > 1 THEN round((last_value - first_value) / nullif(abs(first_value), 0) * 100, 6) END AS pct FROM e)"""


def _series(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    parts = F.explode(F.when(F.col("o_orderpriority").like("1%"), F.array(F.lit("o"), F.lit("u"))).otherwise(F.array(F.lit("o"))))
    sums = rows.select(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year"), F.round("o_totalprice").cast("long").alias("v"), parts.alias("part"))
    return signals.build_series(sums.groupBy("nation", "part", "year").agg(F.sum("v").alias("value")).withColumn("ord", F.lit(0)), ["nation", "part"])


@query(f"WITH {SERIES} SELECT nation, part, CAST(first_value AS BIGINT) AS first_value, CAST(last_value AS BIGINT) AS last_value, n_years, last_year, pct FROM ch")
def series_change(spark, sf):
    return signals.change(_series(spark, sf), ["nation", "part"])


@query(f"""WITH {SERIES} SELECT nation, 'opposite_trends' AS signal FROM ch a JOIN ch b USING (nation) WHERE a.part = 'u' AND a.pct < 0 AND b.part = 'o' AND b.pct > 0
 UNION ALL SELECT nation, 'dominant_untargeted' FROM ch a JOIN ch b USING (nation) WHERE a.part = 'o' AND b.part = 'u' AND b.last_value > 0 AND a.last_value >= 5 * b.last_value AND nation NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)
 UNION ALL SELECT nation, 'baseline_mismatch' FROM s JOIN (SELECT nation, first_value AS base FROM ch WHERE part = 'u') USING (nation) WHERE part = 'o' AND year = 1996 AND base <> 0 AND abs(base - value) > 0.1""")
def contradiction_signals(spark, sf):
    s = _series(spark, sf)
    c = signals.change(s, ["nation", "part"])
    targets = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("nation"), F.lit("o").alias("part"))
    base = c.where("part = 'u'").select("nation", F.lit("o").alias("part"), F.lit(1996).alias("year"), F.col("first_value").alias("base"))
    named = lambda df, n: df.select("nation", F.lit(n).alias("signal"))
    out = named(signals.opposite_trends(c, "nation", "part", "u", "o"), "opposite_trends")
    out = out.unionByName(named(signals.dominant_untargeted(c, "nation", "part", "o", "u", targets), "dominant_untargeted"))
    return out.unionByName(named(signals.baseline_mismatch(s, base, ["nation", "part"]).where("not matches"), "baseline_mismatch"))


@query("""WITH h AS (SELECT c_nationkey AS doc, c_custkey, max(CASE WHEN s_nationkey = c_nationkey THEN 1 ELSE 0 END) AS own, max(CASE WHEN s_nationkey <> c_nationkey THEN 1 ELSE 0 END) AS other
 FROM customer LEFT JOIN supplier ON abs(s_acctbal - c_acctbal) <= greatest(0.5, abs(c_acctbal) * 0.005) GROUP BY ALL)
 SELECT doc, count(*) AS n, sum(own) AS ceiling_hits, sum(other) AS floor_hits, round(avg(own), 6) AS ceiling, round(avg(other), 6) AS floor, grouping(doc) AS level FROM h GROUP BY ROLLUP (doc)""")
def coverage_ceiling_floor(spark, sf):
    gold = table(spark, sf, "customer").select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    held = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("doc"), F.col("s_acctbal").alias("value"))
    c = grids.coverage(gold, held)
    return c.rollup("doc").agg(F.count(F.lit(1)).alias("n"), F.sum("hit_own").alias("ceiling_hits"), F.sum("hit_other").alias("floor_hits"), F.round(F.avg("hit_own"), 6).alias("ceiling"), F.round(F.avg("hit_other"), 6).alias("floor"), F.grouping_id().alias("level"))


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+(?:-[a-z0-9]+)*')"
BM25 = f"""d AS (SELECT doc_id AS id, {_TOKENS} AS ts FROM documents), g AS (SELECT count(*) AS n, avg(length(ts)) AS avgdl FROM d),
 tf AS (SELECT id, term, length(ts) AS dl, count(*) AS tf FROM (SELECT id, ts, unnest(ts) AS term FROM d) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 q AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
 sc AS (SELECT qid, id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN tf USING (term) JOIN dfs USING (term), g GROUP BY ALL),
 lex AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 10)"""


def _lexical(spark, sf):
    docs, asked = table(spark, sf, "documents"), table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return retrieval.bm25_best(docs, asked, "doc_id", "text", 10)


@query(f"WITH {BM25} SELECT qid, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM lex")
def bm25_topk(spark, sf):
    return _lexical(spark, sf).select("qid", "id", F.round("score", 6).alias("score"), "rank")


# Queries of the dense searches: every vector whose id is divisible by 50, against all vectors.
DENSE = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id AS id, e, sqrt(list_dot_product(e, e)) AS size FROM v), q AS (SELECT * FROM u WHERE id % 50 = 0),
 den AS (SELECT q.id AS qid, u.id, list_dot_product(q.e, u.e) / (q.size * u.size) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.e, u.e) / (q.size * u.size), 8) DESC, u.id) AS rank FROM q, u WHERE round(list_dot_product(q.e, u.e) / (q.size * u.size), 8) > 0.2 QUALIFY rank <= 10)"""


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    size = F.sqrt(X.cosine(F.col("vec"), F.col("vec")))
    return e.withColumn("size", size).select("id", F.transform("vec", lambda x: x / F.col("size")).alias("vec"))


def _dense(spark, sf):
    v = _vectors(spark, sf)
    asked = v.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return retrieval.dense_best(asked, v, 10, 0.2)


@query(f"WITH {DENSE} SELECT qid, id, round(score, 8) AS score, CAST(rank AS INTEGER) AS rank FROM den")
def dense_topk(spark, sf):
    return _dense(spark, sf).select("qid", "id", "score", "rank")


@query(f"WITH {BM25}, {DENSE.replace(' q AS', ' q2 AS').replace('FROM q, u', 'FROM q2 q, u')} SELECT qid, id, round(sum(1.0 / (60 + rank)), 8) AS score FROM (SELECT qid, id, rank FROM lex UNION ALL SELECT qid, id, rank FROM den) GROUP BY ALL")
def rrf_fuse(spark, sf):
    return retrieval.rrf([_lexical(spark, sf), _dense(spark, sf)]).withColumn("score", F.round("score", 8))


_PICK = "SELECT qid, id, {n} AS pick FROM (SELECT c.*, row_number() OVER (PARTITION BY c.qid ORDER BY 0.5 * c.rel - 0.5 * coalesce({sim}, 0) DESC, c.rel DESC, c.id) AS r FROM cand c{join}) WHERE r = 1"
_SIM = "list_dot_product(c.vec, {0}.vec)"
MMR = f"""{DENSE}, cand AS (SELECT den.qid, den.id, round(den.score, 8) AS rel, list_transform(u.e, lambda x: x / u.size) AS vec FROM den JOIN u USING (id)),
 p1 AS ({_PICK.format(n=1, sim='0', join='')}), v1 AS (SELECT cand.* FROM cand JOIN p1 USING (qid, id)),
 p2 AS ({_PICK.format(n=2, sim=_SIM.format('v1'), join=' JOIN v1 ON v1.qid = c.qid AND v1.id <> c.id')}), v2 AS (SELECT cand.* FROM cand JOIN p2 USING (qid, id)),
 p3 AS ({_PICK.format(n=3, sim=f"greatest({_SIM.format('v1')}, {_SIM.format('v2')})", join=' JOIN v1 ON v1.qid = c.qid AND v1.id <> c.id JOIN v2 ON v2.qid = c.qid AND v2.id <> c.id')})"""


@query(f"WITH {MMR} SELECT qid, id, CAST(pick AS INTEGER) AS pick FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)")
def mmr_select(spark, sf):
    """Over every vector whose id is divisible by 50."""
    v = _vectors(spark, sf)
    asked = v.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    near = retrieval.dense_best(asked, v, 10, 0.2).join(v, "id").select("qid", "id", F.col("score").alias("rel"), "vec")
    return retrieval.mmr(near, 3, 0.5)


@query()
def dense_index(spark, sf):
    """The ten best of every vector whose id is divisible by 50, from the candidate index."""
    v = _vectors(spark, sf)
    asked = v.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return retrieval.ranked(retrieval.dense_candidates(asked, v), 10, 0.2)


@query()
def hybrid_search(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return retrieval.hybrid_search(table(spark, sf, "documents"), asked, "doc_id", "text")


@query(f"""WITH {BM25}, rel AS (SELECT DISTINCT b.item_id AS qid, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), n AS (SELECT qid, count(*) AS n_rel FROM rel GROUP BY qid),
 hit AS (SELECT qid, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1.0)) AS dcg FROM lex JOIN rel USING (qid, id) GROUP BY qid)
 SELECT n.qid, round(coalesce(hits, 0) / n_rel, 6) AS recall, coalesce(hits, 0) / 10 AS precision, coalesce(1 / first, 0) AS rr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_rel, 10) + 1), lambda i: 1 / log2(i + 1.0))), 6) AS ndcg FROM n LEFT JOIN hit USING (qid)""")
def retrieval_metrics(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    held = retrieval.holding(table(spark, sf, "documents"), items, "doc_id", "text")
    out = retrieval.retrieval_metrics(_lexical(spark, sf), held, 10)
    return out.withColumns({c: F.round(c, 6) for c in ("recall", "ndcg")})


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n{2,}', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM documents)
 SELECT doc_id, CAST(length(ss) AS INTEGER) AS n_sentences, CAST(list_sum(list_transform(ss, lambda x: greatest(1, (length(x) + 3) // 4))) AS BIGINT) AS n_tokens FROM s""")
def sentence_stats(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", X.sentences(F.col("text")).alias("ss"))
    total = F.aggregate(F.transform("ss", X.estimate_tokens), F.lit(0).cast("long"), lambda a, x: a + x)
    # as SQL has it: no text has no number of sentences, no sentence no sum of tokens
    n = F.when(F.col("ss").isNotNull(), F.size("ss"))
    return s.select("doc_id", n.alias("n_sentences"), F.when(n > 0, total).alias("n_tokens"))


@query()
def chunk_stats(spark, sf):
    c = chunks.chunk_documents(table(spark, sf, "documents"), "doc_id", "text")
    return c.groupBy("id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("tokens").alias("most_tokens"), F.sum("tokens").alias("tokens"))


@query()
def context_pack(spark, sf):
    """The ten best documents of each test item, packed into 2,000 tokens."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    # ten rows an item, written first: they go to the documents, which stay where they are
    best = staged(_lexical(spark, sf)).join(docs, "id").withColumn("tokens", X.estimate_tokens(F.col("text")))
    return chunks.pack(best, "qid", [F.col("rank")], 2000)


@query("""SELECT o_custkey, o_orderstatus, side, CAST(abs(n) AS BIGINT) AS n FROM (SELECT o_custkey, o_orderstatus, CASE WHEN sum(s) > 0 THEN 'gold' ELSE 'predicted' END AS side, sum(s) AS n FROM (SELECT o_custkey, o_orderstatus, 1 AS s FROM orders
 UNION ALL SELECT o_custkey, CASE WHEN o_custkey % 7 = 0 AND o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END, -1 FROM orders WHERE o_orderpriority NOT LIKE '5%' OR o_custkey % 3 > 0) GROUP BY 1, 2 HAVING sum(s) <> 0)""")
def rowset_equivalence(spark, sf):
    """The prediction leaves out some orders and reads pending ones of some customers as open."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_custkey")
    seen = o.where(~F.col("o_orderpriority").like("5%") | (k % 3 > 0)).withColumn("o_orderstatus", F.when((k % 7 == 0) & (F.col("o_orderstatus") == "P"), "O").otherwise(F.col("o_orderstatus")))
    return rowsets.difference(o.drop("o_orderpriority"), seen.drop("o_orderpriority"))


_SO_FAR = "SELECT *, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS n_so_far, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS turn FROM events"


@query(f"SELECT event_id, n_so_far FROM ({_SO_FAR}) WHERE n_so_far > 2")
def loop_detect(spark, sf):
    return traces.repeats(table(spark, sf, "events"), "user_id", ["event_type"], ["ts"]).where("n_so_far > 2").select("event_id", "n_so_far")


@query(f"SELECT event_id, round(spent, 6) AS spent_before FROM ({_SO_FAR}) WHERE spent < 100")
def budget_cut(spark, sf):
    out = traces.spent_before(table(spark, sf, "events"), "user_id", F.col("value"), ["ts"])
    return out.where("spent_before < 100").select("event_id", F.round("spent_before", 6).alias("spent_before"))


@query(f"""WITH r AS (SELECT *, CASE WHEN spent >= 100 THEN 'BUDGET_EXCEEDED' WHEN n_so_far > 4 THEN 'LOOP_DETECTED' WHEN turn > 8 THEN 'MAX_TURNS' END AS why FROM ({_SO_FAR}))
 SELECT user_id, coalesce(arg_min(why, turn) FILTER (why IS NOT NULL), 'COMPLETED') AS reason, CAST(min(turn) FILTER (why IS NOT NULL) AS INTEGER) AS stop_turn, CAST(max(turn) AS INTEGER) AS turns FROM r GROUP BY user_id""")
def stop_reason(spark, sf):
    return traces.stop_reasons(table(spark, sf, "events"), "user_id", ["ts"], ["event_type"], F.col("value"), 4, 100, 8)


@query("""WITH g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS grp FROM events)
 SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n_failures, count(*) >= 3 AS opens FROM g WHERE event_type = 'error' GROUP BY user_id, grp""")
def breaker_streaks(spark, sf):
    return traces.failure_streaks(table(spark, sf, "events"), "user_id", "ts", F.col("event_type") == "error", 3)


@query("SELECT source AS local_path, max(doc_id) AS bytes, 'new' AS origin FROM documents WHERE lang = 'de' GROUP BY ALL UNION ALL SELECT source, min(doc_id), 'old' FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'de') GROUP BY ALL")
def manifest_upsert(spark, sf):
    d = table(spark, sf, "documents")
    old = d.groupBy(F.col("source").alias("local_path")).agg(F.min("doc_id").alias("bytes")).withColumn("origin", F.lit("old"))
    new = d.where("lang = 'de'").groupBy(F.col("source").alias("local_path")).agg(F.max("doc_id").alias("bytes")).withColumn("origin", F.lit("new"))
    return sinks.upsert(old, new, "local_path", "bytes")


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) FILTER (event_id % 5 <> 4) AS BIGINT) AS total, count(*) AS n, count(*) FILTER (event_id % 5 = 4) AS n_broken FROM events GROUP BY ALL")
def json_props(spark, sf):
    """Answers around each event's JSON: fenced, among words, with braces in strings, bare, or cut off."""
    kind, p = F.col("event_id") % 5, F.col("props")
    answer = (
        F.when(kind == 0, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```\nas asked {1}")))
        .when(kind == 1, F.concat(F.lit("sure "), p, F.lit(" and more }")))
        .when(kind == 2, F.regexp_replace(p, r"^\{", '{"note": "a } in { a string", '))
        .when(kind == 3, p)
        .otherwise(F.substring(p, 1, 4))
    )
    k = F.from_json(X.extract_json(answer), "k long")["k"]
    return table(spark, sf, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("k").isNull()).alias("n_broken"))


_STATEMENT = """CASE doc_id % 8 WHEN 0 THEN 'Select ' || doc_id WHEN 1 THEN '-- drop table x' || chr(10) || 'select 1' WHEN 2 THEN 'select 1; drop table ' || source WHEN 3 THEN '/* it is; insert ' || chr(10) || ' */ WITH a AS (SELECT 1) SELECT * FROM a ; '
 WHEN 4 THEN 'DELETE FROM ' || source WHEN 5 THEN 'select replace(''a'', ''b'', ''c'')' WHEN 6 THEN 'with ' || text ELSE '--' || text END"""


@query(rf"""WITH s AS (SELECT doc_id % 8 AS kind, {_STATEMENT} AS s FROM documents), b AS (SELECT kind, regexp_replace(regexp_replace(regexp_replace(s, '(?s)/\*.*?\*/', ' ', 'g'), '--[^\n]*', ' ', 'g'), '^\s+|[\s;]+$', '', 'g') AS bare FROM s)
 SELECT kind, bare <> '' AND NOT contains(bare, ';') AND regexp_matches(bare, '(?i)^(select|with)\b') AND NOT regexp_matches(bare, '(?i)\b(insert|update|delete|drop|alter|create|truncate|attach|pragma|replace|grant|vacuum)\b') AS safe, count(*) AS n FROM b GROUP BY ALL""")
def safe_sql(spark, sf):
    d = table(spark, sf, "documents")
    s = F.expr(_STATEMENT.replace("''", "\\'").replace("chr(10)", "char(10)"))
    return d.groupBy((F.col("doc_id") % 8).alias("kind"), X.is_safe_select(s).alias("safe")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT quality AS a, 1 - toxic AS b FROM labels), s AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS po, avg(CAST(a AS DOUBLE)) AS pa, avg(CAST(b AS DOUBLE)) AS pb FROM l)
 SELECT n, round(po, 6) AS observed, round(pa * pb + (1 - pa) * (1 - pb), 6) AS expected, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM s""")
def kappa(spark, sf):
    l_ = table(spark, sf, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return traces.cohen_kappa(l_, "a", "b").withColumns({c: F.round(c, 6) for c in ("observed", "expected")})


from factloom.plans import documents, runs  # noqa: E402, F401  they register the other queries

__all__ = ["ORACLES", "QUERIES"]
