"""Queries over documents made of the tables: each customer is one with statements by year, each nation a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import claims, disclosures, extraction, gates, grids, labels, rules, truth
from factloom.plans.registry import query, table
from factloom.sources.stage import staged

# A customer's years, moved to 2015-2021 as header cells know 20xx: sums of finished, open and pending orders in whole
# units, number of orders, place of the year among the customer's.
YEARS = """yrs AS (SELECT o_custkey AS doc, year(o_orderdate) + 20 AS y, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice) AS BIGINT) END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN CAST(round(o_totalprice) AS BIGINT) END) AS o,
 sum(CASE WHEN o_orderstatus = 'P' THEN CAST(round(o_totalprice) AS BIGINT) END) AS p, count(*) AS n FROM orders GROUP BY ALL),
 years AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY y) AS ci, count(*) OVER (PARTITION BY doc) AS n_years FROM yrs)"""


def _years(spark, sf) -> DataFrame:
    whole = F.round("o_totalprice").cast("long")
    of = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, whole))
    y = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc"), (F.year("o_orderdate") + 20).alias("y")).agg(of("F").alias("f"), of("O").alias("o"), of("P").alias("p"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("doc")
    return staged(y.withColumns({"ci": F.row_number().over(w.orderBy("y")), "n_years": F.count(F.lit(1)).over(w)}))


PROFILE = extraction.Profile(
    separator=".",
    scale_pattern=r"([A-Z]{3})\s+(million|Tsd)",
    scales={"million": 1_000_000, "Tsd": 1_000},
    sections=[("Income statement", "income_statement"), ("Balance sheet", "balance_sheet")],
    labels=[("Revenue", "ifrs-full:Revenue", "income_statement"), ("Operating cost", "ifrs-full:OperatingExpense", "income_statement"), ("Other income", "ifrs-full:OtherIncome", "income_statement"), ("Total assets", "ifrs-full:Assets", "balance_sheet")],
    flips={"ifrs-full:OperatingExpense"},
)


def statements(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tables, cells, texts): an income statement on two pages, the second without a heading; a balance sheet; a table of
    other years that belongs to nothing. Where and how the scale is stated depends on the customer's number."""
    y = _years(spark, sf)
    d = F.col("doc")
    shown = lambda c: F.coalesce(F.format_number(c, 0), F.lit(""))
    mark = F.when((d % 4 == 0) & (F.col("ci") == 1), F.concat(F.col("y").cast("string"), F.lit(" 1"))).otherwise(F.col("y").cast("string"))
    cell = lambda t, r, text: F.struct(F.lit(t).alias("table_ord"), F.lit(r).alias("ri"), text.alias("text"))
    cost = F.when(F.col("o").isNull(), F.lit("")).otherwise(F.concat(F.lit("("), F.format_number("o", 0), F.lit(")")))
    nil = F.coalesce(F.format_number("p", 0), F.lit("–"))
    body = [cell(0, 0, mark), cell(0, 1, shown(F.col("f"))), cell(0, 2, cost), cell(0, 3, shown(F.col("n"))), cell(1, 0, F.col("y").cast("string")), cell(1, 1, nil), cell(2, 0, F.col("y").cast("string")), cell(2, 1, shown(F.col("n") * 7))]
    body.append(cell(3, 0, F.when(F.col("ci") < F.col("n_years"), F.col("y").cast("string")).otherwise("")))
    right = y.select("doc", "ci", F.inline(F.array(*body)))
    heads = {(0, 1): "Revenue 1)", (0, 2): "OPERATING  COST", (0, 3): "REVENUE", (1, 0): "1. January 2016", (1, 1): "Other income", (2, 0): "", (2, 1): "Totalassets", (3, 0): ""}
    docs = y.select("doc", "n_years").distinct()
    first = F.when(d % 3 == 2, "Figures (USD million)").otherwise("")
    left = docs.select("doc", F.lit(0).alias("ci"), F.inline(F.array(cell(0, 0, first), *[cell(t, r, F.lit(x)) for (t, r), x in heads.items()])))
    cells = right.unionByName(left)
    rows = {0: (1, 4), 1: (2, 2), 2: (3, 2), 3: (5, 1)}
    tables = docs.select("doc", F.inline(F.array(*[F.struct(F.lit(t).alias("table_ord"), F.lit(p).alias("page_no"), F.lit(500.0).alias("top"), F.lit(n).alias("n_rows"), (F.col("n_years") + 1).cast("int").alias("n_cols")) for t, (p, n) in rows.items()])))
    text = lambda o, p, top, label, t: F.struct(F.lit(o).alias("ord"), F.lit(p).alias("page_no"), F.lit(float(top)).alias("top"), F.lit(label).alias("label"), t.alias("text"))
    stated = F.when(d % 3 == 0, "Amounts in (USD million)").otherwise("Amounts as shown")
    late = F.when(d % 3 == 1, "In EUR Tsd").otherwise("See above")
    third = F.when(d % 3 == 2, "In EUR Tsd").otherwise("See above")
    note = F.when(d % 8 == 0, "1) Restated after the audit").otherwise("1 January is a holiday")
    parts = [text(0, 1, 700, "section_header", F.lit("Balance sheet")), text(1, 1, 600, "section_header", F.lit("Income statement 2021")), text(2, 1, 400, "section_header", F.lit("Balance sheet")), text(3, 1, 550, "text", stated), text(4, 1, 20, "footnote", note), text(5, 3, 600, "section_header", F.lit("Balance sheet")), text(6, 3, 550, "text", third), text(7, 9, 550, "text", late)]
    # as if read from files: the operators go over cells several times
    return tables, staged(cells), docs.select("doc", F.inline(F.array(*parts)))


_LINES = f"""{YEARS}, lines AS (
 SELECT doc, y, ci, n_years, 0 AS t, 1 AS page, 4 AS n_rows, 1 AS ri, 'ifrs-full:Revenue' AS concept, f AS v, false AS nil FROM years WHERE f IS NOT NULL
 UNION ALL SELECT doc, y, ci, n_years, 0, 1, 4, 3, 'ifrs-full:Revenue', n, false FROM years WHERE doc NOT IN (SELECT doc FROM years WHERE f IS NOT NULL)
 UNION ALL SELECT doc, y, ci, n_years, 0, 1, 4, 2, 'ifrs-full:OperatingExpense', o, false FROM years WHERE o IS NOT NULL
 UNION ALL SELECT doc, y, ci, n_years, 1, 2, 2, 1, 'ifrs-full:OtherIncome', p, p IS NULL FROM years WHERE doc % 3 <> 2
 UNION ALL SELECT doc, y, ci, n_years, 2, 3, 2, 1, 'ifrs-full:Assets', n * 7, false FROM years)"""


@query(f"""WITH {_LINES} SELECT doc, substr(sha256(doc || '|' || page || '|p' || page || '-' || n_rows || 'x' || (n_years + 1) || '|' || ri || '|' || ci), 1, 32) AS fact_id, concept, CASE WHEN t = 2 THEN 'balance_sheet' ELSE 'income_statement' END AS statement,
 CASE WHEN t = 1 THEN 'continuation' ELSE 'heading' END AS section_source, CASE WHEN t = 2 THEN NULL ELSE make_date(y, 1, 1) END AS period_start, make_date(y, 12, 31) AS period_end, CASE WHEN nil THEN NULL ELSE CAST(v AS DOUBLE) * CASE WHEN doc % 3 = 0 THEN 1000000 WHEN doc % 3 = 1 THEN 1000 WHEN t = 0 THEN 1000000 ELSE 1000 END END AS value, nil AS is_nil,
 CASE WHEN doc % 3 = 0 AND t = 0 THEN 'statement_header' WHEN doc % 3 = 2 AND t = 0 THEN 'column_header' WHEN doc % 3 = 2 THEN 'statement_header' ELSE 'document_uniform' END AS scale_source, CASE WHEN doc % 3 = 0 OR (doc % 3 = 2 AND t = 0) THEN 'USD' ELSE 'EUR' END AS currency,
 CASE WHEN concept LIKE '%Expense' THEN 'taxonomy_balance' ELSE 'as_printed' END AS sign_rule, CASE WHEN doc % 8 = 0 AND ci = 1 AND t = 0 THEN 'restated' ELSE 'audited' END AS period_basis, ci > 1 AS is_comparative FROM lines""")
def fact_rows(spark, sf):
    facts, _ = extraction.extract(*statements(spark, sf), PROFILE)
    return facts.select("doc", "fact_id", "concept", "statement", "section_source", "period_start", "period_end", F.col("value").cast("double").alias("value"), "is_nil", "scale_source", "currency", "sign_rule", "period_basis", "is_comparative")


@query(f"""WITH {YEARS}, d AS (SELECT doc, any_value(n_years) AS n_years, count(f) AS fs, count(o) AS os FROM years GROUP BY doc)
 SELECT doc, reason, n FROM (SELECT doc, 'no_scale' AS reason, 1::BIGINT AS n FROM d WHERE doc % 3 = 2 UNION ALL SELECT doc, 'no_section', 1 FROM d WHERE n_years > 1
 UNION ALL SELECT doc, 'dup_label', 1 FROM d WHERE fs > 0 UNION ALL SELECT doc, 'empty_row', CAST(fs = 0 AS BIGINT) + CAST(os = 0 AS BIGINT) FROM d WHERE fs = 0 OR os = 0)""")
def claim_guards(spark, sf):
    _, guards = extraction.extract(*statements(spark, sf), PROFILE)
    return guards


@query(f"""WITH {YEARS} SELECT doc, CAST(ci + n_years * k AS INTEGER) AS ci, y AS year, CASE WHEN doc % 2 = 0 THEN CASE k WHEN 0 THEN 'market' ELSE 'place' END WHEN k = 0 THEN 'operational control' ELSE 'equity' END AS "group", contains(CASE WHEN ci = n_years AND doc % 5 = 0 THEN 'target' ELSE '' END, 'target') AS is_target FROM years, (VALUES (0), (1)) s(k)""")
def header_groups(spark, sf):
    """Each customer's years twice, side by side, under two group titles or under none."""
    y = _years(spark, sf)
    d = F.col("doc")
    label = F.concat(F.when((F.col("ci") == F.col("n_years")) & (d % 5 == 0), "Target ").otherwise("Year "), F.col("y").cast("string"))
    cells = []
    for k in (0, 1):
        title = F.when(d % 2 == 0, ("Market", "Place")[k]).otherwise("")
        cells += [F.struct((F.col("ci") + k * F.col("n_years")).cast("int").alias("ci"), F.lit(r).alias("ri"), t.alias("text")) for r, t in ((0, title), (1, label))]
    grid = y.select("doc", F.inline(F.array(*cells)))
    heads = grids.header_columns(grid, bare=False)
    return extraction.column_groups(heads, grid, ["doc"]).select("doc", "ci", F.col("year").cast("long").alias("year"), "group", "is_target")


# Facts of the rules: two taxonomies, by customer and year, with defects by the customer's number.
_SUMS = f"{YEARS}, v AS (SELECT doc AS k, y, coalesce(f, 0) AS a, coalesce(o, 0) AS b, coalesce(p, 0) AS c FROM years)"


def rule_facts(spark, sf) -> DataFrame:
    v = _years(spark, sf).select(F.col("doc").alias("owner"), "y", *(F.coalesce(x, F.lit(0).cast("long")).alias(n) for x, n in (("f", "a"), ("o", "b"), ("p", "c"))))
    k, a, b, c = (F.col(x) for x in ("owner", "a", "b", "c"))
    off = F.when(k % 5 == 0, 10).otherwise(0)
    fact = lambda concept, value, when=None, accn="x", unit="USD": F.when(F.lit(True) if when is None else when, F.struct(F.lit(concept).alias("concept"), value.cast("decimal(38,6)").alias("value"), F.lit(accn).alias("accn"), (unit if not isinstance(unit, str) else F.lit(unit)).alias("unit")))
    us = [
        fact("Revenues", a + b + c), fact("CostsAndExpenses", b), fact(rules._PRETAX, a + c + off), fact("IncomeTaxExpenseBenefit", F.when(k % 7 == 0, -c).otherwise(c)),
        fact("ProfitLoss", a, k % 3 != 0), fact("ProfitLoss", a, k % 3 == 0, "w"), fact("NetIncomeLoss", a, F.col("y") % 2 == 0), fact("NetIncomeLossAttributableToNoncontrollingInterest", F.lit(0)),
    ]
    ifrs = [
        fact("ProfitLossBeforeTax", a + c), fact("IncomeTaxExpenseContinuingOperations", c), fact("ProfitLoss", F.when(k % 5 == 0, a + b).otherwise(a)), fact("ProfitLossFromDiscontinuedOperations", b, k % 5 == 0),
        fact("CashFlowsFromUsedInOperatingActivities", a), fact("CashFlowsFromUsedInInvestingActivities", b), fact("CashFlowsFromUsedInFinancingActivities", c, unit=F.when(k % 13 == 0, "EUR").otherwise("USD")),
        fact("EffectOfExchangeRateChangesOnCashAndCashEquivalents", F.lit(0), k % 3 == 0), fact("IncreaseDecreaseInCashAndCashEquivalents", a + b + c), fact("IncreaseDecreaseInCashAndCashEquivalentsBeforeEffectOfExchangeRateChanges", a + b + c),
        fact("RevenueFromContractsWithCustomers", a), fact("Revenue", F.when(k % 7 == 0, a - 10).otherwise(a + b)),
    ]
    kind = F.when(k % 2 == 0, "us-gaap").otherwise("ifrs-full")
    parts = F.array_compact(F.when(k % 2 == 0, F.array(*us)).otherwise(F.array(*ifrs)))
    rows = v.select("owner", "y", kind.alias("taxonomy"), F.inline(parts))
    start = F.make_date("y", F.when(F.col("owner") % 11 == 0, 7).otherwise(1), F.lit(1))
    return rows.select("owner", "taxonomy", "concept", "unit", start.alias("period_start"), F.make_date("y", F.lit(12), F.lit(31)).alias("period_end"), "accn", F.make_date(F.col("y") + 1, F.lit(3), F.lit(1)).alias("filed"), "value", F.lit(0.5).alias("tol"))


_RULED = f"""WITH {_SUMS}, d AS (SELECT *, CASE WHEN k % 5 = 0 THEN 10 ELSE 0 END AS off, CASE WHEN k % 7 = 0 THEN -1 ELSE 1 END AS s, k % 11 = 0 AS mid FROM v),
 r AS (SELECT k, y, 'us-gaap' AS taxonomy, 'balance_sheet' AS identity, NULL AS status, NULL AS suspect FROM d WHERE false
 UNION ALL SELECT k, y, 'us-gaap', 'income_before_tax', CASE WHEN mid OR y < 2017 THEN 'N/A' WHEN off > 1.5 THEN 'FAIL' ELSE 'PASS' END,
  CASE WHEN NOT mid AND y >= 2017 AND off > 1.5 THEN CASE WHEN abs(-off - 2 * (a + b + c)) <= 1.5 THEN 'Revenues' WHEN abs(-off + 2 * b) <= 1.5 THEN 'CostsAndExpenses' END END FROM d WHERE k % 2 = 0
 UNION ALL SELECT k, y, 'us-gaap', 'profit_after_tax', CASE WHEN mid THEN 'N/A' WHEN k % 3 = 0 THEN 'SKIP' WHEN abs(c + off - s * c) > 1.5 THEN 'FAIL' ELSE 'PASS' END,
  CASE WHEN NOT mid AND k % 3 <> 0 AND abs(c + off - s * c) > 1.5 THEN CASE WHEN abs(c + off - s * c - 2 * (a + c + off)) <= 1.5 THEN 'pretax' WHEN abs(c + off + s * c) <= 1.5 THEN 'IncomeTaxExpenseBenefit' END END FROM d WHERE k % 2 = 0
 UNION ALL SELECT k, y, 'us-gaap', 'net_income_split', CASE WHEN mid THEN 'N/A' WHEN y % 2 = 1 OR k % 3 = 0 THEN 'SKIP' ELSE 'PASS' END, NULL FROM d WHERE k % 2 = 0
 UNION ALL SELECT k, y, 'us-gaap', 'cash_flow_roll', CASE WHEN mid THEN 'N/A' ELSE 'SKIP' END, NULL FROM d WHERE k % 2 = 0
 UNION ALL SELECT k, y, 'ifrs-full', 'profit_after_tax', CASE WHEN mid THEN 'N/A' ELSE 'PASS' END, NULL FROM d WHERE k % 2 = 1
 UNION ALL SELECT k, y, 'ifrs-full', 'profit_after_tax', CASE WHEN mid THEN 'N/A' ELSE 'PASS' END, NULL FROM d WHERE k % 2 = 1 AND (mid OR (k % 5 = 0 AND b <= 1.5))
 UNION ALL SELECT k, y, 'ifrs-full', 'net_income_split', CASE WHEN mid THEN 'N/A' ELSE 'SKIP' END, NULL FROM d WHERE k % 2 = 1
 UNION ALL SELECT k, y, 'ifrs-full', 'cash_flow_roll', CASE WHEN mid THEN 'N/A' WHEN k % 3 <> 0 OR k % 13 = 0 THEN 'SKIP' ELSE 'PASS' END, NULL FROM d WHERE k % 2 = 1
 UNION ALL SELECT k, y, 'ifrs-full', 'cash_flow_roll_pre_fx', CASE WHEN mid THEN 'N/A' WHEN k % 13 = 0 THEN 'SKIP' ELSE 'PASS' END, NULL FROM d WHERE k % 2 = 1 AND (mid OR k % 3 <> 0)
 UNION ALL SELECT k, y, 'ifrs-full', 'revenue_subset', CASE WHEN mid THEN 'N/A' WHEN k % 7 = 0 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN NOT mid AND k % 7 = 0 AND abs(10 - 2 * a) <= 1.0 THEN 'RevenueFromContractsWithCustomers' END FROM d WHERE k % 2 = 1)"""


@query(f"""{_RULED} SELECT identity, taxonomy, y AS year, coalesce(suspect, '') AS suspect, count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'FAIL') AS fail, count(*) FILTER (status = 'WARN') AS warn, count(*) FILTER (status = 'SKIP') AS skip, count(*) FILTER (status = 'N/A') AS na FROM r GROUP BY ALL""")
def identity_rules(spark, sf):
    out = rules.check_rules(rule_facts(spark, sf))
    named = out.withColumn("suspect", F.coalesce(F.when(F.col("suspect") == rules._PRETAX, "pretax").otherwise(F.col("suspect")), F.lit(""))).withColumn("year", F.year("period_end"))
    return rules.status_counts(named, ["identity", "taxonomy", "year", "suspect"])


@query("""SELECT CASE WHEN m BETWEEN 11 AND 13 THEN 'annual' ELSE 'interim_' || m || 'm' END AS kind, count(*) AS n FROM (SELECT CAST(round_even(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) / 30.44, 0) AS INTEGER) AS m FROM orders GROUP BY o_custkey, year(o_orderdate)) GROUP BY ALL""")
def period_kinds(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return o.groupBy(rules.period_kind(F.col("a"), F.col("b")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_SUMS}, bal AS (SELECT *, sum(a + b + c) OVER (PARTITION BY k ORDER BY y) AS closing FROM v), s AS (SELECT n.k, n.y, n.k % 4 = 1 AND o.k IS NOT NULL AS own, CASE WHEN o.k IS NULL THEN 'SKIP' WHEN abs(n.closing - o.closing - n.a - n.b) <= 1.5 THEN 'PASS' ELSE 'WARN' END AS status FROM bal n LEFT JOIN bal o ON o.k = n.k AND o.y = n.y - 1 WHERE n.k % 2 = 1)
 SELECT y AS year, status, CASE WHEN status = 'SKIP' THEN '' WHEN own THEN 'preferred' ELSE 'second' END AS which, count(*) AS n FROM s GROUP BY ALL""")
def cash_preferences(spark, sf):
    """Closing balances of odd customers against their change, which leaves pending orders out; every other one states the
    preferred balance too, from which the second differs."""
    v = _years(spark, sf).where("doc % 2 = 1").select(F.col("doc").alias("owner"), "y", *(F.coalesce(x, F.lit(0).cast("long")).alias(n) for x, n in (("f", "a"), ("o", "b"), ("p", "c"))))
    bal = v.withColumn("closing", F.sum(F.col("a") + F.col("b") + F.col("c")).over(Window.partitionBy("owner").orderBy("y")))
    (first, second), moved = rules.CASH["ifrs-full"]
    own = F.col("owner") % 4 == 1
    row = lambda concept, value, start, when: F.when(when, F.struct(F.lit(concept).alias("concept"), value.cast("decimal(38,6)").alias("value"), start.alias("period_start")))
    none, begin = F.lit(None).cast("date"), F.make_date("y", F.lit(1), F.lit(1))
    parts = [row(first, F.col("closing"), none, own), row(second, F.col("closing") + F.when(own, 77 * F.col("y")).otherwise(0), none, F.lit(True)), row(moved, F.col("a") + F.col("b"), begin, F.lit(True))]
    facts = bal.select("owner", "y", F.inline(F.array_compact(F.array(*parts)))).select("owner", F.lit("ifrs-full").alias("taxonomy"), "concept", F.lit("USD").alias("unit"), "period_start", F.make_date("y", F.lit(12), F.lit(31)).alias("period_end"), F.lit("x").alias("accn"), F.lit("2022-03-01").cast("date").alias("filed"), "value", F.lit(0.5).alias("tol"))
    out = rules.cash_continuity(facts)
    which = F.when(F.col("balance_concept") == first, "preferred").when(F.col("balance_concept") == second, "second").otherwise("")
    return out.groupBy(F.year("period_end").alias("year"), "status", which.alias("which")).agg(F.count(F.lit(1)).alias("n"))


def gate_rows(spark, sf) -> DataFrame:
    """A row an order, as extracted, with defects by the order's number."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_orderstatus").alias("st"), F.round("o_totalprice").cast("long").alias("v"), F.to_date("o_orderdate").alias("period_end"))
    k = F.col("doc")
    shown = F.format_number("v", 0)
    rows = o.select(
        "doc",
        F.when(k % 9 == 0, "us-gaap:Revenues:x").when(k % 9 == 1, "Revenues").when(k % 9 == 2, "esrs:E1").otherwise("ifrs-full:Revenue").alias("concept"),
        F.when(F.col("st") == "P", "balance_sheet").otherwise("income_statement").alias("statement"),
        F.trunc("period_end", "year").alias("period_start"),
        "period_end",
        F.when(F.col("st") == "O", F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown).alias("raw"),
        F.lit(".").alias("separator"),
        F.lit(1000).alias("scale"),
        F.when(F.col("st") == "O", "taxonomy_balance").otherwise("as_printed").alias("sign_rule"),
        (F.col("v") * 1000).cast("decimal(38,6)").alias("value"),
        shown.alias("span"),
        F.lit(3).alias("page_no"),
        F.lit(True).alias("grounded"),
        F.array(F.lit("statement"), F.year("period_end").cast("string")).alias("header_path"),
        F.when(k % 6 == 0, "inferred").otherwise("column_header").alias("scale_source"),
        F.when(k % 10 == 0, "restated").otherwise("audited").alias("period_basis"),
    )
    for i, d in enumerate(gates.DEFECTS):
        rows = gates.inject(rows, d, (k % 31 == i) & (F.col("statement") != "balance_sheet"))
    return rows


_GATED = """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS st, CAST(round(o_totalprice) AS BIGINT) AS v, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE o_orderkey % 31 END AS d FROM orders),
 f AS (SELECT *, list_filter([CASE WHEN d = 5 THEN 'missing_source_ref' END, CASE WHEN d = 6 THEN 'groundedness_failed' END, CASE WHEN d = 0 AND v <> 0 THEN 'scale_arithmetic_mismatch:1000x' END, CASE WHEN d = 3 THEN 'header_period_mismatch' END,
  CASE WHEN k % 6 = 0 THEN 'scale_inferred' END, CASE WHEN k % 10 = 0 THEN 'restated' END, CASE WHEN d = 4 THEN 'hallucinated_span' END], lambda x: x IS NOT NULL) AS flags FROM o)"""


def _gated(spark, sf) -> DataFrame:
    rows = gate_rows(spark, sf)
    # the document prints its number, a wrong one where the extractor's is consistent but wrong, which only rules can find
    spans = rows.select("doc", F.concat(F.lit("<html><p>Total <b>"), F.when(F.col("span") != "999,999", F.col("span")).otherwise(F.col("raw")), F.lit("</b></p>")).alias("text"))
    return gates.gate(rows, spans)


@query(f"{_GATED} SELECT array_to_string(flags, ';') AS flags, count(*) AS n FROM f GROUP BY ALL")
def gate_extraction(spark, sf):
    return _gated(spark, sf).groupBy(F.array_join("flags", ";").alias("flags")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_GATED}, b AS (SELECT *, list_filter(flags, lambda x: NOT starts_with(x, 'scale_inferred') AND NOT starts_with(x, 'restated')) AS blocking FROM f)
 SELECT reason, count(*) AS n FROM (SELECT string_split(unnest(blocking), ':')[1] AS reason FROM b UNION ALL SELECT CASE k % 9 WHEN 1 THEN 'not_canonical' ELSE 'other_taxonomy' END FROM b WHERE len(blocking) = 0 AND k % 9 <= 2) GROUP BY ALL""")
def gate_blocking(spark, sf):
    return gates.gate_report(_gated(spark, sf))


# Scorecard of nations: facts are orders, truth their lines (see the comparison queries), labels and cells by nation.
@query("""WITH t AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY 1),
 o AS (SELECT o_orderkey AS k, c_nationkey AS doc, o_orderstatus AS st, substr(o_orderpriority, 1, 1) AS p, t.v FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN t ON t.k = o_orderkey),
 c AS (SELECT CAST(doc AS VARCHAR) AS doc, count(*) FILTER (st <> 'P') AS facts_extracted, count(*) FILTER (st <> 'P' AND v IS NOT NULL) AS facts_comparable, count(*) FILTER (st <> 'P' AND v IS NOT NULL AND p <> '2') AS facts_exact, count(v) AS gt_total, count(v) FILTER (p <> '5') AS gt_inscope, count(v) FILTER (p <> '5' AND st <> 'P') AS gt_caught,
  count(*) FILTER (st = 'F') AS numeric_cells, count(DISTINCT p) AS labels, count(*) FILTER (st = 'P') AS guard_no_scale, round(avg(CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0 END), 4) AS chance_floor FROM o GROUP BY ALL),
 a AS (SELECT * FROM c UNION ALL SELECT 'TOTAL', sum(facts_extracted), sum(facts_comparable), sum(facts_exact), sum(gt_total), sum(gt_inscope), sum(gt_caught), sum(numeric_cells), sum(labels), sum(guard_no_scale), NULL FROM c)
 SELECT doc, CAST(facts_extracted AS BIGINT) AS facts_extracted, CAST(gt_caught AS BIGINT) AS gt_caught, CAST(labels AS BIGINT) AS labels, round(facts_exact / facts_comparable, 4) AS precision, round(facts_comparable / facts_extracted, 4) AS verifiability, round(gt_caught / gt_inscope, 4) AS recall_inscope, round(gt_caught / gt_total, 4) AS coverage_filing, round(facts_exact / facts_comparable * facts_comparable / facts_extracted, 4) AS trust, chance_floor, round(round(gt_caught / gt_total, 4) - chance_floor, 4) AS signal_margin, CAST(guard_no_scale AS BIGINT) AS guard_no_scale FROM a""")
def hardness_report(spark, sf):
    t = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("v"))
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("k"), F.col("c_nationkey").alias("doc"), F.col("o_orderstatus").alias("st"), F.substring("o_orderpriority", 1, 1).alias("p")).join(t, "k", "left")
    out, has = F.col("st") != "P", F.col("v").isNotNull()
    parts = o.groupBy("doc").agg(
        F.count_if(out).alias("facts_extracted"), F.count_if(out & has).alias("facts_comparable"), F.count_if(out & has & (F.col("p") != "2")).alias("facts_exact"), F.count("v").alias("gt_total"), F.count_if(has & (F.col("p") != "5")).alias("gt_inscope"), F.count_if(has & (F.col("p") != "5") & out).alias("gt_caught"),
        F.count_if(F.col("st") == "F").alias("numeric_cells"), F.count_distinct("p").alias("labels"), F.count_if(~out).alias("guard_no_scale"), F.avg(F.when(F.col("k") % 3 == 0, 1.0).otherwise(0.0)).alias("chance_floor"),
    )
    return truth.hardness(parts).select("doc", "facts_extracted", "gt_caught", "labels", "precision", "verifiability", "recall_inscope", "coverage_filing", "trust", "chance_floor", "signal_margin", "guard_no_scale")


@query("""WITH g AS (SELECT p_partkey AS k, 'ifrs-full' AS taxonomy, p_brand AS name, p_size AS y FROM part), e AS (SELECT DISTINCT p_brand AS name, p_size AS y FROM part WHERE p_retailprice > 1100 AND p_brand NOT LIKE '%1'),
 s AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_brand NOT LIKE '%2'), o AS (SELECT g.*, CASE WHEN s.name IS NULL THEN 'out_of_scope' WHEN e.y IS NOT NULL THEN 'caught' WHEN g.name IN (SELECT name FROM e) THEN 'partial' ELSE 'dead' END AS outcome FROM g LEFT JOIN s USING (name) LEFT JOIN e USING (name, y))
 SELECT y, count(*) FILTER (outcome = 'caught') AS caught, count(*) FILTER (outcome = 'dead') AS dead, count(*) FILTER (outcome = 'partial') AS partial, count(*) FILTER (outcome = 'out_of_scope') AS out_of_scope, round(count(*) FILTER (outcome = 'caught') / nullif(count(*) FILTER (outcome <> 'out_of_scope'), 0), 4) AS recall FROM o GROUP BY y""")
def recall_in_scope(spark, sf):
    """Truth is every part by brand and size; dear ones were extracted, but no brand that ends with 1; labels exist for
    all brands but those that end with 2."""
    p = table(spark, sf, "part").withColumns({"concept": F.concat(F.lit("ifrs-full:"), F.col("p_brand")), "statement": F.lit("balance_sheet"), "period_start": F.lit(None).cast("date"), "period_end": F.col("p_size")})
    rows = truth.keyed(p, F.col("p_partkey")).select("taxonomy", "name", F.col("p_size").alias("y"), "p_retailprice", "concept")
    got = rows.where("p_retailprice > 1100 and not endswith(name, '1')")
    scope = truth.profile_concepts(rows.where("not endswith(name, '2')").select("concept"))
    return truth.recall(truth.scope_outcomes(rows, got, scope, ["taxonomy", "name", "y"], ["taxonomy", "name"]), ["y"])


# Tagged pages: each nation's suppliers as rows, in a table for even nations, as plain blocks for odd ones.
@query("""WITH r AS (SELECT s_nationkey AS doc, s_suppkey AS k, s_acctbal < 0 AS neg FROM supplier)
 SELECT doc, 'ifrs-full:' || CASE k % 4 WHEN 0 THEN 'CashFlowsUsed' WHEN 1 THEN 'Assets' ELSE 'Revenue' END || k AS concept, 'Supplier row ' || translate(CAST(k AS VARCHAR), '0123456789', 'abcdefghij') AS label, CASE WHEN k % 4 = 1 THEN 'instant' ELSE 'duration' END AS period,
 (k % 3 = 0) <> neg AS flip, CASE WHEN k % 5 = 0 THEN 'not_money' END AS drop_reason FROM r""")
def label_harvest(spark, sf):
    return labels.harvest(tagged_pages(spark, sf))


def tagged_pages(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("doc"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    k = F.col("k")
    name = F.concat(F.when(k % 4 == 0, "CashFlowsUsed").when(k % 4 == 1, "Assets").otherwise("Revenue"), k.cast("string"))
    tag = F.concat(
        F.lit('<ix:nonFraction name="ifrs-full:'), name, F.lit('" contextRef="'), F.when(k % 4 == 1, "i").otherwise("d"), F.lit('" unitRef="'), F.when(k % 5 == 0, "pure").otherwise("eur"), F.lit('"'),
        F.when(F.col("v") < 0, ' sign="-"').otherwise(""), F.lit(">"), F.format_number(F.abs("v"), 1), F.lit("</ix:nonFraction>"),
    )
    shown = F.when(k % 3 == 0, F.concat(F.lit("(<span>"), tag, F.lit("</span>)"))).otherwise(F.concat(F.lit("<span>"), tag, F.lit("</span>")))
    label = F.concat(F.lit("Supplier row "), F.translate(k.cast("string"), "0123456789", "abcdefghij"))
    row = F.when(F.col("doc") % 2 == 0, F.concat(F.lit("<tr><td> </td><td>"), label, F.lit("</td><td>"), shown, F.lit("</td></tr>"))).otherwise(F.concat(F.lit("<div>"), label, F.lit(" "), shown, F.lit(" 1,234</div>")))
    units = '<xbrli:unit id="eur"><xbrli:measure>iso4217:EUR</xbrli:measure></xbrli:unit><xbrli:unit id="pure"><xbrli:divide><xbrli:measure>iso4217:EUR</xbrli:measure></xbrli:divide></xbrli:unit>'
    contexts = '<xbrli:context id="i"><xbrli:instant>2024-12-31</xbrli:instant></xbrli:context><xbrli:context id="d"><xbrli:startDate>2024-01-01</xbrli:startDate></xbrli:context>'
    pages = s.select("doc", row.alias("row"), "k").groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "row"))), lambda x: x["row"]), "\n").alias("body"))
    return pages.select("doc", F.concat(F.lit(f"<html><head>{units}{contexts}</head><body>"), F.when(F.col("doc") % 2 == 0, F.concat(F.lit("<table>"), F.col("body"), F.lit("</table>"))).otherwise(F.col("body")), F.lit("</body></html>")).alias("text"))


@query("""WITH r AS (SELECT CASE p_size % 7 WHEN 0 THEN '106,143' WHEN 1 THEN 'At January 1, 2025' ELSE p_name || ' ' || p_brand END AS label, CASE WHEN p_size % 2 = 0 THEN 'CashFlowsFromX' ELSE p_type END AS concept, CASE WHEN p_size % 3 = 0 THEN 'instant' ELSE 'duration' END AS period, p_retailprice > 1000 AS flip FROM part),
 g AS (SELECT label, count(DISTINCT concept) AS nc, count(*) AS n, max(concept) AS concept, bool_and(period = 'instant') AS instant, bool_and(flip) AS flip FROM r WHERE label NOT LIKE '106%' AND label NOT LIKE 'At Jan%' GROUP BY label)
 SELECT label, concept, CASE WHEN instant THEN 'balance_sheet' WHEN concept LIKE 'CashFlows%' THEN 'cash_flow' ELSE 'income_statement' END AS statement, flip, n AS n_rows FROM g WHERE nc = 1 AND n >= 2""")
def label_map_statements(spark, sf):
    kept, _ = labels.build_map(_records(spark, sf), 2)
    return kept


@query("""WITH r AS (SELECT CASE p_size % 7 WHEN 0 THEN '106,143' WHEN 1 THEN 'At January 1, 2025' ELSE p_name || ' ' || p_brand END AS label, CASE WHEN p_size % 2 = 0 THEN 'CashFlowsFromX' ELSE p_type END AS concept FROM part),
 g AS (SELECT label, count(DISTINCT concept) AS nc, count(*) AS n FROM r WHERE label NOT LIKE '106%' AND label NOT LIKE 'At Jan%' GROUP BY label)
 SELECT reason, count(*) AS n FROM (SELECT CASE WHEN label LIKE '106%' THEN 'numeric' ELSE 'date_or_empty' END AS reason FROM r WHERE label LIKE '106%' OR label LIKE 'At Jan%' UNION ALL SELECT CASE WHEN nc > 1 THEN 'several_concepts' ELSE 'too_few' END FROM g WHERE nc > 1 OR n < 2) GROUP BY ALL""")
def label_map_drops(spark, sf):
    return labels.build_map(_records(spark, sf), 2)[1]


def _records(spark, sf) -> DataFrame:
    size = F.col("p_size")
    label = F.when(size % 7 == 0, "106,143").when(size % 7 == 1, "At January 1, 2025").otherwise(F.concat("p_name", F.lit(" "), "p_brand", F.when(size % 2 == 0, " [a]").otherwise(" (see note 3)")))
    return table(spark, sf, "part").select(label.alias("label"), F.when(size % 2 == 0, "CashFlowsFromX").otherwise(F.col("p_type")).alias("concept"), F.when(size % 3 == 0, "instant").otherwise("duration").alias("period"), (F.col("p_retailprice") > 1000).alias("flip"))


CLAIMS = claims.ClaimProfile(
    separator=".",
    unit_pattern=r"t\s*CO2e",
    unit_factor=1000,
    unit_in_rows=False,
    baseline_pattern="base year",
    labels=(("Gross scope 1", "combined_1_2_market", True), ("Gross scope 3", "scope_3", True)),
    target_heading=r"Absolute target:\s*Scope\s*([13])",
    baseline_year="Base year",
    baseline_value="Base value",
    in_scope="In scope",
    out_of_scope="Out of scope",
    target_pattern=r"by\s+(\d+)\s*%",
    net_zero="net zero",
)


def emission_tables(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A customer's years as an emission table, the first one as base year and one target column; the unit is stated on the
    page of every customer but each fifth."""
    y = _years(spark, sf)
    head = F.concat(F.when(F.col("ci") == 1, "Base year (").otherwise("FY "), F.col("y").cast("string"), F.when(F.col("ci") == 1, ")").otherwise(""))
    cell = lambda r, t: F.struct(F.lit(r).alias("ri"), t.alias("text"))
    shown = lambda c: F.coalesce(F.format_number(c, 0), F.lit("n/a"))
    right = y.select("doc", F.col("ci").cast("int").alias("ci"), F.inline(F.array(cell(0, head), cell(1, shown(F.col("f"))), cell(2, shown(F.col("o"))))))
    docs = y.groupBy("doc").agg(F.max("n_years").alias("n_years"))
    goal = docs.select("doc", (F.col("n_years") + 1).cast("int").alias("ci"), F.inline(F.array(cell(0, F.lit("2030 target")), cell(1, F.lit("50")), cell(2, F.lit(""))))) 
    left = docs.select("doc", F.lit(0).alias("ci"), F.inline(F.array(cell(0, F.lit("")), cell(1, F.lit("Gross Scope 1")), cell(2, F.lit("Gross scope 3"))))) 
    cells = right.unionByName(goal).unionByName(left).withColumn("table_ord", F.lit(0))
    tables = docs.select("doc", F.lit(0).alias("table_ord"), F.lit(4).alias("page_no"), F.lit(500.0).alias("top"), F.lit(3).alias("n_rows"), (F.col("n_years") + 2).cast("int").alias("n_cols"))
    texts = docs.select("doc", F.lit(0).alias("ord"), F.lit(4).alias("page_no"), F.lit(600.0).alias("top"), F.lit("text").alias("label"), F.when(F.col("doc") % 5 == 0, "in tonnes").otherwise("in 1,000 t CO2e").alias("text"))
    return tables, cells, texts


@query(f"""WITH {YEARS} SELECT doc, s AS scope, CASE WHEN tgt THEN 'target' ELSE 'quantitative' END AS claim_type, CASE WHEN NOT tgt THEN make_date(y, 12, 31) END AS period_end, CASE WHEN tgt THEN 2030 END AS target_year, CAST(v * 1000 AS DOUBLE) AS value, NOT tgt AND ci = 1 AS is_baseline_column
 FROM (SELECT doc, y, ci, 'combined_1_2_market' AS s, f AS v, false AS tgt FROM years UNION ALL SELECT doc, y, ci, 'scope_3', o, false FROM years UNION ALL SELECT DISTINCT doc, 0, 0, 'combined_1_2_market', 50, true FROM years) WHERE doc % 5 <> 0""")
def emission_claims(spark, sf):
    out, _ = claims.emission_claims(*emission_tables(spark, sf), CLAIMS)
    return out.select("doc", "scope", "claim_type", "period_end", "target_year", F.col("value").cast("double").alias("value"), "is_baseline_column")


@query("""WITH c AS (SELECT c_custkey AS k FROM customer)
 SELECT k AS doc, '1' = n AS is_scope_1, y AS target_year, CASE WHEN z THEN NULL ELSE 20.0 + k % 50 END AS value, CASE WHEN z THEN 'net_zero' ELSE 'absolute' END AS target_type, 2010 + k % 9 AS baseline_year, (k % 90) + 0.5 AS baseline_value, flag FROM (
 SELECT k, CASE WHEN k % 2 = 0 THEN '1' ELSE '3' END AS n, 2030 AS y, false AS z, '' AS flag FROM c
 UNION ALL SELECT k, CASE WHEN k % 2 = 0 THEN '1' ELSE '3' END, CASE WHEN k % 3 = 0 THEN NULL ELSE 2050 END, true, CASE WHEN k % 3 = 0 THEN 'year_label_missing' ELSE '' END FROM c
 UNION ALL SELECT k, CASE WHEN k % 2 = 0 THEN '1' ELSE '3' END, 2060, k % 4 = 0, CASE WHEN k % 4 = 0 THEN '' ELSE 'description_not_found' END FROM c WHERE k % 4 = 0)
 UNION ALL SELECT k, k % 2 = 0, 2060, NULL, 'absolute', 2010 + k % 9, (k % 90) + 0.5, 'description_not_found' FROM c WHERE k % 4 <> 0""")
def paired_targets(spark, sf):
    """Each customer's page has a heading, a table of one column with years and aims, and below it a table of two columns."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc"))
    k = F.col("doc")
    tables = c.select("doc", F.inline(F.array(*[F.struct(F.lit(t).alias("table_ord"), F.lit(7).alias("page_no"), F.lit(top).alias("top"), F.lit(n).alias("n_cols")) for t, top, n in ((0, 900.0, 1), (1, 500.0, 1), (2, 400.0, 2))])))
    at = lambda t, r, i, x: F.struct(F.lit(t).alias("table_ord"), F.lit(r).alias("ri"), F.lit(i).alias("ci"), (x if not isinstance(x, str) else F.lit(x)).alias("text"))
    aim = F.concat(F.lit("reduce by "), (k % 50 + 20).cast("string"), F.lit(" %"))
    mile = [at(1, 0, 0, "2030"), at(1, 1, 0, aim), at(1, 2, 0, F.when(k % 3 == 0, "as planned").otherwise("2050")), at(1, 3, 0, "net zero overall"), at(1, 4, 0, "2060")]
    attr = [at(2, 0, 0, "Base  year"), at(2, 0, 1, F.concat(F.lit("FY "), (k % 9 + 2010).cast("string"))), at(2, 1, 0, "Base value"), at(2, 1, 1, F.concat((k % 90).cast("string"), F.lit(",5 Mt")))]
    cells = c.select("doc", F.inline(F.array(at(0, 0, 0, "2031"), *mile, *attr)))
    head = F.concat(F.lit("Absolute target: Scope "), F.when(k % 2 == 0, "1").otherwise("3"))
    line = lambda o, top, label, x: F.struct(F.lit(o).alias("ord"), F.lit(7).alias("page_no"), F.lit(top).alias("top"), F.lit(label).alias("label"), x.alias("text"))
    texts = c.select("doc", F.inline(F.array(line(0, 950.0, "section_header", F.lit("Absolute target: Scope 9")), line(1, 600.0, "section_header", head), line(2, 100.0, "text", F.when(k % 4 == 0, "we aim at net zero in 2060").otherwise("we aim high")))))
    out = claims.paired_targets(tables, cells, texts, CLAIMS)
    return out.select("doc", (F.col("scope") != "scope_3").alias("is_scope_1"), "target_year", F.col("value").cast("double").alias("value"), "target_type", "baseline_year", "baseline_value", F.array_join("flags", ";").alias("flag"))


@query(f"""WITH {YEARS}, s AS (SELECT doc, y, 'a' AS k, f * 1000.0 AS v FROM years WHERE f IS NOT NULL UNION ALL SELECT doc, y, 'x', o * 1000.0 FROM years WHERE o IS NOT NULL UNION ALL SELECT doc, y, 'z', p * 1000.0 FROM years WHERE p IS NOT NULL),
 e AS (SELECT doc, k, arg_min(v, y) AS fv, arg_max(v, y) AS lv, CASE WHEN count(*) > 1 THEN round((arg_max(v, y) - arg_min(v, y)) / nullif(abs(arg_min(v, y)), 0) * 100, 6) END AS pct FROM s GROUP BY ALL),
 w AS (SELECT doc, max(pct) FILTER (k = 'a') AS ap, max(fv) FILTER (k = 'a') AS af, max(lv) FILTER (k = 'a') AS al, max(pct) FILTER (k = 'x') AS xp, max(fv) FILTER (k = 'x') AS xf, max(lv) FILTER (k = 'x') AS xl, max(pct) FILTER (k = 'z') AS zp FROM e GROUP BY doc),
 t AS (SELECT doc, min(y) AS yb FROM years GROUP BY doc), tz AS (SELECT t.doc, yb, z.v AS zv, x.v AS xv FROM t LEFT JOIN s z ON z.doc = t.doc AND z.y = t.yb AND z.k = 'z' LEFT JOIN s x ON x.doc = t.doc AND x.y = t.yb AND x.k = 'x'),
 g AS (SELECT w.*, yb, zv, xv, CASE WHEN doc % 3 = 0 THEN coalesce(zv, 0) / 1e6 ELSE 5000.0 END AS base FROM w JOIN tz USING (doc))
 SELECT doc, 'scope12_down_scope3_up' AS signal, 'high' AS severity, round((xl + al - (xf + af)) / nullif(xf + af, 0) * 100, 1) + 0.0 AS measure FROM g WHERE ap < 0 AND xp > 0
 UNION ALL SELECT doc, 'dominant_scope_not_targeted', 'high', round(100 - al / (xl + al) * 100, 1) FROM g WHERE xl / al >= 5 AND doc % 2 = 0
 UNION ALL SELECT doc, 'target_anchored_to_company_specific_metric', 'high', zp FROM g WHERE base <> 0 AND abs(coalesce(zv, 0) / 1e6 - base) < 0.1 AND abs(coalesce(xv, 0) / 1e6 - base) >= 0.1 AND zp IS NOT NULL AND xp IS NOT NULL
 UNION ALL SELECT doc, 'baseline_mismatch', 'review', base FROM g WHERE base <> 0 AND zv IS NOT NULL AND abs(zv / 1e6 - base) > 0.1""")
def claim_signals(spark, sf):
    """Emissions of scope 1 and 2 from finished orders, of scope 3 from open ones, company specific ones from pending; each
    customer's one target is for scope 3, its baseline right for every third customer."""
    y = _years(spark, sf)
    first = F.min("y").over(Window.partitionBy("doc"))
    part = lambda scope, own, v: F.struct(F.lit("quantitative").alias("claim_type"), F.lit(scope).alias("scope"), F.lit(own).alias("is_company_specific"), F.lit(True).alias("is_subtotal"), (F.col(v) * 1000).cast("decimal(38,6)").alias("value"), F.make_date("y", F.lit(12), F.lit(31)).alias("period_end"), F.lit(None).cast("boolean").alias("covers_scope3"), F.lit(None).cast("double").alias("baseline_value"), F.lit(None).cast("int").alias("baseline_year"))
    measured = y.select("doc", F.lit(0).alias("ord"), F.inline(F.array(part(claims.SCOPE_12[0], False, "f"), part("scope_3", False, "o"), part("scope_3", True, "p"))))
    base = F.when(F.col("doc") % 3 == 0, F.coalesce(F.col("p"), F.lit(0)) * 1000 / 1e6).otherwise(5000.0)
    aims = y.withColumn("_f", first).where("y = _f").select("doc", F.lit(1).alias("ord"), F.lit("target").alias("claim_type"), F.lit("scope_3").alias("scope"), (F.col("doc") % 2 == 1).alias("covers_scope3"), base.alias("baseline_value"), F.col("y").cast("int").alias("baseline_year"))
    return claims.signals(claims.one_shape(measured, aims), ["doc"])


# Reports of nations: an index page whose rows name codes, pages with marks, and notes.
def report_pages(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("k"))
    k = F.col("k")
    code = F.concat(F.lit("E"), (k % 5 + 1).cast("string"), F.lit("-"), k.cast("string"))
    ref = F.when(k % 3 == 0, F.concat(F.lit("   Anhangangabe "), (k % 7).cast("string"), F.lit(" – Notes of ours"))).otherwise("")
    row = F.concat(code, F.lit(" Title of it"), ref, F.when(k % 2 == 0, F.concat(F.lit("\nand more"), F.lit("    "), (k % 90 + 1).cast("string"))).otherwise(F.concat(F.lit(" section "), (k % 9).cast("string"), F.lit(".1"))))
    lines = lambda x: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", x.alias("x")))), lambda y: y["x"]), "\n")
    index = c.groupBy("doc").agg(lines(row).alias("body")).select("doc", F.lit(1).alias("page"), F.concat(F.when(F.col("doc") % 2 == 0, "ESRS index\n").otherwise("somewhere > above\n"), F.col("body")).alias("text"))
    seen = F.when(k % 4 == 0, F.concat(F.lit("words [ESRS "), code, F.lit("] words"))).when(k % 4 == 1, F.concat(code, F.lit(" Ziele und so"))).otherwise("nothing here")
    body = c.where(F.col("doc") % 10 != 9).groupBy("doc").agg(lines(seen).alias("text")).select("doc", F.lit(4).alias("page"), "text")
    other = c.select("doc").distinct().select("doc", F.lit(5).alias("page"), F.lit("intro\n 2 | Policies\n4 |\n[E1-9999] [MDR-77]\n1 | Basis").alias("text"))
    dry = c.select("doc").distinct().select("doc", F.explode(F.array(F.lit(2), F.lit(3))).alias("page"), F.lit("plain words").alias("text"))
    return index.unionByName(body).unionByName(other).unionByName(dry)


_REPORT = """WITH c AS (SELECT c_nationkey AS doc, c_custkey AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer), i AS (SELECT *, doc % 10 <> 9 AND k % 4 <= 1 AS found, doc % 2 = 0 OR n >= 5 AS has FROM c),
 d AS (SELECT doc, CASE WHEN bool_and(has) THEN count(*) ELSE 0 END AS n_codes, CASE WHEN bool_and(has) THEN count(*) FILTER (found) ELSE 0 END AS n_found FROM i GROUP BY doc),
 s AS (SELECT *, CASE WHEN n_codes = 0 THEN 'no_index' WHEN n_found / n_codes < 0.2 THEN 'not_conclusive' ELSE 'conclusive' END AS status FROM d)"""


@query(f"{_REPORT} SELECT doc, n_codes, n_found, status FROM s")
def disclosure_documents(spark, sf):
    return disclosures.reconcile(report_pages(spark, sf))[0]


@query(f"""{_REPORT} SELECT i.doc, 'E' || (k % 5 + 1) || '-' || k AS code, CASE WHEN k % 2 = 0 THEN 'page' ELSE 'section' END AS ref_kind, CASE WHEN k % 2 = 0 THEN CAST(k % 90 + 1 AS VARCHAR) ELSE k % 9 || '.1' END AS claimed, CASE WHEN k % 3 = 0 THEN k % 7 IN (1, 2, 4) END AS resolves,
 CASE WHEN k % 3 = 0 AND k % 7 NOT IN (1, 2, 4) THEN 'reference_not_found' WHEN found THEN 'verified' ELSE 'claimed_but_untagged' END AS status FROM i JOIN s USING (doc) WHERE s.status = 'conclusive'""")
def disclosure_claims(spark, sf):
    return disclosures.reconcile(report_pages(spark, sf))[1].select("doc", "code", "ref_kind", "claimed", "resolves", "status")


@query(f"{_REPORT} SELECT doc, 'E1-9999' AS code, [5] AS pages FROM s WHERE status = 'conclusive'")
def disclosure_orphans(spark, sf):
    return disclosures.reconcile(report_pages(spark, sf))[2].select("doc", "code", "pages")
