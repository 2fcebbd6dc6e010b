"""Document operators against hand-made cases: extraction, rules, gates, labels, claims, disclosures, contracts, control."""

import datetime
import json
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import numbers as N
from factloom.functions import text as X
from factloom.operators import claims, contracts, control, disclosures, extraction, facts, gates, gold, grids, labels, retrieval, rowsets, rules, signals, traces, truth
from factloom.plans import queries
from factloom.sources import readers, sinks
from factloom.streaming.breaker import breaker_states, step
from tests.oracle import duck

D = datetime.date
SF = "/root/testdata/sf0.001"


def cells_of(spark, grids_, doc="d"):
    rows = [(doc, t, r, c, text) for t, g in enumerate(grids_) for r, row in enumerate(g) for c, text in enumerate(row)]
    return spark.createDataFrame(rows, "doc string, table_ord int, ri int, ci int, text string")


def tables_of(spark, rows):
    return spark.createDataFrame(rows, "doc string, table_ord int, page_no int, top double, n_rows int, n_cols int")


def texts_of(spark, rows):
    return spark.createDataFrame(rows, "doc string, ord int, page_no int, top double, label string, text string")


P = extraction.Profile(separator=",", scale_pattern=r"In\s+([A-Z]{3})\s+(Mio|Tsd)", scales={"Mio": 1_000_000, "Tsd": 1_000}, sections=[("Konzernbilanz", "balance_sheet"), ("Konzern-Gewinn", "income_statement")], labels=[("Cash", "ifrs-full:Cash", "balance_sheet"), ("Umsatz", "ifrs-full:Revenue", "income_statement"), ("Steuern", "ifrs-full:Tax", "income_statement")], flips={"ifrs-full:Tax"})


def test_extract(spark):
    income = [["In EUR Mio", "2025", "2024 1"], ["Umsatz", "24.308", "–"], ["Steuern", "(1.834)", ""], ["umsatz", "1", "2"]]
    balance = [["", "2025", "2024"], ["Cash", "", ""], ["Cash", "77,946", "x"], ["Cash", "5", "6"]]
    cells = cells_of(spark, [income, [["", "2025", "2024"], ["Steuern", "9", "9"]], balance, [["", "words"], ["Cash", "1"]], [["", "2025", "2024"], ["Cash", "3", "4"]]])
    tables = tables_of(spark, [("d", 0, 1, 500.0, 4, 3), ("d", 1, 2, 500.0, 2, 3), ("d", 2, 3, 500.0, 4, 3), ("d", 3, 4, 500.0, 2, 2), ("d", 4, 5, 500.0, 2, 3)])
    texts = texts_of(spark, [("d", 0, 1, 900.0, "section_header", "Konzernbilanz"), ("d", 1, 1, 600.0, "section_header", "Konzern-Gewinn- und Verlust"), ("d", 2, 1, 400.0, "section_header", "Konzernbilanz"), ("d", 3, 3, 600.0, "page_header", "Konzernbilanz"), ("d", 4, 1, 10.0, "text", "1) Angepasst wegen Umgliederung"), ("d", 5, 1, 9.0, "text", "100% Scope adjusted"), ("d", 6, 3, 5.0, "text", "In EUR Mio")])
    out, guards = extraction.extract(tables, cells, texts, P)
    got = {(r["concept"], r["period_end"].year): r for r in out.collect()}
    assert set(got) == {("ifrs-full:Revenue", 2025), ("ifrs-full:Revenue", 2024), ("ifrs-full:Tax", 2025), ("ifrs-full:Cash", 2025)}
    r = got["ifrs-full:Revenue", 2025]
    assert (r["value"], r["scale_source"], r["section_source"], r["period_start"], r["is_comparative"], r["currency"]) == (Decimal(24308000000), "column_header", "heading", D(2025, 1, 1), False, "EUR")
    assert got["ifrs-full:Revenue", 2024]["is_nil"] and got["ifrs-full:Revenue", 2024]["period_basis"] == "restated" and got["ifrs-full:Revenue", 2024]["note"].startswith("Angepasst") and got["ifrs-full:Revenue", 2024]["is_comparative"]
    assert got["ifrs-full:Tax", 2025]["value"] == Decimal(1834000000) and got["ifrs-full:Tax", 2025]["sign_rule"] == "taxonomy_balance"
    # the empty row claims nothing; the table of other words does not break the chain to the last table
    cash = got["ifrs-full:Cash", 2025]
    assert cash["value"] == Decimal(77946000) and cash["period_start"] is None and (cash["table_ord"], cash["ri"]) == (2, 2)
    assert {(g["reason"], g["n"]) for g in guards.collect()} == {("dup_label", 4), ("empty_row", 1)}
    assert len({r["fact_id"] for r in got.values()}) == 4 and all(len(r["fact_id"]) == 32 for r in got.values())
    empty = extraction.extract(tables.limit(0), cells.limit(0), texts.limit(0), P)
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_sections_and_scales(spark):
    years = lambda *rows: spark.createDataFrame([("d", i, i, h, y) for i, (h, y) in enumerate(rows)], "doc string, table_ord int, page_no int, heading string, years array<string>")
    a, b = ["2025", "2024"], ["2025"]
    got = extraction.with_sections(years(("x", a), (None, a), (None, b), (None, b), ("y", a), (None, a), (None, b)), {6: "p"}).orderBy("table_ord").collect()
    assert [r["section"] for r in got] == ["x", "x", None, None, "y", "y", "p"]
    assert [r["section_source"] for r in got][:2] == ["heading", "continuation"] and got[6]["section_source"] == "profile_page_map"
    scale = lambda *texts: extraction.with_scales(tables_of(spark, [("d", 0, 7, 1.0, 1, 1)]), cells_of(spark, [[["", ""]]]), texts_of(spark, [("d", i, p, 1.0, "t", t) for i, (p, t) in enumerate(texts)]), P).first()
    assert (scale((1, "In EUR Mio"))["scale"], scale((1, "In EUR Mio"))["scale_source"]) == (1_000_000, "document_uniform")
    assert scale((1, "In EUR Mio"), (2, "In EUR Tsd"))["scale"] is None and scale((1, "none"))["scale_source"] == "inferred"
    assert scale((7, "In EUR Tsd"), (7, "In EUR Mio"))["scale"] == 1_000
    codes = [r[0] for r in spark.createDataFrame([("$",), ("€",), ("NOK",), ("",), (None,)], "c string").select(extraction.currency_code(F.col("c"))).collect()]
    assert codes == ["USD", "EUR", "NOK", "EUR", "EUR"]


def test_groups_and_merged_years(spark):
    def groups(grid):
        cells = cells_of(spark, [grid])
        heads = grids.header_columns(cells, bare=False, keys=extraction.TABLE)
        return [(r["ci"], r["group"]) for r in extraction.column_groups(heads, cells, extraction.TABLE).orderBy("ci").collect()]

    assert groups([["", "", "Operational control", "Equity"], ["x", "y", "2024", "2024"]]) == [(2, "operational control"), (3, "equity")]
    assert groups([["l", "Base year (2017)", "2024", "Base year (2017)", "2024"]]) == [(1, "operational control"), (2, "operational control"), (3, "equity"), (4, "equity")]
    merged = cells_of(spark, [[["", "", "2024", "2024", "2023", "2023"], ["(€ milioni)", "Note", "Totale", "di cui …", "Totale", "di cui …"]]])
    pick = lambda sub: sorted((r["ci"], r["year"]) for r in extraction.year_columns(merged, sub).collect())
    assert pick(None) == [] and pick("Totale") == [(2, "2024"), (4, "2023")] and pick("Total") == []


def fact(owner="o", concept="Assets", value=1, start=None, end=D(2024, 12, 31), accn="x", unit="USD", filed=D(2025, 1, 1), tol=0.5, taxonomy="us-gaap"):
    return (owner, taxonomy, concept, unit, start, end, accn, filed, Decimal(value), tol)


FACT = "owner string, taxonomy string, concept string, unit string, period_start date, period_end date, accn string, filed date, value decimal(38,6), tol double"


def results(spark, rows, **how):
    out = rules.check_rules(spark.createDataFrame(rows, FACT), **how).collect()
    return {(r["identity"], r["owner"]): r for r in out}


def test_rules(spark):
    year = {"start": D(2024, 1, 1)}
    both = [fact(concept="Assets", value=10), fact(concept="LiabilitiesAndStockholdersEquity", value=11)]
    assert results(spark, both)["balance_sheet", "o"]["status"] == "PASS"
    bad = results(spark, [fact(value=10), fact(concept="LiabilitiesAndStockholdersEquity", value=13)])
    assert bad["balance_sheet", "o"]["status"] == "FAIL" and bad["equity_split", "o"]["reason"].startswith("no filing has all: MinorityInterest, StockholdersEquity")
    assert results(spark, [fact(value=10), fact(concept="LiabilitiesAndStockholdersEquity", value=-10)])["balance_sheet", "o"]["suspect"] == "Assets"
    mixed = results(spark, [fact(value=10), fact(concept="LiabilitiesAndStockholdersEquity", value=10, unit="EUR")])["balance_sheet", "o"]
    assert mixed["status"] == "SKIP" and mixed["reason"] == "currencies differ: EUR, USD"
    apart = [fact(value=10), fact(concept="LiabilitiesAndStockholdersEquity", value=10, accn="y")]
    assert results(spark, apart)["balance_sheet", "o"]["status"] == "SKIP" and results(spark, apart, cross_filing=True)["balance_sheet", "o"]["status"] == "PASS"
    torn = [*apart, fact(value=12, accn="y", filed=D(2026, 1, 1))]
    assert results(spark, torn, cross_filing=True)["balance_sheet", "o"]["reason"] == "no filing has all: values of filings differ"
    newest = [*both, fact(value=10, accn="y", filed=D(2026, 1, 1)), fact(concept="LiabilitiesAndStockholdersEquity", value=99, accn="y", filed=D(2026, 1, 1))]
    assert (results(spark, newest)["balance_sheet", "o"]["status"], results(spark, newest)["balance_sheet", "o"]["accn"]) == ("FAIL", "y")
    interim = results(spark, [fact(concept="Revenues", start=D(2024, 7, 1))])
    assert interim["income_before_tax", "o"]["status"] == "N/A" and "interim_6m" in interim["income_before_tax", "o"]["reason"]
    assert results(spark, [fact(concept="Revenues", start=D(2016, 1, 1), end=D(2016, 12, 31))])["income_before_tax", "o"]["reason"] == "outside 2017 to 9999"
    ifrs = lambda concept, value: fact(concept=concept, value=value, taxonomy="ifrs-full", **year)
    taxed = [ifrs("ProfitLossBeforeTax", 100), ifrs("IncomeTaxExpenseContinuingOperations", 20), ifrs("ProfitLoss", 90), ifrs("ProfitLossFromDiscontinuedOperations", 10)]
    got = rules.check_rules(spark.createDataFrame(taxed, FACT)).where("identity = 'profit_after_tax'").collect()
    assert [r["status"] for r in got] == ["PASS"]  # the variant that holds hides the one that does not
    flows = [ifrs(f"CashFlowsFromUsedIn{x}Activities", 1) for x in ("Operating", "Investing", "Financing")] + [ifrs("IncreaseDecreaseInCashAndCashEquivalentsBeforeEffectOfExchangeRateChanges", 3)]
    got = results(spark, flows)
    assert got["cash_flow_roll", "o"]["status"] == "SKIP" and got["cash_flow_roll_pre_fx", "o"]["status"] == "PASS"
    whole = results(spark, [*flows, ifrs("EffectOfExchangeRateChangesOnCashAndCashEquivalents", 0), ifrs("IncreaseDecreaseInCashAndCashEquivalents", 3)])
    assert whole["cash_flow_roll", "o"]["status"] == "PASS" and ("cash_flow_roll_pre_fx", "o") not in whole
    subset = lambda a, b: results(spark, [ifrs("RevenueFromContractsWithCustomers", a), ifrs("Revenue", b)])["revenue_subset", "o"]["status"]
    assert (subset(5, 9), subset(9, 5)) == ("PASS", "FAIL")
    assert len(rules.US_GAAP) == 7 and len(rules.IFRS) == 9 and results(spark, both, year=2023) == {}
    table = rules.status_counts(rules.report(rules.check_rules(spark.createDataFrame(both, FACT))), ["taxonomy"]).first()
    assert (table["pass"], table["skip"]) == (1, 2)


def test_cash_continuity(spark):
    end, chg = rules.CASH["us-gaap"][0][0], rules.CASH["us-gaap"][1]
    rows = [fact(concept=end, value=100, end=D(2023, 12, 31)), fact(concept=end, value=130), fact(concept=chg, value=30, start=D(2024, 1, 1)), fact("p", concept=chg, value=30, start=D(2024, 1, 1)), fact("q", concept=end, value=1, end=D(2023, 12, 31)), fact("q", concept=end, value=9), fact("q", concept=chg, value=1, start=D(2024, 1, 1)), fact("r", concept=end, value=1, end=D(2023, 12, 31), unit="EUR"), fact("r", concept=end, value=2), fact("r", concept=chg, value=1, start=D(2024, 1, 1))]
    got = {r["owner"]: (r["status"], r["reason"]) for r in rules.cash_continuity(spark.createDataFrame(rows, FACT)).collect()}
    assert got == {"o": ("PASS", None), "p": ("SKIP", "no opening or closing balance"), "q": ("WARN", None), "r": ("SKIP", "currencies differ")}


def gate_row(**more):
    base = {"doc": "d", "concept": "us-gaap:Revenues", "statement": "income_statement", "period_start": D(2025, 1, 1), "period_end": D(2025, 12, 31), "raw": "1,250", "separator": ".", "scale": 1000000, "sign_rule": "as_printed", "value": Decimal(1250000000), "span": "1,250", "page_no": 60, "grounded": True, "header_path": ["", "2025"], "scale_source": "statement_header", "period_basis": "audited"}
    return tuple((base | more).values())


GATE = "doc string, concept string, statement string, period_start date, period_end date, raw string, separator string, scale long, sign_rule string, value decimal(38,6), span string, page_no int, grounded boolean, header_path array<string>, scale_source string, period_basis string"


def test_gates(spark):
    flags = lambda **more: gates.gate(spark.createDataFrame([gate_row(**more)], GATE)).first()["flags"]
    assert flags() == [] and flags(value=None) == [] and flags(raw="n/a") == []
    assert flags(value=Decimal(1250000000000)) == ["scale_arithmetic_mismatch:1000x"] and flags(value=Decimal(1250000)) == ["scale_arithmetic_mismatch:0.001x"] and flags(value=Decimal(7)) == ["scale_arithmetic_mismatch"]
    assert flags(span=None) == ["missing_source_ref"] and flags(page_no=0) == ["missing_source_ref"] and flags(grounded=None) == ["groundedness_failed"]
    assert flags(header_path=["", "2024"]) == ["header_period_mismatch"] and flags(header_path=["words"]) == [] and flags(header_path=[]) == []
    assert flags(scale_source="inferred", period_basis="restated") == ["scale_inferred", "restated"]
    minus = {"raw": "(1,250)", "value": Decimal(-1250000000)}
    assert flags(**minus) == [] and flags(**minus, sign_rule="parenthesis_negative") == [] and flags(**minus, sign_rule="taxonomy_balance") == ["scale_arithmetic_mismatch"]
    assert flags(raw="1,250", value=Decimal(-1250000000), sign_rule="taxonomy_balance") == [] and flags(value=Decimal(-1250000000), sign_rule="less_prefix") == []
    rows = spark.createDataFrame([gate_row(), gate_row(doc="e", span="999"), gate_row(concept="Revenues"), gate_row(concept="x:Revenues"), gate_row(value=None), gate_row(scale_source="inferred", statement="balance_sheet")], GATE)
    texts = spark.createDataFrame([("d", "<html>Total <b>1,2</b>50 of it"), ("e", "1,250")], "doc string, text string")
    got = gates.admit(gates.gate(rows, texts))
    assert sorted((r["drop_reason"] or "") for r in got.collect()) == ["", "", "hallucinated_span", "not_canonical", "other_taxonomy", "other_taxonomy"]
    assert got.where("statement = 'balance_sheet'").first()["period_start"] is None
    assert {(r["reason"], r["n"]) for r in gates.gate_report(gates.gate(rows, texts)).collect()} == {("hallucinated_span", 1), ("not_canonical", 1), ("other_taxonomy", 2)}
    one = spark.createDataFrame([gate_row(doc="d")], GATE)
    caught = {d: gates.gate(gates.inject(one, d, F.lit(True)), texts).first()["flags"] for d in gates.DEFECTS}
    assert caught["scale_1000x"] == ["scale_arithmetic_mismatch:1000x"] and caught["sign_flip"] == [] and caught["header_mismatch"] == ["header_period_mismatch"] and caught["hallucination"] == ["hallucinated_span"] and caught["missing_source"] == ["missing_source_ref"] and caught["groundedness"] == ["groundedness_failed"]
    assert gates.gate(gates.inject(one, "scale_consistent", F.lit(True))).first()["flags"] == []
    with pytest.raises(ValueError, match="no such defect"):
        gates.inject(one, "other", F.lit(True))


def test_labels(spark, tmp_path):
    page = """<html><xbrli:context id="i"><xbrli:instant>2024-12-31</xbrli:instant></xbrli:context><xbrli:unit id="e"><xbrli:measure>iso4217:EUR</xbrli:measure></xbrli:unit>
    <xbrli:unit id="s"><xbrli:divide><xbrli:measure>iso4217:EUR</xbrli:measure><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:divide></xbrli:unit>
    <table><tr><td> </td><th>Total <i>assets</i></th><td>(<span><ix:nonFraction name="ifrs-full:Assets" unitRef="e" contextRef="i" sign="-">3.262</ix:nonFraction></span>)</td><td><ix:nonFraction name="ifrs-full:Assets" unitRef="e" contextRef="i" sign="-">5</ix:nonFraction></td></tr></table>
    <div>Revenue of it <span><ix:nonFraction name="ifrs-full:Revenue" unitRef="e" contextRef="d">42,1</ix:nonFraction></span> (9)</div><p><ix:nonFraction name="ifrs-full:EPS" unitRef="s" contextRef="d">3,03</ix:nonFraction></p><p><ix:nonFraction name="us-gaap:X" unitRef="e">1</ix:nonFraction></p></html>"""
    got = [tuple(r) for r in labels.harvest(spark.createDataFrame([("d", page), ("e", None)], "doc string, text string")).select("concept", "label", "period", "flip", "drop_reason").collect()]
    assert got[:3] == [("ifrs-full:Assets", "Total assets", "instant", False, None), ("ifrs-full:Assets", "Total assets", "instant", True, None), ("ifrs-full:Revenue", "Revenue of it", "duration", False, None)]
    assert [g[4] for g in got[3:]] == ["not_money", "other_taxonomy"]
    reason = [r[0] for r in spark.createDataFrame([(x,) for x in ("106,143", "(1.234)", "-12", "24.308", "3,5 %", "At January 1, 2025", "31/12/2024", "", "Revenue 2024 adjusted")], "l string").select(labels.label_reason(F.col("l"))).collect()]
    assert reason == ["numeric"] * 4 + ["numeric"] + ["date_or_empty"] * 3 + [None]
    kinds = [r[0] for r in spark.createDataFrame([("Assets", True), ("CashFlowsFromX", False), ("Revenue", False)], "c string, i boolean").select(labels.statement_of(F.col("c"), F.col("i"))).collect()]
    assert kinds == ["balance_sheet", "cash_flow", "income_statement"]
    kept, drops = labels.build_map(spark.createDataFrame([("A [1]", "X", "instant", True), ("A", "X", "duration", True), ("B", "X", "instant", False), ("B", "Y", "instant", False), ("C", "Z", "instant", False)], "label string, concept string, period string, flip boolean"), 2)
    assert [tuple(r)[:4] for r in kept.collect()] == [("A", "X", "income_statement", True)]
    assert {tuple(r) for r in drops.collect()} == {("several_concepts", 1), ("too_few", 1)}
    labels.write_map(kept.withColumn("concept", F.lit("ifrs-full:X")), str(tmp_path / "map"))
    assert [tuple(r) for r in labels.load_map(spark, str(tmp_path / "map")).collect()] == [("A", "ifrs-full:X", "income_statement", True)]
    with pytest.raises(ValueError, match="no label"):
        labels.write_map(kept.limit(0), str(tmp_path / "none"))
    (tmp_path / "bad.json").write_text('{"a": ["x", "y"]}')
    with pytest.raises(Exception, match="wrong entry a"):
        labels.load_map(spark, str(tmp_path / "bad.json")).collect()


def test_truth_keys_and_outcomes(spark):
    row = lambda c, s="income_statement", a=D(2024, 1, 1), z=D(2024, 12, 31): spark.createDataFrame([(c, s, a, z)], "concept string, statement string, period_start date, period_end date")
    r = truth.keyed(row("ifrs-full:Revenue")).first()
    assert (r["taxonomy"], r["name"]) == ("ifrs-full", "Revenue") and truth.keyed(row("a:b", "balance_sheet")).first()["period_start"] is None
    for bad in ("Revenue", "a:b:c", "", ":Revenue", "ifrs-full:"):
        with pytest.raises(Exception, match="taxonomy:Name"):
            truth.keyed(row(bad)).collect()
    for lacking in (row("a:b", None), row("a:b", z=None), row("a:b", a=None)):
        with pytest.raises(Exception, match="is missing"):
            truth.keyed(lacking).collect()
    assert truth.loose_keys(row("a:b", "balance_sheet")).first()["taxonomy"] == "a"
    got = [tuple(r) for r in truth.of_taxonomy(spark.createDataFrame([("us-gaap", "A", None, D(2024, 1, 1), 1), ("ifrs-full", "A", None, D(2024, 1, 1), 2)], "taxonomy string, concept string, period_start date, period_end date, value int")).collect()]
    assert got == [("ifrs-full", "A", None, D(2024, 1, 1), 2)]
    many = spark.createDataFrame([("a", i) for i in range(11)] + [("b", 1)], "class string, v int")
    assert {(r["class"], r["n_more"]) for r in truth.shown(many, [F.col("v")]).collect()} == {("a", 3), ("b", 0)} and truth.shown(many, [F.col("v")]).count() == 9
    texts, cells = texts_of(spark, [("d", 1, 1, 1.0, "t", "b"), ("d", 0, 1, 1.0, "t", "a")]), cells_of(spark, [[["c", ""], ["", "d"]]])
    assert extraction.document_text(texts, cells).first()["text"] == "a b c d"
    near = spark.createDataFrame([("x", "A", 1, 5)], "tax string, concept string, p int, value int")
    gt = spark.createDataFrame([("y", "A", 1, 5)], "tax string, concept string, p int, value int")
    assert facts.classify(near, gt, ["tax", "concept", "p"], gt).first()["class"] == "other_taxonomy"


def test_signals_over_claims(spark):
    kind = "doc string, ord int, claim_type string, scope string, is_company_specific boolean, is_subtotal boolean, value decimal(38,6), period_end date, covers_scope3 boolean, baseline_value double, baseline_year int"
    q = lambda scope, year, value, own=False, o=0: ("d", o, "quantitative", scope, own, True, None if value is None else Decimal(value), D(year, 12, 31), None, None, None)
    t = lambda scope, covers, base=None, year=None: ("d", 1, "target", scope, False, True, None, None, covers, base, year)
    names = lambda *rows: sorted(r["signal"] for r in claims.signals(spark.createDataFrame(list(rows), kind), ["doc"]).collect())
    assert names(q("combined_1_2_reported", 2017, 1250000), q("combined_1_2_reported", 2024, 853000), q("scope_3", 2024, 71458000), t("combined_1_2_reported", False)) == ["dominant_scope_not_targeted"]
    omv = [q("combined_1_2_market", 2019, 13920157), q("combined_1_2_market", 2025, 10286093), q("scope_3", 2019, 134419405), q("scope_3", 2025, 154270286)]
    assert names(*omv, t("scope_3", True)) == ["scope12_down_scope3_up"]
    assert names(q("combined_1_2_market", 2024, 900000), q("scope_3", 2024, 2000000)) == []
    own = [q("scope_3", 2019, 113700000, True), q("scope_3", 2025, 100000000, True)]
    assert names(*omv, *own, t("scope_3", True, 113.7, 2019)) == ["scope12_down_scope3_up", "target_anchored_to_company_specific_metric"]
    assert names(*omv, t("combined_1_2_market", True, 99.9, 2019)) == ["baseline_mismatch", "scope12_down_scope3_up"]
    s = claims.claim_series(spark.createDataFrame([q("scope_1", 2024, None), q("scope_1", 2025, 5), q("scope_1", 2025, 9, o=1)], kind), ["doc"]).collect()
    assert [(r["year"], r["value"], r["n_values"]) for r in s] == [(2025, 9.0, 2)]


def test_index_pages(spark):
    def pages(*texts):
        return spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "doc string, page int, text string")

    index = lambda *t: sorted(r["page"] for r in disclosures.index_pages(pages(*t)).collect())
    assert index("ESRS-Angabepflicht   Seite\nBP-1 Grundlagen   83\n", "other") == [1]
    assert index("above > it\n" + "\n".join(f"  BP-{i}   section 1.{i}" for i in range(5))) == [1] and index("BP-1 Only one heading") == []
    rows, again = disclosures.index_rows(pages("ESRS index\nBP-1 Allgemeine Grundlagen    83\nE1-6 Emissions of\n all kinds     Anhangangabe 7 – Risiken hier    95\nG1-1 Policy section 2.1\nBP-1 Again    84\nE2-1 no reference", "dry", "E1-9 after one dry page    9", "dry", "dry", "E4-1 too late    12"))
    assert [(r["code"], r["claimed"], r["ref_kind"]) for r in rows.orderBy("code").collect()] == [("BP-1", "83", "page"), ("E1-6", "95", "page"), ("E1-9", "9", "page"), ("G1-1", "2.1", "section")]
    assert rows.where("code = 'BP-1'").first()["title"] == "Allgemeine Grundlagen" and rows.where("code = 'E1-6'").first()["incorporated"].startswith("Anhangangabe 7") and [r["code"] for r in again.collect()] == ["BP-1"]
    docs, _, _ = disclosures.reconcile(pages("no index here"))
    assert docs.first()["status"] == "no_index"


def test_contracts(spark):
    schema = {"type": "object", "required": ["sentiment", "confidence", "topics"], "additionalProperties": False, "properties": {"sentiment": {"type": "string", "enum": ["positive", "negative", "neutral"]}, "confidence": {"type": "number", "minimum": 0, "maximum": 1}, "topics": {"type": "array", "minItems": 1, "items": {"type": "string"}}}}
    of = lambda *t: [r[0] for r in spark.createDataFrame([(x,) for x in t], "t string").select(contracts.contract_problems(F.col("t"), schema)).collect()]
    bad, good, more, nothing, kind = of('{"sentiment":"happy","confidence":1.7}', '{"sentiment":"neutral","confidence":1,"topics":["a"]}', '{"sentiment":"neutral","confidence":0,"topics":[1],"x":2}', None, "[]")
    assert len(bad) == 3 and good == [] and more == ["$.topics[0]: expected string, got int", "$.x: unexpected field, remove it"] and nothing == ["$: not a JSON text"] and kind == ["$: expected object, got list"]
    cites = spark.createDataFrame([([0, 7], [0, 1]), (None, [0])], "c array<bigint>, v array<bigint>").select(contracts.false_citations(F.col("c"), F.col("v"))).collect()
    assert [r[0] for r in cites] == [[7], []]


def test_runs(spark):
    kind = "k string, turn int, cost double, is_final boolean, false_cites array<bigint>, signatures array<string>"
    run = lambda *t: tuple(control.run_ends(spark.createDataFrame([("r", i + 1, *x) for i, x in enumerate(t)], kind), "k", 0.0005, 3, 2).first())[1:]
    call, cheap = (0.0002, False, [], ["f(1)"]), (0.0, False, [], ["f(1)"])
    other = lambda i: (0.0, False, [], [f"g({i})"])
    assert run(cheap, cheap, cheap) == ("LOOP_DETECTED", 3) and run(other(1), other(2), other(3)) == ("MAX_TURNS", 3) and run(other(1)) == ("RUNNING", 1)
    assert run((0.0006, False, [], ["a"]), (0.0, False, [], ["b"])) == ("BUDGET_EXCEEDED", 2) and run(call, (0.0, True, [], [])) == ("COMPLETED", 2)
    assert run(call, (0.0, True, [7], [])) == ("UNGROUNDED", 2) and run((0.0, False, [], [])) == ("NO_ACTION", 1)
    waits = spark.createDataFrame([("7", 1), ("bad", 3), ("99999", 0), (None, 2), ("-5", 1)], "h string, i int").select(control.retry_after(F.col("h"), F.col("i"))).collect()
    assert [r[0] for r in waits] == [7.0, 8.0, 60.0, 4.0, 0.0]
    states = spark.createDataFrame([(s,) for s in (429, 500, 502, 503, 504, 403, 200)], "s int").select(control.is_retryable(F.col("s"))).collect()
    assert [r[0] for r in states] == [True] * 5 + [False] * 2
    assert signals.unit_suspects(spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 500.0)], "k string, y int, v double"), ["k"], "y", "v").where("suspect").first()["y"] == 3
    assert spark.range(1).select(signals.composite(F.lit(True), (0.25, F.lit(2.0)), (0.5, F.lit(1.0)))).first()[0] == 1.0 and spark.range(1).select(signals.composite(F.lit(False), (1, F.lit(1.0)))).first()[0] == 0.0
    assert tuple(traces.latency(spark.createDataFrame([(float(i),) for i in range(101)], "v double"), F.col("v")).first()) == (50.0, 95.0)


def test_more_precise_repeats(spark):
    rows = [("a", 0, 1, None), ("a", 1, 2, 0), ("a", 2, 3, -3), ("b", 0, 5, 2), ("b", 1, 5, 9), ("b", 2, 6, 5), ("c", 0, 1, 1 << 20), ("c", 1, 2, 6)]
    got = facts.keep_more_precise(spark.createDataFrame(rows, "k string, o int, v int, d int"), ["k"], "v", "d", ["o"])
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [("a", 2), ("b", 6), ("c", 1)]
    found = spark.createDataFrame([("sign_flip", 9.0), ("value_change", 0.1), ("value_change", None), ("value_change", 0.5)], "kind string, rel_delta double")
    assert [tuple(r) for r in facts.ranked_restatements(found).collect()] == [("value_change", 0.5), ("value_change", 0.1), ("value_change", None), ("sign_flip", 9.0)]
    assert facts.duplicates(spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k int, o int"), ["k"], [F.col("o")]).collect()[0]["o"] == 2


def test_tagged_facts(spark, tmp_path):
    page = '<xbrli:context id="c"><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-12-31</xbrli:endDate></xbrli:context><xbrli:context id="m"><xbrldi:explicitMember/><xbrli:instant>2024-12-31</xbrli:instant></xbrli:context>'
    tag = lambda name, value, unit="EUR", more="", ctx="c": f'<ix:nonFraction name="{name}" contextRef="{ctx}" unitRef="{unit}" {more}>{value}</ix:nonFraction>'
    page += tag("ifrs-full:Revenue", "24.308", more='format="ixt5:num-comma-decimal" scale="6" decimals="-6"') + tag("ifrs-full:Revenue", "24.309", more='format="ixt5:num-comma-decimal" scale="6" decimals="INF"') + tag("us-gaap:Tax", "1,834", "iso4217-USD", 'sign="-" scale="0"') + tag("us-gaap:Zero", "—", "U_USD", 'format="ixt:fixed-zero"')
    page += tag("us-gaap:EPS", "3", "usdPerShare") + tag("us-gaap:A", "1", ctx="m") + tag("x:A", "1") + tag("us-gaap:B", "–") + tag("us-gaap:C", "abc") + '<ix:nonFraction name="us-gaap:N" contextRef="c" unitRef="EUR" xsi:nil="true"/>'
    pages = spark.createDataFrame([("d", page)], "doc string, text string")
    contexts = readers.ixbrl_contexts(pages)
    assert [(r["context"], r["start"], r["end"]) for r in contexts.collect()] == [("c", D(2024, 1, 1), D(2024, 12, 31))]
    got = {r["concept"]: r["value"] for r in readers.ixbrl_facts(pages, contexts).collect()}
    assert got == {"Revenue": Decimal(24309000000), "Tax": Decimal(-1834), "Zero": Decimal(0)}
    assert {(r["drop_reason"], r["n"]) for r in readers.drop_counts(readers.ixbrl_tags(pages, contexts)).collect()} == {("not_money", 1), ("dimensional", 1), ("other_taxonomy", 1), ("nil", 2), ("unparseable", 1)}
    units = [r[0] for r in spark.createDataFrame([(u,) for u in ("USD", "usd", "U-EUR", "iso4217_GBP", "ISO4217NOK", "usdPerShare", "shares", "")], "u string").select(readers.currency_of(F.col("u"))).collect()]
    assert units == ["USD", "USD", "EUR", "GBP", "NOK", None, None, None]


def test_readers(spark, tmp_path):
    put = lambda name, value: (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value)) and str(tmp_path / name)
    rows = [{"val": 5, "accn": "a", "form": "10-K", "filed": "2025-01-01", "start": "2024-01-01", "end": "2024-12-31"}, {"val": 6, "accn": "a", "form": "10-K", "filed": "2025-02-01", "start": "2024-01-01", "end": "2024-12-31"}, {"val": 7, "accn": "b", "form": "10-Q", "filed": "2025-01-01", "end": "2024-03-31"}]
    got = readers.company_facts(spark, put("c.json", {"facts": {"us-gaap": {"Assets": {"units": {"USD": rows, "EUR": rows}}}}})).collect()
    assert [(r["concept"], r["value"], r["accn"]) for r in got] == [("Assets", Decimal(6), "a")]
    paged = readers.paged_text(spark, put("p.txt", "one\ftwo")).collect()
    assert [(r["page"], r["text"]) for r in paged] == [(0, "one"), (1, "two")] and len(paged[0]["sha256"]) == 64
    gold_ = spark.createDataFrame([({"is": {"revenue": [("FY24", "EUR", 1000, 5.0)]}},)], "gold map<string,map<string,array<struct<data_period:string,unit:string,scale:long,value:double>>>>")
    assert [tuple(r) for r in readers.gold_values(gold_).collect()] == [("is", "revenue", "FY24", "EUR", 1000, 5.0)]
    docs = spark.createDataFrame([("file:/x/a.docling.json",), ("file:/x/b.json",)], "doc string")
    meta = spark.createDataFrame([("a", "ff", "2")], "stem string, sha256 string, parser_version string")
    assert sorted((r["stem"], r["sha256"], r["parser_version"]) for r in readers.with_sidecar(docs, meta).collect()) == [("a", "ff", "2"), ("b", "", "unknown")]
    line = {"statement": "x", "line_item_canonical": "a:b", "value": None, "period_end": "2024-12-31"}
    assert [r["drop_reason"] for r in readers.extracted_facts(spark, put("e.jsonl", json.dumps(line) + "\n\n" + json.dumps(line | {"value": 5}) + "\n")).collect()] == ["nil_value", None]
    full = readers.extraction_rows(spark, put("f.jsonl", json.dumps(line | {"value": 1250, "value_raw_text": "1,250", "groundedness_verified": True, "source_ref": {"page_no": 3, "verbatim_span": "1,250", "col_header_path": ["2024"]}})))
    assert gates.gate(full).first()["flags"] == []
    with pytest.raises(Exception):  # noqa: B017  Spark's own class
        readers.json_lines(spark, put("broken.jsonl", '{"k": "a"}\n{broken\n'), "k string").collect()

    def convert(content, path):
        return {"n": len(content)} if content != b"bad" else 1 / 0

    put("x.bin", "good"), put("y.bin", "bad")
    made = {r["ok"]: r for r in readers.converted(spark, f"{tmp_path}/*.bin", convert).collect()}
    assert made[True]["json"] == '{"n": 4}' and made[False]["error"].startswith("ZeroDivisionError")
    answers = readers.fetched(spark.createDataFrame([(f"file://{tmp_path}/x.bin",), (f"file://{tmp_path}/none",)], "url string"), retries=2, wait=lambda s: None).collect()
    assert bytes(answers[0]["content"]) == b"good" and answers[1]["content"] is None and answers[1]["error"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 4)], "k string, n int")
    at = lambda name: str(tmp_path / name)
    sinks.write_json_lines(df, at("j"))
    assert spark.read.json(at("j")).count() == 3
    sinks.write_csv_with_total(df, at("c"), "k", ["n"])
    assert sorted((r["k"] or "", r["n"]) for r in spark.read.csv(at("c"), header=True).collect()) == [("", "4"), ("TOTAL", "7"), ("a", "3")]
    for n in (2, 3):
        sinks.write_replacing(df.limit(n), at("r"))
        assert spark.read.parquet(at("r")).count() == n
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("r")) == ["r"]
    assert sinks.write_if_absent(df, at("once")) and not sinks.write_if_absent(df.limit(1), at("once")) and spark.read.json(at("once")).count() == 3
    (tmp_path / "files" / "sub").mkdir(parents=True)
    (tmp_path / "files" / "sub" / "a").write_text("x")
    files = sinks.files_in(spark, at("files"))
    assert [r[0] for r in files.collect()] == ["sub/a"]
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "local_path string")
    assert sorted(r[0] for r in sinks.not_yet_fetched(keys("sub/a", "b", "c"), keys("sub/a", "b"), files=files).collect()) == ["b", "c"]
    assert sinks.not_yet_fetched(keys("a", "b"), keys("a")).first()[0] == "b"
    content = sinks.content_addressed(spark.read.format("binaryFile").load(at("files/sub"))).first()
    assert content["bytes"] == 1 and len(content["sha256"]) == 64
    sinks.write_partitioned_facts(spark.createDataFrame([(2024, "c", D(2024, 1, 1)), (2023, "d", D(2023, 1, 1))], "fiscal_year int, company_id string, period_end date"), at("y"))
    assert spark.read.parquet(at("y")).where("fiscal_year = 2024").count() == 1
    made = gold.gold(spark.createDataFrame([("d", "ifrs-full", "Revenue", D(2024, 12, 31), "EUR", 5e6), ("d", "ifrs-full", "Revenue", D(2023, 12, 31), "EUR", 4e6), ("d", "ifrs-full", "Nope", D(2025, 12, 31), "EUR", 1.0)], "doc string, taxonomy string, concept string, period_end date, unit string, value double"), 1_000_000).first()
    assert [v["value"] for v in json.loads(made["vals"])] == [5.0, 4.0] and (made["section"], made["field"], made["latest"]) == ("income_statement", "revenue", "FY2024")
    gold.write_schema(spark, at("s"))
    assert set(json.loads(spark.read.text(at("s")).first()[0])["properties"]) == {"meta", "income_statement", "balance_sheet", "cash_flow_statement"} and len(gold.FIELDS) == 25


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.collapse(F.lit("  a  b\n"))) == "a b" and one(X.normalize(F.lit("A-b, C!"))) == "a b c" and one(X.jaccard(F.lit("a b"), F.lit("B c"))) == pytest.approx(1 / 3) and one(X.jaccard(F.lit(""), F.lit(""))) == 0
    assert one(X.holds_phrase(F.lit("EUR"), F.lit("in eur million"))) and not one(X.holds_phrase(F.lit("USD"), F.lit("in eur"))) and not one(X.holds_phrase(F.lit("--"), F.lit("in eur")))
    assert sorted(one(N.input_numbers(F.lit("24.308 and 13.920.157 so 1.234,5")))) == [1234.5, 24308.0, 13920157.0]
    assert one(N.sign_flipped(F.lit(-5000.0), F.array(F.lit(5000.0)))) and not one(N.sign_flipped(F.lit(5000.0), F.array(F.lit(5000.0))))
    v = X.unit_vector("Refunds refund")
    assert sum(x * x for x in v) == pytest.approx(1) and len(v) == 1024 and X.unit_vector("") == [0.0] * 1024
    import hashlib

    h = hashlib.blake2b(b"refund", digest_size=8).digest()
    assert X.feature_counts("refund")[int.from_bytes(h[:4], "big") % 1024] != 0 and set(X.feature_counts("ab")) == {int.from_bytes(hashlib.blake2b(b"ab", digest_size=8).digest()[:4], "big") % 1024}


def test_pages_and_rows(spark):
    pages = spark.createDataFrame([("d", i, w) for i, w in enumerate([True, False, True, False, False, True])], "doc string, page int, wet boolean")
    assert sorted(r["page"] for r in grids.until_two_dry(pages, "doc", "page", F.col("wet")).collect()) == [0, 1, 2]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(["x", "# a", "b", "# c"])], "doc string, line int, text string")
    assert [r["text"] for r in grids.assemble_rows(lines, "doc", "line", "text", F.col("text").startswith("#")).orderBy("row").collect()] == ["# a b", "# c"]
    gold_ = spark.createDataFrame([("a", 1, 100.0), ("a", 2, 7.0), ("b", 1, 10000.0)], "doc string, id int, value double")
    held = spark.createDataFrame([("a", 100.0), ("b", 100.2), ("c", 10040.0), ("b", 9.0)], "doc string, value double")
    assert {(r["doc"], r["id"]): (r["hit_own"], r["hit_other"]) for r in grids.coverage(gold_, held).collect()} == {("a", 1): (1, 1), ("a", 2): (0, 0), ("b", 1): (0, 1)}


def test_passages_are_found(spark):
    docs = spark.createDataFrame([(1, "xx one two three four five six seven eight nine yy"), (2, "one two three"), (3, "zone two threefold"), (4, None), (5, "one  two three")], "id int, t string")
    asked = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, "one two three"), (3, "o two t"), (4, None)], "qid int, passage string")
    got = sorted(tuple(r) for r in retrieval.holding(docs, asked, "id", "t").collect())
    assert got == [(1, 1), (2, 1), (2, 2), (2, 3)]
    with pytest.raises(Exception, match="three words"):
        retrieval.holding(docs, spark.createDataFrame([(1, "a b")], "qid int, passage string"), "id", "t").collect()


def test_candidate_index_recall(spark):
    """The ten best of the index against brute force, for every query."""
    ids, vecs = zip(*duck("/root/testdata/sf0.1").sql("select vec_id, embedding from embeddings order by 1").fetchall())
    vecs = np.array(vecs, float)
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    got = {}
    for r in queries.QUERIES["dense_index"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["qid"], set()).add(r["id"])
    want = {}
    for q in (i for i in ids if i % 50 == 0):
        score = (vecs @ vecs[ids.index(q)]).round(8)
        want[q] = {i for _, i in sorted((-s, i) for s, i in zip(score, ids) if s > 0.2)[:10]}
    recall = sum(len(want[q] & got.get(q, set())) for q in want) / sum(map(len, want.values()))
    assert recall >= 0.9, recall


def test_statement_timeout(spark):
    slow = "select count(*) from range(0, 1000000000000) where id % 7 = hash(id)"
    assert rowsets.score_sql(spark, "select 1", slow, timeout_s=1.0) == "TIMEOUT"
    assert rowsets.score_sql(spark, "select 1", "select 1", timeout_s=60) == "PASS"


def test_breaker_stream(spark, tmp_path):
    rows = [("p", i, ok) for i, ok in ((0, False), (1, False), (2, False), (3, True), (40, True))]
    spark.createDataFrame(rows, "provider string, s int, ok boolean").select("provider", F.timestamp_seconds("s").alias("ts"), "ok").coalesce(1).write.parquet(str(tmp_path / "in"))
    calls = spark.readStream.schema("provider string, ts timestamp, ok boolean").parquet(str(tmp_path / "in"))
    run = breaker_states(calls).writeStream.format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [r["state"] for r in spark.table("states").orderBy("ts").collect()] == ["CLOSED", "CLOSED", "CLOSED", "OPEN", "HALF_OPEN"]
    assert step(0.0, 3, 31.0, False, 3, 30)[1] == 31.0  # a failed trial opens it again
