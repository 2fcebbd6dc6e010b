"""Accounting rules over facts: rule tables, their evaluation with reasons, cash continuity, reports.

Facts are (owner, taxonomy, concept, unit, period_start, period_end, accn, filed, value, tol); an instant has no
period_start. A rule holds inside one filing only: all its terms come from the newest filing that has them all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.sources.stage import staged

PERIOD = ["owner", "taxonomy", "period_start", "period_end"]
_DECIMAL = "decimal(38,6)"


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str  # instant or duration
    terms: tuple[tuple[str, int], ...]  # (concept, coefficient)
    total: str
    taxonomy: str
    since: int = 0
    until: int = 9999
    op: str = "eq"
    fallback_for: str | None = None
    severity: str = "blocker"


# The rules of two taxonomies. Rules of one name are variants, of which one that holds is enough.
_PRETAX = "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest"
_WHOLE_EQUITY = "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"
_CASH_CHANGE = "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalentsPeriodIncreaseDecreaseIncludingExchangeRateEffect"
_FX = "EffectOfExchangeRateOnCashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"
US_GAAP = (
    Rule("balance_sheet", "instant", (("Assets", 1),), "LiabilitiesAndStockholdersEquity", "us-gaap"),
    Rule("balance_sheet_split", "instant", (("Liabilities", 1), (_WHOLE_EQUITY, 1)), "Assets", "us-gaap"),
    Rule("equity_split", "instant", (("StockholdersEquity", 1), ("MinorityInterest", 1)), _WHOLE_EQUITY, "us-gaap"),
    Rule("income_before_tax", "duration", (("Revenues", 1), ("CostsAndExpenses", -1)), _PRETAX, "us-gaap", since=2017),
    Rule("profit_after_tax", "duration", ((_PRETAX, 1), ("IncomeTaxExpenseBenefit", -1)), "ProfitLoss", "us-gaap"),
    Rule("net_income_split", "duration", (("NetIncomeLoss", 1), ("NetIncomeLossAttributableToNoncontrollingInterest", 1)), "ProfitLoss", "us-gaap"),
    Rule("cash_flow_roll", "duration", (("NetCashProvidedByUsedInOperatingActivities", 1), ("NetCashProvidedByUsedInInvestingActivities", 1), ("NetCashProvidedByUsedInFinancingActivities", 1), (_FX, 1)), _CASH_CHANGE, "us-gaap"),
)
_FLOWS = (("CashFlowsFromUsedInOperatingActivities", 1), ("CashFlowsFromUsedInInvestingActivities", 1), ("CashFlowsFromUsedInFinancingActivities", 1))
_TAXED = (("ProfitLossBeforeTax", 1), ("IncomeTaxExpenseContinuingOperations", -1))
IFRS = (
    Rule("balance_sheet", "instant", (("Assets", 1),), "EquityAndLiabilities", "ifrs-full"),
    Rule("balance_sheet_split", "instant", (("Liabilities", 1), ("Equity", 1)), "Assets", "ifrs-full"),
    Rule("equity_split", "instant", (("EquityAttributableToOwnersOfParent", 1), ("NoncontrollingInterests", 1)), "Equity", "ifrs-full"),
    Rule("profit_after_tax", "duration", _TAXED, "ProfitLoss", "ifrs-full"),
    Rule("profit_after_tax", "duration", (*_TAXED, ("ProfitLossFromDiscontinuedOperations", 1)), "ProfitLoss", "ifrs-full"),
    Rule("net_income_split", "duration", (("ProfitLossAttributableToOwnersOfParent", 1), ("ProfitLossAttributableToNoncontrollingInterests", 1)), "ProfitLoss", "ifrs-full"),
    Rule("cash_flow_roll", "duration", (*_FLOWS, ("EffectOfExchangeRateChangesOnCashAndCashEquivalents", 1)), "IncreaseDecreaseInCashAndCashEquivalents", "ifrs-full"),
    Rule("cash_flow_roll_pre_fx", "duration", _FLOWS, "IncreaseDecreaseInCashAndCashEquivalentsBeforeEffectOfExchangeRateChanges", "ifrs-full", fallback_for="cash_flow_roll"),
    Rule("revenue_subset", "duration", (("RevenueFromContractsWithCustomers", 1),), "Revenue", "ifrs-full", op="lte"),
)
RULES = US_GAAP + IFRS
#: By taxonomy the concepts of a cash balance, the preferred one first, and of its change.
CASH = {
    "us-gaap": (("CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents",), _CASH_CHANGE),
    "ifrs-full": (("CashAndCashEquivalentsIfDifferentFromStatementOfFinancialPosition", "CashAndCashEquivalents"), "IncreaseDecreaseInCashAndCashEquivalents"),
}


def period_kind(start: Column, end: Column) -> Column:
    """instant, annual (11 to 13 months) or interim_Nm; months of 30.44 days, halves to the even one."""
    months = F.bround(F.datediff(end, start) / 30.44).cast("int")
    return F.when(start.isNull(), "instant").when(months.between(11, 13), "annual").otherwise(F.concat(F.lit("interim_"), months.cast("string"), F.lit("m")))


def rule_terms(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """(id, concept, coef, ord): a rule's terms in order; its total comes last, with coefficient null."""
    rows = [(i, c, k, o) for i, r in enumerate(rules) for o, (c, k) in enumerate([*r.terms, (r.total, None)])]
    return spark.createDataFrame(rows, "id int, concept string, coef int, ord int")


def rule_heads(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [(i, r.name, r.kind, r.taxonomy, r.since, r.until, r.op, r.fallback_for, r.severity, len(r.terms) + 1) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "id int, name string, kind string, taxonomy string, since int, until int, op string, fallback_for string, severity string, needed int")


def latest_per_concept(facts: DataFrame) -> DataFrame:
    """One fact a filing and concept of each period: of repeats the one filed last, then the largest."""
    pick = F.max_by(F.struct("unit", "value", "tol", "filed"), F.struct("filed", "value"))
    return facts.groupBy(*PERIOD, "accn", "concept").agg(pick.alias("f")).select(*PERIOD, "accn", "concept", "f.*")


def _chosen(facts: DataFrame, spark: SparkSession, rules: tuple[Rule, ...], cross_filing: bool) -> DataFrame:
    """For each rule and period (id, PERIOD, parts, missing): the terms from the newest filing that has all, or the names
    that the filing nearest to it lacks. Both aggregates keep the period's partitioning: facts move once."""
    terms, heads = F.broadcast(rule_terms(spark, rules)), F.broadcast(rule_heads(spark, rules).select("id", "taxonomy", "needed"))
    every = F.broadcast(rule_terms(spark, rules).groupBy("id").agg(F.collect_set("concept").alias("names")))
    met = facts.repartition(*PERIOD).join(terms, "concept").join(heads, ["id", "taxonomy"])
    part = F.struct("ord", "concept", "coef", "unit", "value", "tol", "accn")
    if cross_filing:
        # of all filings the newest value of each concept; values that differ between filings are a conflict
        each = met.groupBy("id", *PERIOD, "ord").agg(F.max_by(part, F.struct("filed", "accn")).alias("p"), (F.count_distinct("value") > 1).alias("torn"), F.first("needed").alias("needed"))
        whole = each.groupBy("id", *PERIOD).agg(F.sort_array(F.collect_list("p")).alias("parts"), F.max("torn").alias("torn"), F.max("needed").alias("needed"))
        lacks = F.array_except("names", F.transform("parts", lambda p: p["concept"]))
        out = whole.join(every, "id").withColumn("missing", F.sort_array(F.when(F.size(lacks) > 0, lacks).when(F.col("torn"), F.array(F.lit("values of filings differ"))).otherwise(lacks)))
        return out.select("id", *PERIOD, "parts", "missing")
    filings = met.groupBy("id", *PERIOD, "accn").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.max("filed").alias("newest"), F.max("needed").alias("needed"))
    best = F.max_by("parts", F.struct((F.size("parts") - F.col("needed")).alias("n"), "newest", "accn"))
    out = filings.groupBy("id", *PERIOD).agg(best.alias("parts")).join(every, "id")
    return out.select("id", *PERIOD, "parts", F.sort_array(F.array_except("names", F.transform("parts", lambda p: p["concept"]))).alias("missing"))


def check_rules(facts: DataFrame, rules: tuple[Rule, ...] = RULES, year: int | None = None, annual: bool = True, cross_filing: bool = False) -> DataFrame:
    """(identity, PERIOD, status, reason, lhs, rhs, delta, tol, op, unit, accn, suspect): PASS, FAIL (WARN where the rule is for
    review), SKIP or N/A with a reason. The tolerance is the terms' sum, not weighted. A FAIL that turning one term's
    sign mends names the first such term. A fallback is asked only where its rule lacks concepts; of variants of a
    name, one that holds hides the others of its period."""
    spark = facts.sparkSession
    # read twice, for the periods and for the terms
    plain = staged(latest_per_concept(facts))
    periods = plain.select(*PERIOD).distinct().withColumn("period_kind", period_kind(F.col("period_start"), F.col("period_end")))
    if year is not None:
        periods = periods.where(F.year("period_end") == year)
    heads = F.broadcast(rule_heads(spark, rules).drop("needed"))
    asked = periods.join(heads, "taxonomy").where((F.col("kind") == "instant") == F.col("period_start").isNull())
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"c.{c}"))
    found = _chosen(plain, spark, rules, cross_filing)
    met = asked.alias("a").join(found.alias("c"), (F.col("a.id") == F.col("c.id")) & same("owner") & same("taxonomy") & same("period_start") & same("period_end"), "left").select("a.*", "c.parts", "c.missing")
    names = F.broadcast(rule_terms(spark, rules).groupBy("id").agg(F.sort_array(F.collect_set("concept")).alias("names")))
    met = met.join(names, "id").withColumn("missing", F.coalesce("missing", "names"))
    terms = F.filter("parts", lambda p: p["coef"].isNotNull())
    total = F.get(F.filter("parts", lambda p: p["coef"].isNull()), F.lit(0))
    zero = F.lit(0).cast(_DECIMAL)
    signed = lambda p: (p["value"] * p["coef"]).cast(_DECIMAL)
    full = F.size("missing") == 0
    met = met.withColumns(
        {
            "lhs": F.when(full, F.aggregate(terms, zero, lambda a, p: (a + signed(p)).cast(_DECIMAL))),
            "rhs": F.when(full, total["value"].cast(_DECIMAL)),
            "tol": F.when(full, F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["tol"].cast("double"))),
            "units": F.sort_array(F.array_distinct(F.transform("parts", lambda p: p["unit"]))),
        }
    ).withColumn("delta", (F.col("lhs") - F.col("rhs")).cast(_DECIMAL))
    interim = F.lit(annual) & F.col("period_kind").startswith("interim")
    outside = ~F.year("period_end").between(F.col("since"), F.col("until"))
    mixed = F.size("units") > 1
    good = F.when(F.col("op") == "lte", F.col("delta") <= F.col("tol")).otherwise(F.abs("delta") <= F.col("tol"))
    failed = F.when(F.col("severity") == "blocker", "FAIL").otherwise("WARN")
    status = F.when(interim | outside, "N/A").when(~full | mixed, "SKIP").when(good, "PASS").otherwise(failed)
    reason = (
        F.when(interim, F.concat(F.lit("rules of whole statements do not apply to "), F.col("period_kind")))
        .when(outside, F.concat(F.lit("outside "), F.col("since").cast("string"), F.lit(" to "), F.col("until").cast("string")))
        .when(~full, F.concat(F.lit("no filing has all: "), F.array_join("missing", ", ")))
        .when(mixed, F.concat(F.lit("currencies differ: "), F.array_join("units", ", ")))
    )
    fits = F.filter(terms, lambda p: F.abs(F.col("delta") - 2 * signed(p)) <= F.col("tol"))
    met = met.withColumns({"status": status, "reason": reason}).withColumn("lacking", (F.col("status") == "SKIP") & (F.size("missing") > 0))
    tried = Window.partitionBy(*PERIOD)
    skipped = F.collect_set(F.when(F.col("lacking"), F.col("name"))).over(tried)
    met = met.withColumn("_skipped", skipped).where(F.col("fallback_for").isNull() | F.col("status").eqNullSafe("N/A") | F.array_contains("_skipped", F.col("fallback_for")))
    passed = F.max((F.col("status") == "PASS").cast("int")).over(Window.partitionBy(*PERIOD, "name"))
    met = met.withColumn("_passed", passed).where("_passed = 0 or status = 'PASS'")
    ran = F.col("status").isin("PASS", "FAIL", "WARN")
    only = lambda c: F.when(ran, c)
    return met.select(
        F.col("name").alias("identity"),
        *PERIOD,
        "status",
        "reason",
        *(only(F.col(c)).alias(c) for c in ("lhs", "rhs", "delta", "tol", "op")),
        only(F.get("units", F.lit(0))).alias("unit"),
        only(total["accn"]).alias("accn"),
        F.when(F.col("status").isin("FAIL", "WARN"), F.get(fits, F.lit(0))["concept"]).alias("suspect"),
    )


def cash_continuity(facts: DataFrame, cash: dict = CASH, annual: bool = True) -> DataFrame:
    """(owner, taxonomy, period_start, period_end, status, reason, balance_concept, delta, tol): the closing balance less
    that of the day before the period begins against the change. The first preferred concept that has both balances
    counts. What does not fit is a WARN: a review, not a blocker."""
    plain = staged(latest_per_concept(facts))
    newest = plain.groupBy(*PERIOD, "concept").agg(F.max_by(F.struct("value", "tol", "unit"), F.struct("filed", "accn")).alias("f"))
    order = F.create_map(*[F.lit(x) for t, (prefs, _) in cash.items() for i, c in enumerate(prefs) for x in (f"{t}:{c}", i)])
    rank = F.element_at(order, F.concat_ws(":", "taxonomy", "concept"))
    balances = newest.where("period_start is null").withColumn("rank", rank).where("rank is not null").select("owner", "taxonomy", F.col("period_end").alias("day"), "concept", "rank", "f")
    change = F.coalesce(*[F.when((F.col("taxonomy") == t) & (F.col("concept") == c), F.col("f")) for t, (_, c) in cash.items()])
    spans = newest.where(F.col("period_start").isNotNull() & F.col("taxonomy").isin(*cash)).groupBy(*PERIOD).agg(F.max(change).alias("change"))
    if annual:
        spans = spans.where(~period_kind(F.col("period_start"), F.col("period_end")).startswith("interim"))
    end = balances.select("owner", "taxonomy", F.col("day").alias("period_end"), "concept", "rank", F.col("f").alias("closing"))
    begin = balances.select("owner", "taxonomy", F.date_add("day", 1).alias("period_start"), "concept", F.col("f").alias("opening"))
    both = spans.join(end, ["owner", "taxonomy", "period_end"]).join(begin, ["owner", "taxonomy", "period_start", "concept"])
    best = both.groupBy(*PERIOD).agg(F.min_by(F.struct("concept", "closing", "opening"), "rank").alias("b"))
    met = spans.join(best, PERIOD, "left")
    lacking = F.col("b").isNull() | F.col("change").isNull()
    mixed = F.size(F.array_distinct(F.array("b.closing.unit", "b.opening.unit", "change.unit"))) > 1
    delta = F.col("b.closing.value") - F.col("b.opening.value") - F.col("change.value")
    tol = F.col("b.closing.tol") + F.col("b.opening.tol") + F.col("change.tol")
    status = F.when(lacking | mixed, "SKIP").when(F.abs(delta) <= tol, "PASS").otherwise("WARN")
    reason = F.when(lacking, "no opening or closing balance").when(mixed, "currencies differ")
    ran = ~(lacking | mixed)
    return met.select(*PERIOD, status.alias("status"), reason.alias("reason"), F.when(ran, F.col("b.concept")).alias("balance_concept"), F.when(ran, delta).alias("delta"), F.when(ran, tol).alias("tol"))


def status_counts(results: DataFrame, by: list[str]) -> DataFrame:
    """A row a group with a column for each status."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s.lower().replace("/", ""))
    return results.groupBy(*by).agg(*map(n, ("PASS", "FAIL", "WARN", "SKIP", "N/A")))


def report(results: DataFrame) -> DataFrame:
    """Results in the order in which they are read: by period, then by rule."""
    return results.orderBy("owner", "period_end", "period_start", "identity")
