"""Gold data from facts: concepts mapped to sections and fields, and the schema that scores them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.sinks import build_gold

# Concept to section and field.
FIELDS = {
    "Revenue": ("income_statement", "revenue"),
    "RevenueAndOperatingIncome": ("income_statement", "revenue"),
    "OperatingExpense": ("income_statement", "operating_expense"),
    "ProfitLossFromOperatingActivities": ("income_statement", "operating_profit"),
    "ProfitLossBeforeTax": ("income_statement", "profit_before_tax"),
    "IncomeTaxExpenseContinuingOperations": ("income_statement", "income_tax_expense"),
    "ProfitLoss": ("income_statement", "profit_loss"),
    "ProfitLossAttributableToOwnersOfParent": ("income_statement", "profit_attributable_to_owners"),
    "ProfitLossAttributableToNoncontrollingInterests": ("income_statement", "profit_attributable_to_nci"),
    "Assets": ("balance_sheet", "total_assets"),
    "NoncurrentAssets": ("balance_sheet", "non_current_assets"),
    "CurrentAssets": ("balance_sheet", "current_assets"),
    "Liabilities": ("balance_sheet", "total_liabilities"),
    "NoncurrentLiabilities": ("balance_sheet", "non_current_liabilities"),
    "CurrentLiabilities": ("balance_sheet", "current_liabilities"),
    "Equity": ("balance_sheet", "total_equity"),
    "EquityAttributableToOwnersOfParent": ("balance_sheet", "equity_attributable_to_owners"),
    "NoncontrollingInterests": ("balance_sheet", "non_controlling_interests"),
    "EquityAndLiabilities": ("balance_sheet", "total_equity_and_liabilities"),
    "CashAndCashEquivalents": ("balance_sheet", "cash_and_cash_equivalents"),
    "CashFlowsFromUsedInOperatingActivities": ("cash_flow_statement", "operating_activities"),
    "CashFlowsFromUsedInInvestingActivities": ("cash_flow_statement", "investing_activities"),
    "CashFlowsFromUsedInFinancingActivities": ("cash_flow_statement", "financing_activities"),
    "EffectOfExchangeRateChangesOnCashAndCashEquivalents": ("cash_flow_statement", "effect_of_exchange_rate"),
    "IncreaseDecreaseInCashAndCashEquivalentsBeforeEffectOfExchangeRateChanges": ("cash_flow_statement", "net_change_in_cash"),
}
TOLERANCE = 0.001


def mapped(facts: DataFrame, scale: int) -> DataFrame:
    """(doc, section, field, data_period, unit, scale, value) of facts (doc, taxonomy, concept, period_end, unit, value); concepts
    without a field are left out."""
    rows = [(c, s, f) for c, (s, f) in FIELDS.items()]
    fields = F.broadcast(facts.sparkSession.createDataFrame(rows, "concept string, section string, field string"))
    met = facts.where("taxonomy = 'ifrs-full'").join(fields, "concept")
    return met.select("doc", "section", "field", F.concat(F.lit("FY"), F.year("period_end").cast("string")).alias("data_period"), "unit", F.lit(scale).cast("long").alias("scale"), (F.col("value").cast("double") / scale).alias("value"))


def gold(facts: DataFrame, scale: int) -> DataFrame:
    """(doc, section, field, vals, latest): a field's values as JSON, newest first, and the document's latest period."""
    rows = mapped(facts, scale)
    last = rows.groupBy("doc").agg(F.max("data_period").alias("latest"))
    return build_gold(rows, ["doc"]).join(last, "doc")


def schema() -> dict:
    """A JSON schema of sections and fields; numbers are scored within TOLERANCE, text without case."""
    text = lambda how: {"type": "string", "evaluation_config": how}
    number = {"anyOf": [{"type": "null"}, {"type": "number"}], "evaluation_config": {"metrics": [{"metric_id": "number_tolerance", "params": {"tolerance": TOLERANCE}}]}}
    defs = {"unit": text("string_case_insensitive"), "scale": {"anyOf": [{"type": "null"}, {"type": "integer"}], "evaluation_config": "integer_exact"}, "value": number, "data_period": text("string_exact")}
    item = {"type": "array", "items": {"type": "object", "properties": {k: {"$ref": f"#/$defs/{k}"} for k in ("data_period", "unit", "scale", "value")}}}
    meta = {"type": "object", "properties": {"company": text("string_case_insensitive"), "report_period": {"$ref": "#/$defs/data_period"}, "report_period_end_date": text("string_exact")}}
    sections = {s: {"type": "object", "properties": {f: item for t, f in FIELDS.values() if t == s}} for s, _ in FIELDS.values()}
    return {"type": "object", "$defs": defs, "properties": {"meta": meta, **sections}}


def write_schema(spark, path: str) -> None:
    """The schema as one JSON text."""
    spark.createDataFrame([(json.dumps(schema(), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
