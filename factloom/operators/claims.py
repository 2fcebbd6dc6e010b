"""Claims of sustainability reports: emission cells, targets from pairs of tables, and the signals over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numbers import parse_strict
from factloom.functions.text import collapse, squash
from factloom.operators.extraction import TABLE, column_groups, fact_id, table_id
from factloom.operators.grids import header_columns
from factloom.operators.signals import BASELINE_TOL, DOMINANT_RATIO, change

# Scopes that stand for scope 1 and 2 together, in order of preference.
SCOPE_12 = ("combined_1_2_market", "combined_1_2_reported")
MILLION = 1e6


@dataclass(frozen=True)
class ClaimProfile:
    separator: str
    unit_pattern: str
    unit_factor: int
    unit_in_rows: bool  # the unit stands in each row's first cells, not once for the table
    baseline_pattern: str
    labels: tuple[tuple[str, str, bool], ...]  # (printed label, scope, is_subtotal)
    boundary: str = "operational control"
    specific: str = "unternehmensspezifisch"
    target_heading: str | None = None  # one group: 1 or 3
    baseline_year: str = ""
    baseline_value: str = ""
    in_scope: str = ""
    out_of_scope: str = ""
    target_pattern: str = ""
    net_zero: str = ""


def _unit_hits(text: Column, p: ClaimProfile) -> Column:
    return collapse(text).rlike(f"(?i){p.unit_pattern}")


def emission_claims(tables: DataFrame, cells: DataFrame, texts: DataFrame, p: ClaimProfile) -> tuple[DataFrame, DataFrame]:
    """(claims, guards). A claim for each number or nil cell of a known row in the main column group, where the row's or the
    table's unit is stated; guards (doc, reason, n) counts rows without a unit and cells of other groups."""
    heads = header_columns(cells.withColumn("text", collapse(F.col("text"))), bare=False, keys=TABLE)
    heads = column_groups(heads, cells, TABLE)
    spark = cells.sparkSession
    known = F.broadcast(spark.createDataFrame([*dict((l, (l, s, t)) for l, s, t in p.labels).values()], "printed string, scope string, is_subtotal boolean").select(squash(F.col("printed")).alias("squashed"), "scope", "is_subtotal"))
    rows = cells.where("ci = 0").select(*TABLE, "ri", F.col("text").alias("label"), squash(F.col("text")).alias("squashed")).join(known, "squashed").drop("squashed")
    first_row = heads.groupBy(*TABLE).agg(F.max("ri").alias("head"))
    rows = rows.join(first_row, TABLE).where(F.col("ri") > F.col("head")).drop("head")
    if p.unit_in_rows:
        stated = cells.where(F.col("ci") < 3).where(_unit_hits(F.col("text"), p)).select(*TABLE, "ri").distinct().withColumn("_unit", F.lit(True))
        rows = rows.join(stated, [*TABLE, "ri"], "left")
    else:
        by_page = texts.where(_unit_hits(F.col("text"), p)).select("doc", "page_no").distinct()
        of_tables = tables.join(by_page, ["doc", "page_no"], "left_semi").select(*TABLE).union(cells.where(F.col("ri") < 3).where(_unit_hits(F.col("text"), p)).select(*TABLE)).distinct()
        rows = rows.join(of_tables.withColumn("_unit", F.lit(True)), TABLE, "left")
    raw = collapse(F.col("c.text"))
    met = rows.where("_unit").alias("r").join(heads.select(*TABLE, "ci", F.col("text").alias("heading"), "group", "year", "is_target").alias("h"), TABLE)
    inside = met.where(F.col("group") == p.boundary)
    shown = inside.join(cells.select(*TABLE, "ri", "ci", "text").alias("c"), [*TABLE, "ri", "ci"]).withColumn("raw", raw).where("raw <> ''")
    shown = shown.withColumn("parsed", parse_strict(F.col("raw"), p.separator)).where("parsed.value is not null or parsed.is_nil").join(tables, TABLE)
    tid = table_id(F.col("page_no"), F.col("n_rows"), F.col("n_cols"))
    claims = shown.select(
        "doc",
        fact_id(F.col("doc"), F.col("page_no"), tid, F.col("ri"), F.col("ci")).alias("claim_id"),
        F.when(F.col("is_target"), "E1-4").otherwise("E1-6").alias("code"),
        F.when(F.col("is_target"), "target").otherwise("quantitative").alias("claim_type"),
        collapse(F.col("label")).alias("claim_text"),
        (F.col("parsed.value") * p.unit_factor).cast("decimal(38,6)").alias("value"),
        "raw",
        "scope",
        "is_subtotal",
        F.lower("label").contains(p.specific).alias("is_company_specific"),
        F.col("heading").rlike(f"(?i){p.baseline_pattern}").alias("is_baseline_column"),
        F.when(~F.col("is_target"), F.to_date(F.concat("year", F.lit("-12-31")))).alias("period_end"),
        F.when(F.col("is_target"), F.col("year").cast("int")).alias("target_year"),
        F.lit(None).cast("boolean").alias("covers_scope3"),
        F.lit(None).cast("int").alias("baseline_year"),
        F.lit(None).cast("double").alias("baseline_value"),
        F.expr("cast(array() as array<string>)").alias("flags"),
        F.struct("page_no", tid.alias("table_id"), "ri", "ci", F.array("group", "heading").alias("header_path")).alias("source_ref"),
    )
    no_unit = rows.where("_unit is null").select("doc", F.lit("no_unit").alias("reason"))
    other = met.where(F.col("group") != p.boundary).select("doc", F.lit("other_boundary"))
    return claims, no_unit.union(other).groupBy("doc", "reason").agg(F.count(F.lit(1)).alias("n"))


def _nearest_above(left: DataFrame, right: DataFrame, carry: list[str]) -> DataFrame:
    """left (doc, page_no, top) with the `carry` columns of the lowest right row that is not below it, in one ordered pass."""
    kept = F.struct(*carry)
    both = left.withColumns({"_side": F.lit(1), "_r": F.lit(None).cast(right.select(kept.alias("x")).schema["x"].dataType)}).unionByName(right.select("doc", "page_no", "top", F.lit(0).alias("_side"), kept.alias("_r")), allowMissingColumns=True)
    w = Window.partitionBy("doc", "page_no").orderBy(F.col("top").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1 and _r is not null").select(*left.columns, "_r.*")


def paired_targets(tables: DataFrame, cells: DataFrame, texts: DataFrame, p: ClaimProfile) -> DataFrame:
    """Target claims from a table of two columns (baseline and scope) with the heading above it and the table of one column
    above it that lists years and aims. A year without an aim is looked for in the page's text; an aim without a year is
    kept, flagged: a year is never made up."""
    number = F.regexp_extract(collapse(F.col("text")), p.target_heading, 1)
    heads = texts.where(F.col("label").contains("header")).select("doc", "page_no", "top", number.alias("scope_no")).where("scope_no <> ''")
    pairs = cells.where("ci < 2").groupBy(*TABLE, "ri").agg(F.max(F.when(F.col("ci") == 0, squash(F.col("text")))).alias("k"), F.max(F.when(F.col("ci") == 1, collapse(F.col("text")))).alias("v")).where("k is not null and v is not null")
    entry = lambda name: F.max_by(F.when(F.col("k") == F.lit("".join(name.lower().split())), F.col("v")), F.when(F.col("k") == F.lit("".join(name.lower().split())), F.col("ri")))
    attrs = pairs.groupBy(*TABLE).agg(entry(p.baseline_year).alias("by"), entry(p.baseline_value).alias("bv"), entry(p.in_scope).alias("in_scope"), entry(p.out_of_scope).alias("out_of_scope")).where("by is not null")
    two = tables.where("n_cols = 2").join(attrs, TABLE).select("doc", "page_no", "top", F.col("table_ord").alias("attr_ord"), "by", "bv", "in_scope", "out_of_scope")
    scoped = _nearest_above(two, heads, ["scope_no"])
    # the table of one column must stand above, not at the same height
    ones = tables.where("n_cols = 1").select("doc", "page_no", (F.col("top") - 1e-9).alias("top"), F.col("table_ord").alias("mile_ord"))
    met = _nearest_above(scoped, ones, ["mile_ord"])
    mile = cells.where("ci = 0").select("doc", F.col("table_ord").alias("mile_ord"), F.col("ri").alias("i"), collapse(F.col("text")).alias("cell"))
    w = Window.partitionBy("doc", "attr_ord").orderBy("i")
    lines = met.join(mile, ["doc", "mile_ord"]).withColumns({"next": F.coalesce(F.lead("cell").over(w), F.lit("")), "prior": F.lag("cell").over(w)})
    page = texts.groupBy("doc", "page_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", collapse(F.col("text")).alias("t")))), lambda x: x["t"]), " ").alias("page_text"))
    lines = lines.join(page, ["doc", "page_no"], "left")
    aims = lambda c: c.rlike(p.target_pattern) | c.rlike(p.net_zero)
    is_year, after_year = F.col("cell").rlike(r"^20\d{2}$"), F.coalesce(F.col("prior").rlike(r"^20\d{2}$"), F.lit(False))
    found = F.expr(f"regexp_extract(page_text, concat(cell, '[^.]{{0,80}}?{p.net_zero}|{p.net_zero}[^.]{{0,80}}?', cell), 0)")
    aim = F.when(is_year & aims(F.col("next")), F.col("next")).when(is_year, F.coalesce(found, F.lit(""))).when(aims(F.col("cell")) & ~after_year, F.col("cell"))
    flag = F.when(is_year & ~aims(F.col("next")) & (F.coalesce(found, F.lit("")) == ""), "description_not_found").when(~is_year, "year_label_missing")
    rows = lines.withColumns({"aim": aim, "flag": flag}).where("aim is not null")
    percent = F.nullif(F.regexp_extract("aim", p.target_pattern, 1), F.lit(""))
    nil = F.col("aim").rlike(p.net_zero)
    rows = rows.where(percent.isNotNull() | nil | F.col("flag").isNotNull())
    scope = F.when(F.col("scope_no") == "1", SCOPE_12[0]).otherwise("scope_3")
    year = F.when(is_year, F.col("cell").cast("int"))
    base = F.nullif(F.regexp_extract("bv", r"(\d+[,.]\d+)", 1), F.lit(""))
    return rows.select(
        "doc",
        fact_id(F.col("doc"), F.col("page_no"), scope, F.coalesce("cell", F.lit("")), F.substring("aim", 1, 30), F.lit("t")).alias("claim_id"),
        F.lit("E1-4").alias("code"),
        F.lit("target").alias("claim_type"),
        F.substring("aim", 1, 300).alias("claim_text"),
        percent.cast("decimal(38,6)").alias("value"),
        F.coalesce(percent, F.substring("aim", 1, 40)).alias("raw"),
        scope.alias("scope"),
        F.when(nil, "net_zero").otherwise("absolute").alias("target_type"),
        year.alias("target_year"),
        (F.col("scope_no") != "1").alias("covers_scope3"),
        F.nullif(F.regexp_extract("by", r"(\d{4})", 1), F.lit("")).cast("int").alias("baseline_year"),
        F.translate(base, ",", ".").cast("double").alias("baseline_value"),
        F.substring("in_scope", 1, 300).alias("in_scope_text"),
        F.substring("out_of_scope", 1, 300).alias("out_of_scope_text"),
        F.array_compact(F.array("flag")).alias("flags"),
    )


def one_shape(*parts: DataFrame) -> DataFrame:
    """All rows with all columns, in order of name; what a part lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def claim_series(claims: DataFrame, owner: list[str]) -> DataFrame:
    """(owner, scope, basis, year, value, n_values): subtotals that were measured; a year stated twice keeps the last by
    `ord` and n_values over 1 is a warning."""
    basis = F.when(F.col("is_company_specific"), "company_specific").otherwise("esrs")
    rows = claims.where("claim_type = 'quantitative' and is_subtotal and value is not null and period_end is not null")
    return rows.groupBy(*owner, "scope", basis.alias("basis"), F.year("period_end").alias("year")).agg(F.max_by("value", "ord").cast("double").alias("value"), F.count_distinct("value").alias("n_values"))


def signals(claims: DataFrame, owner: list[str]) -> DataFrame:
    """(owner, signal, severity, measure) in the order of severity and name. The series is aggregated once, by owner, so all
    signals but the baselines come from one row an owner."""
    series = claim_series(claims, owner)
    targets = claims.where("claim_type = 'target'")
    c = change(series, [*owner, "scope", "basis"])
    pick = lambda s, b, f: F.max(F.when((F.col("scope") == s) & (F.col("basis") == b), F.col(f)))
    fields = ("pct", "first_value", "last_value")
    wide = c.groupBy(*owner).agg(
        *[pick(s, "esrs", f).alias(f"{n}_{f}") for n, s in (("a", SCOPE_12[0]), ("b", SCOPE_12[1]), ("x", "scope_3")) for f in fields],
        *[pick("scope_3", "company_specific", f).alias(f"y_{f}") for f in fields],
    )
    # the first of the combined scopes that has a change, or a latest value, stands for scope 1 and 2
    with_change = F.col("a_pct").isNotNull()
    p12, v12, f12 = (F.when(with_change, F.col(f"a_{f}")).otherwise(F.col(f"b_{f}")) for f in ("pct", "last_value", "first_value"))
    last12 = F.coalesce(F.nullif(F.col("a_last_value"), F.lit(0.0)), F.col("b_last_value"))
    base = F.col("x_first_value") + f12
    # a change just below zero rounds to zero, not to its negative
    net = F.round((F.col("x_last_value") + v12 - base) / F.nullif(base, F.lit(0.0)) * 100, 1) + F.lit(0.0)
    share = F.round(100 - last12 / (F.col("x_last_value") + last12) * 100, 1)
    of_targets = targets.groupBy(*owner).agg(
        F.coalesce(F.bool_or("covers_scope3"), F.lit(False)).alias("covered"),
        F.min_by(F.struct("baseline_value", "baseline_year"), F.when((F.col("scope") == "scope_3") & (F.col("baseline_value") != 0), F.col("ord"))).alias("anchor"),
    )
    at = lambda basis: series.where((F.col("scope") == "scope_3") & (F.col("basis") == basis)).select(*owner, F.col("year").alias("_y"), F.col("value").alias(f"_{basis}"))
    met = wide.join(of_targets, owner, "left").withColumn("_y", F.col("anchor.baseline_year"))
    met = met.join(at("esrs"), [*owner, "_y"], "left").join(at("company_specific"), [*owner, "_y"], "left")
    near = lambda v: F.abs(F.coalesce(v, F.lit(0.0)) / MILLION - F.col("anchor.baseline_value")) < BASELINE_TOL
    one = lambda when, name, measure: F.when(when, F.struct(F.lit(name).alias("signal"), F.lit("high").alias("severity"), measure.cast("double").alias("measure")))
    opposite = (p12 < 0) & (F.col("x_pct") > 0) & (v12 != 0)
    anchored = F.col("_y").isNotNull() & near(F.col("_company_specific")) & ~near(F.col("_esrs")) & F.col("y_pct").isNotNull() & F.col("x_pct").isNotNull()
    dominant = (F.col("x_last_value") / F.nullif(last12, F.lit(0.0)) >= DOMINANT_RATIO) & ~F.coalesce("covered", F.lit(False))
    found = F.array_compact(F.array(one(opposite, "scope12_down_scope3_up", net), one(anchored, "target_anchored_to_company_specific_metric", F.col("y_pct")), one(dominant, "dominant_scope_not_targeted", share)))
    high = met.select(*owner, F.inline(found))
    lines = baseline_lines(series, targets, owner)
    bad = lines.where("not matches").select(*owner, F.lit("baseline_mismatch").alias("signal"), F.lit("review").alias("severity"), F.col("stated").alias("measure"))
    return high.unionByName(bad)


def baseline_lines(series: DataFrame, targets: DataFrame, owner: list[str]) -> DataFrame:
    """(owner, scope, year, stated, measured, matches): each stated baseline, in millions, against the series of its year;
    of targets of one scope and year the first by `ord`. Those without a baseline, or without a value, are left out."""
    combined = F.col("scope").isin(*SCOPE_12)
    asked = targets.where("baseline_value is not null and baseline_value <> 0 and baseline_year is not null").withColumns({"basis": F.when(combined, "esrs").otherwise("company_specific"), "scope": F.when(combined, F.col("scope")).otherwise("scope_3")})
    first = asked.groupBy(*owner, "scope", "basis", F.col("baseline_year").alias("year")).agg(F.min_by("baseline_value", "ord").alias("stated"))
    met = first.join(series.where("value <> 0"), [*owner, "scope", "basis", "year"])
    return met.select(*owner, "scope", "year", "stated", (F.col("value") / MILLION).alias("measured"), (F.abs(F.col("value") / MILLION - F.col("stated")) <= BASELINE_TOL).alias("matches"))
