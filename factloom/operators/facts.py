"""Fact operators: truth comparison, de-duplication, restatements, precision, identities, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numbers import decimals_tolerance, scale_exponent, trailing_zeros


def classify(extracted: DataFrame, truth: DataFrame, keys: list[str], elsewhere: DataFrame | None = None) -> DataFrame:
    """extracted (keys, value) with `class` against truth (keys, value): exact, sign, scale, other,
    other_taxonomy (the key without its first column is in `elsewhere`) or untagged."""
    gold = truth.select(*keys, F.col("value").alias("gold"), F.lit(True).alias("tagged"))
    met = extracted.join(gold, keys, "left")
    if elsewhere is not None:
        met = met.join(elsewhere.select(*keys[1:]).distinct().withColumn("near", F.lit(True)), keys[1:], "left")
    d, g = F.col("value"), F.col("gold")
    kind = (
        F.when(F.col("tagged").isNull(), F.when(F.col("near"), "other_taxonomy").otherwise("untagged") if elsewhere is not None else "untagged")
        .when(d == g, "exact")
        .when(d == -g, "sign")
        .when(scale_exponent(d, g).isNotNull(), "scale")
        .otherwise("other")
    )
    return met.withColumn("class", kind).drop("tagged", "near")


def scorecard(classified: DataFrame, by: list[str]) -> DataFrame:
    """Rollup over `by`: ratios of sums, never means of ratios."""
    n = lambda c: F.count_if(F.col("class") == c)
    comparable = F.count_if(~F.col("class").isin("untagged", "other_taxonomy"))
    sums = classified.rollup(*by).agg(F.count(F.lit(1)).alias("extracted"), comparable.alias("comparable"), n("exact").alias("exact"), F.grouping_id().alias("level"))
    ratio = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
    out = sums.withColumns({"precision": ratio("exact", "comparable"), "verifiability": ratio("comparable", "extracted")})
    return out.withColumn("trust", F.round(F.col("exact") / F.nullif(F.col("extracted"), F.lit(0)), 6))


def missed(truth: DataFrame, extracted: DataFrame, keys: list[str], scope: DataFrame | None = None, scope_keys: list[str] | None = None) -> DataFrame:
    """Truth that was not extracted, within the scope's keys where one is given."""
    inside = truth if scope is None else truth.join(scope.select(*scope_keys).distinct(), scope_keys, "left_semi")
    return inside.join(extracted.select(*keys), keys, "left_anti")


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in `order`: first-wins, last-wins (descending) and claim-first."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def keep_more_precise(df: DataFrame, keys: list[str], value: str, decimals: str, order: list[str]) -> DataFrame:
    """Of each key the first row in `order`, unless a later one has another value and is more precise than the one kept so
    far. Null decimals are the least precise; exact ones are to be given as a large number. A fold: a later row of equal value
    never takes over, so the largest precision alone does not decide. A key's rows are few: one document's repeats."""
    rest = [c for c in df.columns if c not in keys]
    lists = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in rest if c not in order]))).alias("_l"))
    at = lambda x: F.coalesce(x[decimals], F.lit(-(1 << 20)))
    kept = F.aggregate(F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0))), F.get("_l", F.lit(0)), lambda a, x: F.when((x[value] != a[value]) & (at(x) > at(a)), x).otherwise(a))
    return lists.select(*keys, kept.alias("_k")).select(*keys, *[F.col(f"_k.{c}").alias(c) for c in rest])


def latest(facts: DataFrame, keys: list[str], value: str, filed: str) -> DataFrame:
    """The value filed last for each key; of several filed together the largest."""
    return facts.groupBy(*keys).agg(F.max_by(value, F.struct(filed, value)).alias(value), F.max(filed).alias(filed))


def ranked_restatements(found: DataFrame) -> DataFrame:
    """Restatements in the order in which they are read: changes of value before turned signs, the largest first."""
    return found.orderBy((F.col("kind") != "value_change"), F.col("rel_delta").desc_nulls_last())


def duplicates(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """What keep_one leaves out: the list of repeats."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn > 1").drop("_rn")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that carry more than one value."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n_values"), F.count(F.lit(1)).alias("n_rows")).where("n_values > 1")


def restatements(df: DataFrame, keys: list[str], value: str, filed: list[str], min_rel: float = 0.0) -> DataFrame:
    """First against last filed value of keys with two values or more."""
    at = F.struct(*filed)
    ends = df.groupBy(*keys).agg(F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"), F.count_distinct(value).alias("n_values"), F.count(F.lit(1)).alias("n_filings"))
    rel = F.abs(F.col("last_value") - F.col("first_value")) / F.nullif(F.abs(F.col("first_value")), F.lit(0))
    kind = F.when(F.col("first_value") == -F.col("last_value"), "sign_flip").otherwise("value_change")
    return ends.where("n_values > 1").withColumns({"rel_delta": F.round(rel, 6), "kind": kind}).where((F.col("first_value") != F.col("last_value")) & (F.coalesce(rel, F.lit(1.0)) >= min_rel))


def infer_precision(df: DataFrame, filing: str, value: str, least: float = 1e6) -> DataFrame:
    """Per filing the most frequent number of trailing zeros (ties: fewest) and its tolerance."""
    zeros = df.where(F.abs(F.col(value)) >= least).select(filing, trailing_zeros(F.col(value)).alias("zeros"))
    counts = zeros.groupBy(filing, "zeros").agg(F.count(F.lit(1)).alias("n_facts"))
    best = keep_one(counts, [filing], [F.col("n_facts").desc(), F.col("zeros")])
    return best.withColumn("decimals", -F.col("zeros")).withColumn("tol", decimals_tolerance(F.col("decimals")))


def resolve(facts: DataFrame, terms: DataFrame) -> DataFrame:
    """For each rule and period all terms from one filing, the newest that has them all. facts:
    (concept, period, accn, filed, unit, value, tol); terms: (rule, concept, coef, ord), a small table; coef 0 is the right
    side. Facts move once, by period: both aggregates keep that partitioning. See rules.check_rules for whole rule sets."""
    needed = terms.groupBy("rule").agg(F.count(F.lit(1)).alias("needed"))
    met = facts.repartition("period").join(F.broadcast(terms), "concept").join(F.broadcast(needed), "rule")
    term = F.struct("ord", "concept", "coef", "unit", "value", "tol", "filed")
    filings = met.groupBy("rule", "period", "accn").agg(F.collect_list(term).alias("ts"), F.count_distinct("concept").alias("found"), F.max("filed").alias("newest"), F.max("needed").alias("needed"))
    chosen = filings.where("found = needed").groupBy("rule", "period").agg(F.max_by(F.struct("accn", "ts"), F.struct("newest", "accn")).alias("c"))
    return chosen.select("rule", "period", "c.accn", F.inline("c.ts"))


def check(resolved: DataFrame, op: str = "eq") -> DataFrame:
    """(rule, period, status, delta, tol, suspect). The tolerance is the sum of the terms' tolerances,
    not weighted by coefficients. Mixed units skip; a failure that flipping one term's sign mends
    names the first such term."""
    left, right = F.when(F.col("coef") != 0, F.col("coef") * F.col("value")), F.when(F.col("coef") == 0, F.col("value"))
    sums = resolved.groupBy("rule", "period").agg(
        F.sum(left).alias("lhs"),
        F.max(right).alias("rhs"),
        F.sum("tol").alias("tol"),
        F.count_distinct("unit").alias("units"),
        F.sort_array(F.collect_list(F.when(F.col("coef") != 0, F.struct("ord", "concept", (F.col("coef") * F.col("value")).alias("part"))))).alias("parts"),
    )
    out = sums.withColumn("delta", F.col("lhs") - F.col("rhs"))
    good = F.col("delta") <= F.col("tol") if op == "lte" else F.abs("delta") <= F.col("tol")
    status = F.when(F.col("units") > 1, "SKIP").when(good, "PASS").otherwise("FAIL")
    fits = F.filter("parts", lambda p: F.abs(F.col("delta") - 2 * p["part"]) <= F.col("tol"))
    suspect = F.when((status == "FAIL") & (F.size(fits) > 0), F.get(fits, F.lit(0))["concept"])
    return out.select("rule", "period", status.alias("status"), "delta", "tol", suspect.alias("suspect"))


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Fallback results only where the primary rule skipped; in each variant group a PASS hides the rest."""
    skipped = primary.where("status = 'SKIP'").select("period")
    both = primary.unionByName(fallback.join(skipped.distinct(), "period", "left_semi"))
    passed = F.max(F.when(F.col("status") == "PASS", 1).otherwise(0)).over(Window.partitionBy("period"))
    return both.withColumn("_p", passed).where("_p = 0 or status = 'PASS'").drop("_p")


def continuity(balances: DataFrame) -> DataFrame:
    """(owner, year, change, closing) against the closing balance of the year before."""
    before = balances.select("owner", (F.col("year") + 1).alias("year"), F.col("closing").alias("opening"))
    met = balances.join(before, ["owner", "year"], "left")
    off = F.abs(F.col("closing") - F.col("opening") - F.col("change"))
    return met.withColumn("status", F.when(F.col("opening").isNull(), "SKIP").when(off <= 0.5, "PASS").otherwise("WARN"))


def label_map(rows: DataFrame, min_count: int = 1) -> DataFrame:
    """label to concept, only where all rows of the label name one concept; flip only if all agree.
    rows: (label, concept, flip)."""
    sums = rows.groupBy("label").agg(F.count_distinct("concept").alias("n_concepts"), F.count(F.lit(1)).alias("n_rows"), F.max("concept").alias("concept"), F.every("flip").alias("flip"))
    return sums.where((F.col("n_concepts") == 1) & (F.col("n_rows") >= min_count)).drop("n_concepts")


def two_tier_lookup(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (exact, squashed, ...) with the concept of labels (exact, squashed, ord, concept): by the
    exact label, else by the squashed one; the first declared label wins."""
    first = lambda k: keep_one(labels, [k], [F.col("ord")]).select(k, F.col("concept").alias(f"_{k}"))
    met = rows.join(first("exact"), "exact", "left").join(first("squashed"), "squashed", "left")
    tier = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_squashed").isNotNull(), "squashed").otherwise("none")
    return met.withColumns({"concept": F.coalesce("_exact", "_squashed"), "tier": tier}).drop("_exact", "_squashed")
