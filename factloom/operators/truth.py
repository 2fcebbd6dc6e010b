"""Truth comparison beside facts.classify: keys, recall, dead and partial labels, the scorecard of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_canonical(canon: Column) -> Column:
    """struct(taxonomy, name) of `taxonomy:Name`; null where it is not just that."""
    parts = F.split(canon, ":")
    good = (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != "")
    return F.when(good, F.struct(F.get(parts, F.lit(0)).alias("taxonomy"), F.get(parts, F.lit(1)).alias("name")))


def keyed(rows: DataFrame, where: Column | None = None) -> DataFrame:
    """rows with taxonomy, name and the period of their key: an instant for a balance sheet, else two dates. A name or a
    period that is not whole stops the query: a truth comparison must not guess."""
    at = F.coalesce(where.cast("string"), F.lit("?")) if where is not None else F.lit("row")
    stop = lambda text: F.raise_error(F.concat(F.lit(text), F.lit(" ("), at, F.lit(")")))
    name = split_canonical(F.col("concept"))
    balance = F.col("statement") == "balance_sheet"
    lacking = F.col("statement").isNull() | F.col("period_end").isNull() | (~balance & F.col("period_start").isNull())
    checked = F.when(name.isNull(), stop("concept is not taxonomy:Name").cast("string")).when(lacking, stop("statement or period is missing").cast("string")).otherwise(name["taxonomy"])
    start = F.when(~balance, F.col("period_start"))
    return rows.withColumns({"taxonomy": checked, "name": name["name"]}).withColumn("period_start", start)


def loose_keys(rows: DataFrame) -> DataFrame:
    """As keyed, for rows that were checked before: nothing stops."""
    name = split_canonical(F.col("concept"))
    return rows.withColumns({"taxonomy": name["taxonomy"], "name": name["name"], "period_start": F.when(F.col("statement") != "balance_sheet", F.col("period_start"))})


def of_taxonomy(truth: DataFrame, taxonomy: str = "ifrs-full") -> DataFrame:
    """Truth of one taxonomy, one row a (taxonomy, concept, period): the last by value where it repeats."""
    return truth.where(F.col("taxonomy") == taxonomy).groupBy("taxonomy", "concept", "period_start", "period_end").agg(F.max("value").alias("value"))


def profile_concepts(labels: DataFrame) -> DataFrame:
    """(taxonomy, name) that a label map can yield."""
    name = split_canonical(F.col("concept"))
    return labels.select(name["taxonomy"].alias("taxonomy"), name["name"].alias("name")).where("taxonomy is not null").distinct()


def scope_outcomes(truth: DataFrame, extracted: DataFrame, scope: DataFrame, keys: list[str], concept: list[str]) -> DataFrame:
    """truth with `outcome`: caught; dead (its concept has a label but no fact at all), partial (only this period is
    missing), or out_of_scope (no label names it)."""
    hit = extracted.select(*keys).distinct().withColumn("_hit", F.lit(True))
    some = extracted.select(*concept).distinct().withColumn("_some", F.lit(True))
    mapped = scope.select(*concept).distinct().withColumn("_mapped", F.lit(True))
    met = truth.join(hit, keys, "left").join(some, concept, "left").join(mapped, concept, "left")
    outcome = F.when(F.col("_mapped").isNull(), "out_of_scope").when(F.col("_hit"), "caught").when(F.col("_some"), "partial").otherwise("dead")
    return met.withColumn("outcome", outcome).drop("_hit", "_some", "_mapped")


def recall(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Recall within the scope, from outcomes; null where nothing is in it."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    sums = outcomes.groupBy(*by).agg(n("caught").alias("caught"), n("dead").alias("dead"), n("partial").alias("partial"), n("out_of_scope").alias("out_of_scope"))
    inside = F.col("caught") + F.col("dead") + F.col("partial")
    return sums.withColumn("recall", F.round(F.col("caught") / F.nullif(inside, F.lit(0)), 4))


def _ratio(a: str, b: str) -> Column:
    return F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 4)


COUNTS = ("numeric_cells", "labels", "facts_extracted", "facts_comparable", "facts_exact", "gt_total", "gt_inscope", "gt_caught")


def hardness(parts: DataFrame, guards: DataFrame | None = None) -> DataFrame:
    """A row a document and one TOTAL. parts (doc, the COUNTS, chance_floor, guard counts) as columns; the total's ratios
    are of sums. trust is precision times verifiability, signal_margin coverage less the chance floor."""
    more = [c for c in parts.columns if c.startswith("guard_")]
    sums = parts.rollup("doc").agg(*[F.sum(c).alias(c) for c in (*COUNTS, *more)], F.max(F.when(F.col("doc").isNotNull(), F.col("chance_floor"))).alias("chance_floor"), F.grouping_id().alias("_total"))
    named = sums.withColumn("doc", F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col("doc").cast("string")))
    out = named.withColumns({"precision": _ratio("facts_exact", "facts_comparable"), "verifiability": _ratio("facts_comparable", "facts_extracted"), "recall_inscope": _ratio("gt_caught", "gt_inscope"), "coverage_filing": _ratio("gt_caught", "gt_total")})
    trust = F.round(F.col("facts_exact") / F.nullif(F.col("facts_comparable"), F.lit(0)) * F.col("facts_comparable") / F.nullif(F.col("facts_extracted"), F.lit(0)), 4)
    floor = F.when(F.col("_total") == 0, F.round("chance_floor", 4))
    return out.withColumns({"trust": trust, "chance_floor": floor}).withColumn("signal_margin", F.round(F.col("coverage_filing") - F.col("chance_floor"), 4)).drop("_total")


def numeric_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.count_if(F.col("text").rlike(r"\d")).alias("numeric_cells"), F.count(F.lit(1)).alias("n_cells"))


def shown(rows: DataFrame, order: list[Column], limit: int = 8) -> DataFrame:
    """The first `limit` rows of each class, and with each how many more there are: a report, so the limit is its point."""
    from pyspark.sql import Window

    w = Window.partitionBy("class")
    ranked = rows.withColumns({"place": F.row_number().over(w.orderBy(*order)), "_n": F.count(F.lit(1)).over(w)})
    return ranked.where(F.col("place") <= limit).withColumn("n_more", F.greatest(F.col("_n") - limit, F.lit(0))).drop("_n")


def chance_floor(gold: DataFrame, numbers: DataFrame) -> DataFrame:
    """(doc, chance_floor): the share of a document's gold sizes that another document's numbers cover. numbers (doc,
    value) are sizes under both readings, gold (doc, id, value) has no zeros; see grids.coverage for the join."""
    from factloom.operators.grids import coverage

    held = coverage(gold.where("value <> 0").withColumn("value", F.abs("value")), numbers)
    return held.groupBy("doc").agg(F.avg(F.col("hit_other").cast("double")).alias("chance_floor"))


def field_coverage(gold: DataFrame, encoded: tuple[str, ...] = ()) -> DataFrame:
    """gold (doc, field, hit, base, flip as 0/1) by document and field, a subtotal a document and a grand total; fields
    that are codes, not printed values, count in their own rows only."""
    shares = lambda df: df.withColumns({"ceiling": _ratio("hits", "n"), "floor": _ratio("bases", "n")}).withColumn("margin", F.round(F.col("ceiling") - F.col("floor"), 4))
    total = [F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.sum("base").alias("bases"), F.sum("flip").alias("flips")]
    plain = gold.where(~F.col("field").isin(*encoded)) if encoded else gold
    fields = gold.groupBy("doc", "field").agg(*total).withColumn("level", F.lit(0))
    above = plain.rollup("doc").agg(*total, (F.grouping_id() + 1).cast("int").alias("level")).withColumn("field", F.lit(None).cast("string"))
    return shares(fields.unionByName(above))
