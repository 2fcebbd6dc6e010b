"""Series and contradiction signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOMINANT_RATIO = 5.0
BASELINE_TOL = 0.1


def build_series(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One value per key and year: the last by `ord` that is not null; `n_values` over 1 is a warning."""
    return rows.where("value is not null").groupBy(*keys, "year").agg(F.max_by("value", "ord").alias("value"), F.count_distinct("value").alias("n_values"))


def change(series: DataFrame, keys: list[str]) -> DataFrame:
    """Percent from the first to the last year; null for fewer than two years or a zero base."""
    ends = series.groupBy(*keys).agg(F.min_by("value", "year").alias("first_value"), F.max_by("value", "year").alias("last_value"), F.count(F.lit(1)).alias("n_years"), F.max("year").alias("last_year"))
    pct = (F.col("last_value") - F.col("first_value")) / F.nullif(F.abs(F.col("first_value")), F.lit(0.0)) * 100
    return ends.withColumn("pct", F.when(F.col("n_years") > 1, F.round(pct, 6)))


def opposite_trends(changes: DataFrame, owner: str, part: str, down: str, up: str) -> DataFrame:
    """Owners whose part `down` fell while `up` rose."""
    a = changes.where((F.col(part) == down) & (F.col("pct") < 0)).select(owner, F.col("pct").alias("pct_down"))
    b = changes.where((F.col(part) == up) & (F.col("pct") > 0)).select(owner, F.col("pct").alias("pct_up"))
    return a.join(b, owner)


def dominant_untargeted(changes: DataFrame, owner: str, part: str, big: str, small: str, targets: DataFrame, ratio: float = DOMINANT_RATIO) -> DataFrame:
    """Owners whose latest `big` is at least ratio times `small` and that have no target covering it."""
    last = lambda p, n: changes.where(F.col(part) == p).select(owner, F.col("last_value").alias(n))
    met = last(big, "big").join(last(small, "small"), owner).where((F.col("small") > 0) & (F.col("big") >= ratio * F.col("small")))
    return met.join(targets.where(F.col(part) == big).select(owner).distinct(), owner, "left_anti")


def baseline_mismatch(series: DataFrame, targets: DataFrame, keys: list[str], tol: float = BASELINE_TOL) -> DataFrame:
    """Targets (keys, year, base) whose base differs from the series; bases of zero or null are skipped."""
    asked = targets.where("base is not null and base <> 0").select(*keys, "year", "base").distinct()
    return asked.join(series.select(*keys, "year", "value"), [*keys, "year"]).withColumn("matches", F.abs(F.col("base") - F.col("value")) <= tol)


def unit_suspects(series: DataFrame, keys: list[str], year: str, value: str, factor: float = 100) -> DataFrame:
    """Values over `factor` times the median of the key's earlier years; a first year has nothing to be held against."""
    before = Window.partitionBy(*keys).orderBy(year).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.sort_array(F.collect_list(F.col(value).cast("double")).over(before))
    n = F.size("_seen")
    median = (F.get("_seen", F.floor((n - 1) / 2).cast("int")) + F.get("_seen", F.floor(n / 2).cast("int"))) / 2
    return series.withColumn("_seen", seen).where("size(_seen) > 0").withColumn("suspect", F.abs(value) > factor * F.abs(median)).drop("_seen")


def comparatives(current: DataFrame, shown: DataFrame, keys: list[str], year: str) -> DataFrame:
    """The year before as a report shows it (keys, year, comparative) against what was reported then (keys, year, current)."""
    then = current.select(*keys, (F.col(year) + 1).alias(year), F.col("current").alias("reported"))
    met = shown.join(then, [*keys, year])
    return met.withColumns({"off": F.col("comparative") - F.col("reported"), "continues": F.col("comparative") == F.col("reported")})


def changed_since(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Each row with the value before it and whether it changed; first rows have none and are left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    met = rows.withColumn("before", F.lag(value).over(w)).where("before is not null")
    return met.withColumn("changed", F.col(value) != F.col("before"))


def composite(gate: Column, *weighted) -> Column:
    """A score of weighted parts (weight, part), nothing where the gate is shut."""
    total = sum((part * weight for weight, part in weighted), F.lit(0.0))
    return gate.cast("int") * total
