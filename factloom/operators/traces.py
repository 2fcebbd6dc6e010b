"""Trace analytics: loops, budgets, stop reasons, circuit breaker states, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repeats(events: DataFrame, key: str, signature: list[str], order: list[str]) -> DataFrame:
    """How often each event's call has been made so far in its run."""
    w = Window.partitionBy(key, *signature).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("n_so_far", F.count(F.lit(1)).over(w))


def spent_before(events: DataFrame, key: str, cost: Column, order: list[str]) -> DataFrame:
    """Cost before each event: a budget is checked before a turn, so it can overshoot once."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("spent_before", F.coalesce(F.sum(cost).over(w), F.lit(0)))


def stop_reasons(events: DataFrame, key: str, order: list[str], signature: list[str], cost: Column, max_repeat: int, budget: float, max_turns: int) -> DataFrame:
    """The first turn of each run at which a rule ends it, and which; budget goes before loop before turns."""
    w = Window.partitionBy(key).orderBy(*order)
    seen = spent_before(repeats(events, key, signature, order), key, cost, order).withColumn("turn", F.row_number().over(w))
    reason = F.when(F.col("spent_before") >= budget, "BUDGET_EXCEEDED").when(F.col("n_so_far") > max_repeat, "LOOP_DETECTED").when(F.col("turn") > max_turns, "MAX_TURNS")
    ends = seen.withColumn("reason", reason)
    return ends.groupBy(key).agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("turn"))).alias("reason"), F.min(F.when(F.col("reason").isNotNull(), F.col("turn"))).alias("stop_turn"), F.max("turn").alias("turns")).withColumn("reason", F.coalesce("reason", F.lit("COMPLETED")))


def failure_streaks(events: DataFrame, key: str, order: str, failed: Column, threshold: int) -> DataFrame:
    """Maximal runs of failures; `opens` where a run reaches the threshold."""
    w = Window.partitionBy(key).orderBy(order)
    flagged = events.withColumn("_f", failed).withColumn("_g", F.row_number().over(w) - F.sum(failed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = flagged.where("_f").groupBy(key, "_g").agg(F.min(order).alias("started"), F.max(order).alias("ended"), F.count(F.lit(1)).alias("n_failures"))
    return runs.drop("_g").withColumn("opens", F.col("n_failures") >= threshold)


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two binary raters beyond chance, from four counts."""
    n = F.count(F.lit(1))
    same = F.count_if(F.col(a) == F.col(b)) / n
    pa, pb = F.avg(F.col(a).cast("double")), F.avg(F.col(b).cast("double"))
    chance = pa * pb + (1 - pa) * (1 - pb)
    return df.agg(n.alias("n"), same.alias("observed"), chance.alias("expected")).withColumn("kappa", F.round((F.col("observed") - F.col("expected")) / F.nullif(1 - F.col("expected"), F.lit(0.0)), 6))


def pass_at(attempts: DataFrame, key: str, order: list[str], ok: Column, k: int) -> DataFrame:
    """Share of keys that succeed at the first attempt, and within k attempts."""
    numbered = attempts.withColumns({"_n": F.row_number().over(Window.partitionBy(key).orderBy(*order)), "_ok": ok})
    each = numbered.where(F.col("_n") <= k).groupBy(key).agg(F.max((F.col("_ok") & (F.col("_n") == 1)).cast("int")).alias("one"), F.max(F.col("_ok").cast("int")).alias("some"))
    return each.agg(F.avg("one").alias("pass_at_1"), F.avg("some").alias("pass_at_k"))


def latency(calls: DataFrame, took: Column) -> DataFrame:
    return calls.agg(F.percentile(took, F.lit(0.5)).alias("p50"), F.percentile(took, F.lit(0.95)).alias("p95"))
