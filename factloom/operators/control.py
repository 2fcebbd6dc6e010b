"""Calls and runs as data: costs, retries, repairs, why a run ended, what a tool call came to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# HTTP states that a retry can mend.
RETRY_STATUS = (429, 500, 502, 503, 504)


def cost(tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float) -> Column:
    """US dollars at rates for a million tokens."""
    return (tokens_in * rate_in + tokens_out * rate_out) / 1_000_000


def usage(calls: DataFrame, by: list[str], rate_in: float, rate_out: float) -> DataFrame:
    """Calls, retries, repairs, tokens and cost by group."""
    sums = calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("is_retry").cast("long")).alias("retries"), F.sum(F.col("is_repair").cast("long")).alias("repairs"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return sums.withColumn("cost", F.round(cost(F.col("tokens_in"), F.col("tokens_out"), rate_in, rate_out), 6))


def is_retryable(status: Column) -> Column:
    """A refusal (403) is not: asking again only makes it last."""
    return status.isin(*RETRY_STATUS)


def retry_after(header: Column, attempt: Column) -> Column:
    """Seconds to wait: what the server asks for, within 0 to 60, else a power of two."""
    asked = header.try_cast("double")
    return F.when(asked.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(60.0), asked))).otherwise(F.pow(F.lit(2.0), attempt))


def backoff_bound(attempt: Column, base: float = 0.5, most: float = 8.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def backoff(attempt: Column, key: Column, base: float = 0.5, most: float = 8.0) -> Column:
    """Full jitter, from 0 to the bound, by a hash of the call's key: reruns wait alike."""
    share = F.pmod(F.xxhash64(key, attempt), F.lit(1 << 30)) / float(1 << 30)
    return share * backoff_bound(attempt, base, most)


def replay_retries(calls: DataFrame, key: str, order: list[str], outcome: Column, most: int = 3) -> DataFrame:
    """A row a call's key: how its attempts (outcome ok, transient or permanent) go under a policy of `most` retries. The
    first ok ends it, a permanent error at once, transient ones when retries are spent; attempts after that are not made."""
    w = Window.partitionBy(key).orderBy(*order)
    numbered = calls.withColumns({"_n": F.row_number().over(w), "_o": outcome})
    ends = (F.col("_o") != "transient") | (F.col("_n") > most)
    stop = F.min(F.when(ends, F.col("_n")))
    out = numbered.groupBy(key).agg(stop.alias("_stop"), F.max("_n").alias("_all"), F.min_by("_o", F.when(ends, F.col("_n"))).alias("_last"))
    made = F.coalesce("_stop", "_all")
    result = F.when(F.col("_stop").isNull(), "PENDING").when(F.col("_last") == "ok", "OK").when(F.col("_last") == "permanent", "PERMANENT").otherwise("RETRIES_SPENT")
    return out.select(key, made.alias("attempts"), (made - 1).alias("retries"), result.alias("result"))


def replay_repairs(answers: DataFrame, key: str, order: list[str], errors: Column, most: int = 2) -> DataFrame:
    """A row a key: whether its answers, each with contract errors, become valid within `most` repairs, which are not
    retries: the answer came, but was wrong."""
    w = Window.partitionBy(key).orderBy(*order)
    numbered = answers.withColumns({"_n": F.row_number().over(w), "_e": F.size(errors)}).where(F.col("_n") <= most + 1)
    good = F.min(F.when(F.col("_e") == 0, F.col("_n")))
    out = numbered.groupBy(key).agg(good.alias("_good"), F.max("_n").alias("_all"), F.max_by("_e", "_n").alias("n_errors"))
    made = F.coalesce("_good", "_all")
    return out.select(key, (made - 1).alias("repairs"), F.when(F.col("_good").isNotNull(), "VALID").otherwise("INVALID").alias("result"), F.when(F.col("_good").isNull(), F.col("n_errors")).otherwise(0).alias("n_errors"))


def observations(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """calls (tool, problems, approved, took_s, failure) with ok and error: an unknown tool, wrong arguments, a refused write,
    a call over its tool's time and a failure are all observations, in this order; none stops a run. tools (tool,
    timeout_s, mutating) is the registry, a few rows."""
    met = calls.join(F.broadcast(tools.select("tool", "timeout_s", "mutating").withColumn("_known", F.lit(True))), "tool", "left")
    error = (
        F.when(F.col("_known").isNull(), F.concat(F.lit("no tool "), F.col("tool")))
        .when(F.size("problems") > 0, F.concat(F.lit("wrong arguments: "), F.array_join("problems", "; ")))
        .when(F.col("mutating") & ~F.coalesce("approved", F.lit(True)), "write refused")
        .when(F.col("took_s") > F.col("timeout_s"), F.concat(F.lit("no answer within "), F.col("timeout_s").cast("string"), F.lit(" s; narrow the query")))
        .when(F.col("failure").isNotNull(), F.col("failure"))
    )
    return met.withColumn("error", error).withColumn("ok", F.col("error").isNull()).drop("_known", "timeout_s", "mutating")


def run_ends(turns: DataFrame, key: str, budget: float, max_turns: int, max_repeat: int) -> DataFrame:
    """(key, reason, stop_turn) of runs given as turns (key, turn, cost, is_final, false_cites, signatures): BUDGET_EXCEEDED is
    checked before a turn; then a final answer is UNGROUNDED if it cites what no event has, else COMPLETED; a turn
    without calls is NO_ACTION; one with a call made more than max_repeat times is LOOP_DETECTED; else MAX_TURNS."""
    order = Window.partitionBy(key).orderBy("turn")
    calls = turns.select(key, "turn", F.posexplode("signatures").alias("_i", "signature"))
    so_far = F.row_number().over(Window.partitionBy(key, "signature").orderBy("turn", "_i"))
    most = calls.withColumn("_n", so_far).groupBy(key, "turn").agg(F.max("_n").alias("most_repeats"))
    met = turns.join(most, [key, "turn"], "left").withColumn("spent", F.coalesce(F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    reason = (
        F.when(F.col("turn") > max_turns, "MAX_TURNS")
        .when(F.col("spent") >= budget, "BUDGET_EXCEEDED")
        .when(F.col("is_final") & (F.size("false_cites") > 0), "UNGROUNDED")
        .when(F.col("is_final"), "COMPLETED")
        .when(F.size("signatures") == 0, "NO_ACTION")
        .when(F.col("most_repeats") > max_repeat, "LOOP_DETECTED")
    )
    at = F.when(F.col("reason").isNotNull(), F.col("turn"))
    ends = met.withColumn("reason", reason).groupBy(key).agg(F.min_by("reason", at).alias("reason"), F.min(at).alias("stop_turn"), F.max("turn").alias("turns"))
    return ends.select(key, F.coalesce("reason", F.when(F.col("turns") >= max_turns, "MAX_TURNS").otherwise("RUNNING")).alias("reason"), F.coalesce("stop_turn", "turns").alias("stop_turn"))


def prompt(question: Column, chunks: Column, rules: str) -> Column:
    """A prompt from a question and packed chunks array<struct<id, section, text>>: what is retrieved stands inside marks
    as data, after the rules and before the question."""
    shown = F.array_join(F.transform(chunks, lambda c: F.concat(F.lit("["), c["id"].cast("string"), F.lit("] ("), c["section"], F.lit(") "), c["text"])), "\n\n")
    return F.concat(F.lit(f"{rules}\n\n<evidence>\n"), shown, F.lit("\n</evidence>\n\n"), question)
