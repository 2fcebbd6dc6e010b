"""Grid and position operators: headers, nearest-above, carry-forward, uniform scale, index pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed patterns: a year in a phrase, and a cell that is only a year with an optional footnote mark.
YEAR_ANYWHERE = r"(?<!\d)(20\d{2})(?!\d)"
YEAR_BARE = r"(?<!\d)(20\d{2})(?!\d)\s*([¹²³⁴⁵⁶⁷⁸⁹⁰*†‡§]|\d{1,2})?\s*$"


def header_columns(cells: DataFrame, max_rows: int = 4, bare: bool = True, keys: list[str] | None = None) -> DataFrame:
    """Year columns of each table of cells (keys, ri, ci, text): the row, among the first, with the most
    year cells right of the label column; the earliest of those with as many. A table's key is `doc` unless told."""
    keys = keys or ["doc"]
    pattern = YEAR_BARE if bare else YEAR_ANYWHERE
    found = cells.where((F.col("ri") < max_rows) & (F.col("ci") > 0)).withColumn("year", F.regexp_extract("text", pattern, 1)).where("year <> ''")
    per_row = found.groupBy(*keys, "ri").agg(F.count(F.lit(1)).alias("n"))
    best = per_row.groupBy(*keys).agg(F.max_by("ri", F.struct("n", -F.col("ri"))).alias("ri"))
    marker = F.regexp_extract("text", pattern, 2) if bare else F.lit("")
    out = found.join(best, [*keys, "ri"]).withColumn("marker", marker)
    return out.withColumn("is_target", F.lower("text").contains("target"))


def unique_years(headers: DataFrame, below: DataFrame, subheader: str) -> DataFrame:
    """Columns whose year is theirs alone, or that are the only one of the year under `subheader`."""
    met = headers.join(below.select("doc", "ci", F.col("text").alias("sub")), ["doc", "ci"], "left").withColumn("hit", F.coalesce(F.col("sub") == subheader, F.lit(False)))
    w = Window.partitionBy("doc", "year")
    met = met.withColumns({"_n": F.count(F.lit(1)).over(w), "_h": F.sum(F.col("hit").cast("int")).over(w)})
    return met.where("_n = 1 or (_h = 1 and hit)").drop("_n", "_h", "sub", "hit")


def nearest_before(left: DataFrame, right: DataFrame, key: str, at: str, carry: list[str]) -> DataFrame:
    """Each left row with the right row of its key at the largest position not after its own: one
    ordered pass over both sides instead of a range join. Right rows win ties of position."""
    cols = {c: F.col(c) for c in carry}
    l_ = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(F_struct(right, [at, *carry])).alias("_r"))
    r_ = right.select(F.col(key), F.col(at), F.lit(0).alias("_side"), F.struct(F.col(at), *cols.values()).alias("_r"))
    both = l_.unionByName(r_, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.last("_r", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_r")


def F_struct(df: DataFrame, names: list[str]):
    from pyspark.sql.types import StructType

    return StructType([df.schema[n] for n in names])


def carry_forward(df: DataFrame, key: str, order: list[Column], value: str, breaks: Column, out: str) -> DataFrame:
    """The last non-null value within the island that a row with `breaks` opens."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    islands = df.withColumn("_island", F.sum(breaks.cast("int")).over(w))
    inner = Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn(out, F.last(value, ignorenulls=True).over(inner)).drop("_island")


def uniform(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys all of whose rows hold one value: the only case in which it is safe to apply it to all."""
    return df.groupBy(key).agg(F.min(value).alias("value"), F.max(value).alias("_max"), F.count(F.lit(1)).alias("n_rows")).where("value = _max").drop("_max")


def coverage(gold: DataFrame, numbers: DataFrame, rel: float = 0.005) -> DataFrame:
    """gold (doc, id, value) with `hit_own` and `hit_other`: is there a number (doc, value) of the same
    document, of another one, within the tolerance. The tolerance's ends differ by at most three
    buckets of asinh, so the band is an equality join on buckets and an exact check."""
    bucket = lambda x: F.floor(F.asinh(x / 100.0) * 100)
    v, tol = F.col("value"), F.greatest(F.lit(0.5), F.abs(F.col("value")) * rel)
    wanted = gold.select("doc", "id", "value", F.explode(F.sequence(bucket(v - tol), bucket(v + tol))).alias("b"))
    near = F.abs(F.col("n_value") - v) <= tol
    own = wanted.join(numbers.select("doc", F.col("value").alias("n_value")).distinct().withColumn("b", bucket(F.col("n_value"))), ["doc", "b"]).where(near)
    # of a value only two of the documents that hold it matter: one of them is another one than the gold row's
    held = numbers.groupBy(F.col("value").alias("n_value")).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).withColumn("b", bucket(F.col("n_value")))
    other = wanted.join(held, "b").where(near & ((F.col("lo") != F.col("doc")) | (F.col("hi") != F.col("doc"))))
    flag = lambda df, name: df.select("doc", "id").distinct().withColumn(name, F.lit(1))
    return gold.join(flag(own, "hit_own"), ["doc", "id"], "left").join(flag(other, "hit_other"), ["doc", "id"], "left").fillna(0, ["hit_own", "hit_other"])


def until_two_dry(pages: DataFrame, key: str, page: str, wet: Column) -> DataFrame:
    """Pages before the first of two consecutive ones without a hit."""
    w = Window.partitionBy(key).orderBy(page)
    flagged = pages.withColumn("_dry", ~wet).withColumn("_end", F.col("_dry") & F.coalesce(F.lead("_dry").over(w), F.lit(False)))
    ended = F.max(F.col("_end").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("_over", ended).where("_over = 0").drop("_dry", "_end", "_over")


def assemble_rows(lines: DataFrame, key: str, line: str, text: str, opens: Column) -> DataFrame:
    """Rows of several lines: a line that `opens` begins a row, the others join the one before."""
    w = Window.partitionBy(key).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("row", F.sum(opens.cast("int")).over(w)).where("row > 0")
    parts = numbered.groupBy(key, "row").agg(F.sort_array(F.collect_list(F.struct(line, text))).alias("_l"))
    return parts.withColumn(text, F.array_join(F.transform("_l", lambda x: x[text]), " ")).drop("_l")
