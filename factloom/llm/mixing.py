"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

A source's documents all expect target / source_size copies. Documents of a source stand in a fixed
order (size class, then md5 of the id); with one random offset per source, seeded by its name, a document is
emitted once for each integer that the running sum of expected copies crosses at it. Sizes rise along the order, so
the words taken miss the target by about one of the largest documents at most. The running sum is a rank times the
rate, and ranks are counted within small cells (source, size class, leading md5 bits) plus the cells'
prefix sums: a source, or a size, with a third of all rows is dealt over as many tasks as any rows.

Null texts have size 0; documents of size 0 are taken as copies of no words; a null source is a
source of its own, last in order; rows that repeat an id are separate documents of the mix, and so are rows without
one. Long texts are counted inside their rows. Other columns pass through whatever their names; an added column
whose name the input has gets underscores in front. Jobs run when the functions are called. The windows that order
sources, and cells of a source, are over one row for each of these, not over documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import NOT_SPACE, set_aside, staged

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2.0
#: Expected rows of a cell, of which one task ranks several.
CELL_ROWS = 20_000
#: Size classes to a doubling of the size.
CLASSES = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size, target): the level at which sum(min(cap, weight * level)) is the budget,
    which is what resharing the excess again and again comes to. sized has (source, size)."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    caps = sums.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)).withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # the level if all sources before this one, by cap / weight, are full and no later one is
    left = F.sum("source_size").over(everything) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_ = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = caps.withColumn("level", left / open_).withColumn("is_full", F.col("level") * F.col("weight") >= F.col("cap"))
    # sources that are not full come last, and the first of them has the highest level
    top = level.withColumn("final", F.max(F.when(~F.col("is_full"), F.col("level"))).over(everything))
    target = F.when(F.col("is_full"), F.col("cap")).otherwise(F.col("final") * F.col("weight"))
    return top.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST, size: str | None = None) -> DataFrame:
    """docs with _size, _source_size, _target and _copies; docs has doc_id, source and text or, where `size` names
    it, a column of sizes. Reruns give the same copies."""
    inner, give_back = set_aside(docs, "doc_id", "source", size or "text")
    inner = inner.withColumn("_size", F.col(size) if size else word_count(F.col("text")))
    narrow = staged(inner.select("doc_id", "source", "_size"))
    # as many leading bits as keep the largest cell near CELL_ROWS: the order does not depend on them
    bits = max(0, math.ceil(math.log2(max(1, narrow.count() / CELL_ROWS))))
    starts = _cell_starts(_marked(narrow, bits), source_targets(narrow.select("source", F.col("_size").alias("size")), weights, budget, most))
    out = _ranked(_marked(inner, bits), starts)
    out = out.withColumn("_copies", copies(F.col("_place"), F.col("_rate"), offset(F.col("source")), most))
    return give_back(out, ("_size", "_source_size", "_target", "_copies"))


def _marked(sized: DataFrame, bits: int) -> DataFrame:
    digest = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))
    marked = sized.withColumn("_class", F.floor(F.log2(F.col("_size") + 1) * CLASSES).cast("int")).withColumn("_md5", digest)
    lead = F.conv(F.substring("_md5", 1, 8), 16, 10).cast("long")
    return marked.withColumn("_cell", F.coalesce(F.shiftright(lead, 32 - bits), F.lit(-1)) if bits else F.lit(0))


def _cell_starts(marked: DataFrame, sources: DataFrame) -> DataFrame:
    """For each cell, the documents of its source that stand before it, and the source's target and rate."""
    cells = marked.groupBy("source", "_class", "_cell").agg(F.count(F.lit(1)).alias("_in_cell"))
    classes = cells.groupBy("source", "_class").agg(F.sum("_in_cell").alias("_in_class"))
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("_before_cell", before("_in_cell", Window.partitionBy("source", "_class").orderBy("_cell")))
    classes = classes.withColumn("_before_class", before("_in_class", Window.partitionBy("source").orderBy("_class")))
    rate = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    s = sources.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), rate.alias("_rate"))
    c, k = cells.alias("c"), classes.alias("k")
    met = c.join(k, F.col("c.source").eqNullSafe(F.col("k.source")) & (F.col("c._class") == F.col("k._class"))).join(s, F.col("c.source").eqNullSafe(F.col("_s")))
    return met.select(F.col("c.source").alias("_src"), F.col("c._class").alias("_cls"), F.col("c._cell").alias("_cel"), (F.col("_before_cell") + F.col("_before_class")).alias("_before"), "_source_size", "_target", "_rate")


def _ranked(marked: DataFrame, starts: DataFrame) -> DataFrame:
    """Each document's place among its source's, from 1."""
    in_cell = Window.partitionBy("source", "_class", "_cell").orderBy("_md5", "doc_id", "_size")
    ranked = marked.withColumn("_rank", F.row_number().over(in_cell))
    met = ranked.join(starts, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_class") == F.col("_cls")) & (F.col("_cell") == F.col("_cel")))
    return met.withColumn("_place", F.col("_before") + F.col("_rank")).drop("_class", "_md5", "_cell", "_rank", "_src", "_cls", "_cel", "_before")


def offset(source: Column) -> Column:
    """The one random offset of a source, from 0 to 1, by a hash of its name."""
    digits = F.conv(F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 5), 16, 10).cast("double")
    return digits / float(16**5)


def copies(place: Column, rate: Column, offset: Column, most: float) -> Column:
    """Integers crossed at a source's document of this place."""
    crossed = F.floor(offset + rate * place) - F.floor(offset + rate * (place - 1))
    return F.least(crossed, F.lit(math.ceil(most))).cast("long")


def mix_report(docs: DataFrame) -> DataFrame:
    sized = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")))
    out = mix(sized, size="words")
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def emit(docs: DataFrame, **how) -> DataFrame:
    """Each document as often as the mix takes it, with its number among its copies in `copy`."""
    inner, give_back = set_aside(docs, "doc_id", "source", how.get("size") or "text")
    out = mix(inner, **how).where("_copies > 0")
    return give_back(out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))), ("copy",))
