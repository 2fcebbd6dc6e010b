"""Equivalence of query results: shape, count, values as multisets, then order where it matters."""

from __future__ import annotations

import threading
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HINTS = {
    "PASS": "",
    "UNSAFE_SQL": "only a single SELECT is allowed",
    "EXECUTION_ERROR": "the statement does not run",
    "TIMEOUT": "the statement takes too long: filter earlier, join on keys",
    "WRONG_SHAPE": "select as many columns as asked for",
    "WRONG_ROWCOUNT": "check filters, grouping and duplicates",
    "WRONG_ORDER": "the rows are right, their order is not",
    "WRONG_VALUES": "as many rows, other values",
}


def normal_cell(df: DataFrame, name: str, tol: float) -> Column:
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        return c.cast("double")
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        v = c.cast("double")
        return F.when(F.isnan(v), v).otherwise(F.bround(v / tol) * tol) if tol > 0 else v
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    return F.lower(F.trim(c.cast("string")))


def normal_rows(df: DataFrame, tol: float) -> DataFrame:
    """Columns by position, cells as text of one form: names do not matter."""
    return df.select(*[normal_cell(df, n, tol).cast("string").alias(f"c{i}") for i, n in enumerate(df.columns)])


def compare(gold: DataFrame, predicted: DataFrame, tol: float = 1e-6, order_by: str | None = None) -> str:
    """One of HINTS' reasons. `order_by` names a column of both that holds the rows' place."""
    empty = gold.isEmpty() or predicted.isEmpty()
    if not empty and len(gold.columns) != len(predicted.columns):
        return "WRONG_SHAPE"
    if gold.count() != predicted.count():
        return "WRONG_ROWCOUNT"
    if empty:
        return "PASS"
    drop = [order_by] if order_by else []
    a, b = normal_rows(gold.drop(*drop), tol), normal_rows(predicted.drop(*drop), tol)
    if not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()):
        return "WRONG_VALUES"
    if order_by and not normal_rows(gold, tol).exceptAll(normal_rows(predicted, tol)).isEmpty():
        return "WRONG_ORDER"
    return "PASS"


def difference(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other: (columns, side, n)."""
    names = gold.columns
    both = gold.withColumn("_s", F.lit(1)).unionByName(predicted.withColumn("_s", F.lit(-1)))
    return both.groupBy(*names).agg(F.sum("_s").alias("n")).where("n <> 0").withColumn("side", F.when(F.col("n") > 0, "gold").otherwise("predicted")).withColumn("n", F.abs("n"))


def score_sql(spark: SparkSession, gold_sql: str, predicted_sql: str, tol: float = 1e-6, timeout_s: float | None = None) -> str:
    """The gold statement must run; the predicted one is checked before it may, and cancelled after timeout_s."""
    from factloom.functions.text import is_safe_select

    if not spark.createDataFrame([(predicted_sql,)], "q string").select(is_safe_select(F.col("q"))).first()[0]:
        return "UNSAFE_SQL"
    gold = spark.sql(gold_sql.strip().rstrip(";"))
    tag, late = f"score-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout_s, stop) if timeout_s else None
    spark.sparkContext.addJobTag(tag)
    try:
        if timer:
            timer.start()
        predicted = spark.sql(predicted_sql.strip().rstrip(";"))
        reason = compare(gold, predicted, tol)
    except (PySparkException, Py4JJavaError):
        return "TIMEOUT" if late.is_set() else "EXECUTION_ERROR"
    finally:
        spark.sparkContext.removeJobTag(tag)
        if timer:
            timer.cancel()
    ordered = " order by " in f" {' '.join(gold_sql.lower().split())} "
    if reason == "PASS" and ordered:
        number = lambda df: df.rdd.zipWithIndex().map(lambda r: (*map(str, r[0]), r[1]))
        names = ", ".join(f"c{i} string" for i in range(len(gold.columns))) + ", place long"
        g, p = (spark.createDataFrame(number(normal_rows(x, tol)), names) for x in (gold, predicted))
        return "PASS" if g.exceptAll(p).isEmpty() else "WRONG_ORDER"
    return reason
