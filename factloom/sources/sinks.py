"""Sinks: JSON lines, CSV with totals, keyed upserts, content-addressed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.facts import keep_one


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv_with_total(df: DataFrame, path: str, key: str, sums: list[str]) -> None:
    """Rows of each key, a null one among them, and one named TOTAL."""
    sums_ = df.rollup(key).agg(*[F.sum(c).alias(c) for c in sums], F.grouping(key).alias("_total"))
    out = sums_.withColumn(key, F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col(key).cast("string"))).orderBy("_total", key).drop("_total")
    out.write.mode("overwrite").csv(path, header=True)


def upsert(old: DataFrame, new: DataFrame, key: str, newest: str) -> DataFrame:
    """All keys; of a key in both the new batch's row, of several in one batch the newest."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return keep_one(both, [key], [F.col("_batch").desc(), F.col(newest).desc()]).drop("_batch")


def write_replacing(df: DataFrame, path: str) -> None:
    """Written beside the target; then the old table is set aside, the new one takes its name, and only then the old one
    goes. A rename that fails puts the old table back."""
    spark = df.sparkSession
    conf, p = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    new, old, at = p(f"{path}.new"), p(f"{path}.old"), p(path)
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs = at.getFileSystem(conf)
    fs.delete(old, True)
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        raise OSError(f"could not set {path} aside")
    if not fs.rename(new, at):
        if had:
            fs.rename(old, at)
        raise OSError(f"could not replace {path}")
    fs.delete(old, True)


def write_if_absent(df: DataFrame, path: str) -> bool:
    """Writes JSON lines only where nothing is: what was edited by hand stays. Whether it wrote."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return False
    df.write.json(path)
    return True


def files_in(spark: SparkSession, folder: str) -> DataFrame:
    """(local_path) of the files below a folder, by their path in it; only names are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    root = folder.rstrip("/").rpartition("/")[2]
    return files.select(F.regexp_extract("path", rf"/{root}/(.*)$", 1).alias("local_path"))


def not_yet_fetched(targets: DataFrame, manifest: DataFrame, key: str = "local_path", files: DataFrame | None = None) -> DataFrame:
    """Targets without a manifest row or, where `files` are given, without a file: either alone is not enough."""
    have = manifest.select(key).distinct()
    if files is not None:
        have = have.join(files.select(key), key, "left_semi")
    return targets.join(have, key, "left_anti")


def content_addressed(files: DataFrame) -> DataFrame:
    """binaryFile rows with the SHA-256 and size of their content."""
    return files.withColumns({"sha256": F.sha2("content", 256), "bytes": F.length("content")})


def write_partitioned_facts(df: DataFrame, path: str) -> None:
    """By fiscal year, each in some files by company, sorted by company and period: no year is one task's."""
    df.repartition("fiscal_year", F.pmod(F.xxhash64("company_id"), F.lit(16))).sortWithinPartitions("company_id", "period_end").write.mode("overwrite").partitionBy("fiscal_year").parquet(path)


def build_gold(facts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, section, field, vals): values as JSON, newest period first."""
    item = F.struct("data_period", "unit", "scale", "value")
    return facts.groupBy(*(by or []), "section", "field").agg(F.to_json(F.sort_array(F.collect_list(item), asc=False)).alias("vals"))


def contract_errors(df: DataFrame, required: list[str], enums: dict[str, list], patterns: dict[str, str]) -> DataFrame:
    """df with `errors`, the messages of a JSON contract, in the order required, enum, pattern."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c}: required")) for c in required]
    checks += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*v), F.lit(f"{c}: not in enum")) for c, v in enums.items()]
    checks += [F.when(F.col(c).isNotNull() & ~F.col(c).rlike(p), F.lit(f"{c}: pattern")) for c, p in patterns.items()]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))
