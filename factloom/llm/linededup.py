"""Line dedup: lines that many documents share stay in one of them only. DataFrame functions only.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Lines are
counted by a 128-bit hash of the key; only hashes, ids and positions are dealt out for counting,
with counts summed before the shuffle, and texts move once, to meet their list of dropped lines.

Null and empty texts are one empty line and come back as empty texts; a document without an id
counts as one document and never keeps a shared line while another holds it; rows that repeat
an id are one document, which holds the lines of all of them. A text is split inside its row, so its length
is bounded by an executor's memory only; a line that a third of all rows hold is counted by partial sums, and
its rows meet its keeper by broadcast. Ties: the keeper is the largest id, of which there is one. Other columns
pass through whatever their names; an added column whose name the input has gets underscores in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import hot_keys, join_split, set_aside, staged

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS = 40, 5


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case. lower() does the same, faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_hashes(text: Column, min_chars: int) -> Column:
    """For each line its key's hash, null where the key is shorter than min_chars."""
    key = lambda line: F.btrim(line, F.lit(BLANK))
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.when(F.length(key(x)) >= min_chars, F.md5(key(x).cast("binary"))))


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col without the shared lines, plus _n_lines and _n_dropped. Runs jobs when called."""
    inner, give_back = set_aside(docs, id_col, text_col)
    inner = inner.withColumn("_body", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_row", F.xxhash64("_body"))
    narrow = inner.select(F.col(id_col).alias("doc"), F.col("_row").alias("row"), F.col("_body").alias("body"))
    # 36 bytes a line in the shared folder, so that texts are split and hashed once
    placed = staged(narrow.select("doc", "row", F.posexplode(line_hashes(F.col("body"), min_chars)).alias("pos", "h")).where("h is not null").withColumn("h", F.unhex("h")))
    often = staged(placed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs))
    hot = hot_keys(often, "h", placed.count())
    keeper = staged(
        join_split(placed, often.select("h"), "h", hot, "left_semi")
        .groupBy("h", "doc")
        .agg(F.lit(1).alias("one"))
        .groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("h", "keeper")
    )
    drops = (
        join_split(placed, keeper, "h", hot)
        .where(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc").alias("_drop_doc"), F.col("row").alias("_drop_row"))
        .agg(F.collect_set("pos").alias("_drops"))
    )
    met = inner.join(drops, F.col(id_col).eqNullSafe(F.col("_drop_doc")) & (F.col("_row") == F.col("_drop_row")), "left")
    lines = F.split(F.col("_body"), "\n", -1)
    met = met.withColumn("_n_lines", F.size(lines).cast("long"))
    kept = F.array_except(F.sequence(F.lit(0), F.col("_n_lines").cast("int") - 1), F.col("_drops"))
    whole = F.transform(F.array(lines), lambda ls: F.array_join(F.transform(kept, lambda i: F.get(ls, i)), "\n"))
    text = F.when(F.col("_drops").isNull(), F.col("_body")).otherwise(F.element_at(whole, 1))
    met = met.withColumn("_n_dropped", F.when(F.col("_drops").isNull(), 0).otherwise(F.size("_drops")).cast("long"))
    return give_back(met.withColumn(text_col, text), ("_n_lines", "_n_dropped"))


def line_report(docs: DataFrame) -> DataFrame:
    out = drop_shared_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))
