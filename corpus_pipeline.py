"""From raw documents to a training mix: five stages, each over all that the one before kept.

Each stage takes empty tables, nulls in any column, texts of any length within an executor's memory, and further
columns of any name, which pass through. Stages run jobs when they are called."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, linededup, mixing, quality, simhash
from factloom.llm.common import set_aside, staged, table

#: Words of a shingle, and the similarity of two documents' sets of them from which they are near duplicates.
SHINGLE, SIMILARITY = 5, 0.8
KEEP_QUALITY = 0.5


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject. Null texts count as empty and are judged like any
    other; without labels of both kinds the labels' only kind, or else keeping, holds for all. Equal rows fare alike."""
    inner, give_back = set_aside(docs, *OWN)
    model = quality.train(inner, table(spark, sf_dir, "labels"))
    return give_back(quality.score_quality(inner, model).where(F.col("_quality") >= KEEP_QUALITY))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share; n_chars follows the text. Null texts become empty
    ones; rows that repeat an id are one document, rows without an id another, which never keeps a shared line."""
    inner, give_back = set_aside(docs, *OWN)
    out = linededup.drop_shared_lines(inner)
    return give_back(out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates: documents that op3 links, by fingerprints
    of 2 or fewer differing bits, and beyond these the similar ones. Null and empty texts are one group; of
    rows that repeat an id one stays, one with words if there is any; rows without an id all stay."""
    return simhash.one_of_each(docs, SHINGLE, SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs; one is enough, unlike in op8's column. Null and empty texts stay,
    as all do where the benchmark is empty. Equal rows fare alike."""
    inner, give_back = set_aside(docs, *OWN)
    out = decontaminate.mark_contaminated(inner, table(spark, sf_dir, "benchmark"), min_items=1)
    return give_back(out.where(~F.col("_contaminated")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, numbered by `copy`. Documents without words are taken as copies
    of no words; a null source is a source of its own; rows that repeat an id are separate documents."""
    return mixing.emit(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
]
#: Trained and approximate stages: no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = staged(docs) if i + 1 < len(STAGES) else docs
    return docs
