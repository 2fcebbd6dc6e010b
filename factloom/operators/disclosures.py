"""Content index against contents: index pages, their rows, marks in the text, and what is claimed but not found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.grids import until_two_dry

# Fixed patterns: codes of disclosures, rows and references of an index, marks and headings in the text.
CODE = r"(?:E[1-5]|S[1-4]|G1|BP|GOV|SBM|IRO|MDR)"
ANCHORS = ("ESRS-Angabepflicht", "ESRS Angabepflicht", "Disclosure Requirement", "ESRS index", "ESRS Index")
ROW_START = rf"^\s*({CODE}-[A-Z0-9]+)\s+(\S.*)$"
TRAIL_PAGE = r"(?:^|\s{2,})(\d{1,3})\s*$"
SECTION = r"(?i)\bsection\s+([\d.]+)"
BRACKETS = r"\[([^\]]{2,80})\]"
MARK = rf"(?:ESRS[\s-]*)?\b({CODE}[-\s]?[A-Z]?[-\s]?\d+)"
HEADING = rf"(?m)^\s*({CODE}-[A-Z0-9]+)\s+[A-ZÄÖÜ]\S"
NOTE = r"Anhangangabe\s+(\d+)\s*[–-]\s*(.{3,60})"
MIN_ROWS, MIN_RATE = 5, 0.2
#: Codes that stand across a report and have no index row of their own.
ACROSS = ("MDR", "IRO")


def lines_of(pages: DataFrame) -> DataFrame:
    """(doc, page, line, text) of pages (doc, page, text)."""
    return pages.select("doc", "page", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


def index_pages(pages: DataFrame) -> DataFrame:
    """(doc, page) where an index begins: pages whose first line is one of its titles, else, in documents without, those
    with MIN_ROWS rows or more that begin with a code."""
    stripped = F.regexp_replace("text", r"^\s+|\s+$", "")
    first = F.regexp_replace(F.get(F.split(stripped, "\n"), F.lit(0)), r"^\s+|\s+$", "")
    titled = F.lit(False)
    for a in ANCHORS:
        titled = titled | first.startswith(a)
    n = F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(ROW_START)))
    seen = pages.select("doc", "page", titled.alias("titled"), (n >= MIN_ROWS).alias("shaped"))
    some = F.max(F.col("titled").cast("int")).over(Window.partitionBy("doc"))
    return seen.withColumn("_some", some).where("titled or (_some = 0 and shaped)").select("doc", "page")


def index_rows(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, duplicates). rows (doc, code, title, claimed, ref_kind, incorporated, index_page): from the first index page up
    to two pages in a row without a row; a row goes on over the lines below its own; the first reference in it counts, a page
    at a line's end before a section. A code that comes again is in duplicates, its first row stays."""
    start = index_pages(pages).groupBy("doc").agg(F.min("page").alias("_from"))
    after = pages.join(start, "doc").where(F.col("page") >= F.col("_from"))
    wet = F.exists(F.split("text", "\n", -1), lambda x: x.rlike(ROW_START))
    scanned = until_two_dry(after, "doc", "page", wet).select("doc", "page", "text")
    lines = lines_of(scanned).withColumn("opens", F.col("text").rlike(ROW_START))
    w = Window.partitionBy("doc", "page").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_row", F.sum(F.col("opens").cast("int")).over(w)).where("_row > 0 and (opens or trim(text) <> '')")
    end = F.nullif(F.regexp_extract(F.regexp_replace("text", r"\s+$", ""), TRAIL_PAGE, 1), F.lit(""))
    section = F.nullif(F.regexp_extract("text", SECTION, 1), F.lit(""))
    ref = F.when(end.isNotNull(), F.struct(F.lit("page").alias("kind"), end.alias("to"))).when(section.isNotNull(), F.struct(F.lit("section").alias("kind"), section.alias("to")))
    part = F.when(F.col("opens"), F.regexp_extract("text", ROW_START, 2)).otherwise(F.regexp_replace("text", r"^\s+|\s+$", ""))
    whole = rows.withColumns({"_ref": ref, "_part": part}).groupBy("doc", "page", "_row").agg(
        F.max(F.when(F.col("opens"), F.regexp_extract("text", ROW_START, 1))).alias("code"),
        F.min_by("_ref", F.when(F.col("_ref").isNotNull(), F.col("line"))).alias("ref"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "_part"))), lambda x: x["_part"]), " ").alias("body"),
    ).where("ref is not null")
    place = F.row_number().over(Window.partitionBy("doc", "code").orderBy("page", "_row"))
    ranked = whole.withColumn("_n", place)
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace("body", TRAIL_PAGE, "")), SECTION, ""))
    parts = F.split(bare, r"\s{3,}")
    rest = F.trim(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), " "))
    kept = ranked.where("_n = 1").select(
        "doc", "code", F.trim(F.get(parts, F.lit(0))).alias("title"), F.col("ref.to").alias("claimed"), F.col("ref.kind").alias("ref_kind"), F.when(rest.contains("Anhangangabe"), rest).alias("incorporated"), F.col("page").alias("index_page")
    )
    return kept, ranked.where("_n > 1").select("doc", "code", "page")


def marks(pages: DataFrame, index: DataFrame) -> DataFrame:
    """(doc, code, pages): where a code is marked in brackets or heads a section, outside the index."""
    body = pages.join(index.select("doc", F.col("index_page").alias("page")).distinct(), ["doc", "page"], "left_anti")
    inside = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(BRACKETS), F.lit(1)), lambda b: F.regexp_extract_all(b, F.lit(MARK), F.lit(1))))
    joined = F.transform(inside, lambda c: F.upper(F.regexp_replace(F.trim(c), r"\s+", "-")))
    heads = F.transform(F.regexp_extract_all("text", F.lit(HEADING), F.lit(1)), F.upper)
    found = body.select("doc", "page", F.explode(F.array_union(joined, heads)).alias("code"))
    return found.groupBy("doc", "code").agg(F.sort_array(F.collect_set("page")).alias("pages"))


def notes(pages: DataFrame) -> DataFrame:
    """(doc, note, page): the first page on which a numbered note `N | title` stands at a line's beginning."""
    found = pages.select("doc", "page", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*(\d+)\s*\|\s*\S"), F.lit(1))).alias("note"))
    return found.groupBy("doc", "note").agg(F.min("page").alias("page"))


def reconcile(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, claims, orphans). documents (doc, n_codes, n_found, status): no_index, not_conclusive where too few codes are
    found for the marks to mean anything, or conclusive. claims of conclusive documents only: verified, claimed_but_untagged
    or reference_not_found. orphans: codes in the text without an index row, those that stand across a report left out."""
    rows, _ = index_rows(pages)
    found = marks(pages, rows)
    met = rows.join(found.withColumnRenamed("code", "_code"), (rows["doc"] == found["doc"]) & (F.upper(rows["code"]) == F.col("_code")), "left").select(*(rows[c] for c in rows.columns), "pages")
    sums = met.groupBy("doc").agg(F.count(F.lit(1)).alias("n_codes"), F.count("pages").alias("n_found"))
    every = pages.select("doc").distinct().join(sums, "doc", "left").fillna(0, ["n_codes", "n_found"])
    status = F.when(F.col("n_codes") == 0, "no_index").when(F.col("n_found") / F.col("n_codes") < MIN_RATE, "not_conclusive").otherwise("conclusive")
    docs = every.withColumn("status", status)
    sure = docs.where("status = 'conclusive'").select("doc")
    number = F.nullif(F.regexp_extract("incorporated", NOTE, 1), F.lit(""))
    asked = met.join(sure, "doc", "left_semi").withColumn("note", number)
    asked = asked.join(notes(pages).withColumnRenamed("page", "note_page"), ["doc", "note"], "left")
    resolves = F.when(F.col("note").isNotNull(), F.col("note_page").isNotNull())
    state = F.when(~F.coalesce(resolves, F.lit(True)), "reference_not_found").when(F.col("pages").isNotNull(), "verified").otherwise("claimed_but_untagged")
    claims = asked.select("doc", "code", "title", "claimed", "ref_kind", "index_page", F.slice("pages", 1, 6).alias("found_on"), "incorporated", resolves.alias("resolves"), state.alias("status"))
    across = F.col("code").startswith(ACROSS[0]) | F.col("code").startswith(ACROSS[1]) | F.col("code").contains("--")
    orphans = found.join(sure, "doc", "left_semi").join(rows.select("doc", F.upper("code").alias("code")), ["doc", "code"], "left_anti").where(~across)
    return docs, claims, orphans
