"""Facts from table grids: header groups, sections, scales, footnotes, claimed rows, fact rows with their source.

Tables are (doc, table_ord, page_no, top, n_rows, n_cols), cells (doc, table_ord, ri, ci, text), page texts
(doc, ord, page_no, top, label, text); `top` grows towards the top of a page. Everything is keyed by document, so all
documents are read at once and none is gathered in the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numbers import parse_strict
from factloom.functions.text import norm_label, squash
from factloom.operators.facts import keep_one
from factloom.operators.grids import header_columns
from factloom.sources.stage import staged

TABLE = ["doc", "table_ord"]
# Printed currencies and their codes; words that make a footnote a restatement.
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP", "euros": "EUR", "euro": "EUR", "Euros": "EUR"}
RESTATED = r"(?i)Angepass|Anpassung|restated|adjusted"


@dataclass
class Profile:
    """What is known of a family of documents: how numbers and scales are printed, which headings open which
    statement, which labels name which concept."""

    separator: str
    scale_pattern: str  # two groups: a scale's name and a currency, in either order
    scales: dict[str, int]
    sections: list[tuple[str, str]]  # (beginning of a heading, statement), the first that fits counts
    labels: list[tuple[str, str, str]]  # (printed label, concept, statement), in the order of declaration
    flips: set[str] = field(default_factory=set)  # concepts printed with the opposite sign
    subheader: str | None = None  # of columns that share a year, the one under it counts
    pages: dict[int, str] = field(default_factory=dict)  # statement by page, where no heading tells


def fact_id(*parts: Column) -> Column:
    """A row's id from where it stands, the same on every run."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 32)


def table_id(page: Column, rows: Column, cols: Column) -> Column:
    return F.concat(F.lit("p"), page.cast("string"), F.lit("-"), rows.cast("string"), F.lit("x"), cols.cast("string"))


def currency_code(printed: Column) -> Column:
    """An unknown currency stays as printed, so that a contract can refuse it; none at all reads as EUR."""
    known = F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv])
    return F.coalesce(F.element_at(known, printed), F.nullif(printed, F.lit("")), F.lit("EUR"))


def column_groups(headers: DataFrame, cells: DataFrame, keys: list[str], default: str = "operational control", second: str = "equity") -> DataFrame:
    """headers with `group`: the text above the header cell or, where there is none, the default one until a header
    text repeats, the second one from there. A repeat also forgets the texts seen before it."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("seen"), F.lit(0).alias("group"), F.expr("cast(array() as array<struct<ci:int,group:int>>)").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        again = F.array_contains(acc["seen"], c["text"])
        group = acc["group"] + again.cast("int")
        seen = F.when(again, F.array(c["text"])).otherwise(F.concat(acc["seen"], F.array(c["text"])))
        return F.struct(seen.alias("seen"), group.alias("group"), F.concat(acc["out"], F.array(F.struct(c["ci"].alias("ci"), group.alias("group")))).alias("out"))

    lists = headers.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("ci").cast("int").alias("ci"), "text"))).alias("cs"))
    turns = lists.select(*keys, F.inline(F.aggregate("cs", start, step, lambda acc: acc["out"]))).withColumnRenamed("group", "_turn")
    above = cells.select(*keys, (F.col("ri") + 1).alias("ri"), "ci", F.trim("text").alias("_above"))
    met = headers.join(turns, [*keys, "ci"]).join(above, [*keys, "ri", "ci"], "left")
    printed = F.nullif(F.coalesce("_above", F.lit("")), F.lit(""))
    return met.withColumn("group", F.lower(F.coalesce(printed, F.when(F.col("_turn") > 0, second).otherwise(default)))).drop("_turn", "_above")


def year_columns(cells: DataFrame, subheader: str | None = None) -> DataFrame:
    """(doc, table_ord, ri, ci, year, marker, first): year columns of each table. Of several columns of one year the one
    under `subheader` stays, if it is just one; else the year goes."""
    heads = header_columns(cells, keys=TABLE).select(*TABLE, "ri", "ci", "year", "marker")
    below = cells.select(*TABLE, (F.col("ri") - 1).alias("ri"), "ci", F.trim("text").alias("_sub"))
    met = heads.join(below, [*TABLE, "ri", "ci"], "left") if subheader else heads.withColumn("_sub", F.lit(None).cast("string"))
    same = Window.partitionBy(*TABLE, "year")
    hit = F.coalesce(F.col("_sub") == F.lit(subheader), F.lit(False))
    met = met.withColumns({"_n": F.count(F.lit(1)).over(same), "_h": F.sum(hit.cast("int")).over(same), "_hit": hit})
    kept = met.where("_n = 1 or (_h = 1 and _hit)")
    first = F.min("ci").over(Window.partitionBy(*TABLE))
    return kept.withColumn("first", F.col("ci") == first).drop("_n", "_h", "_hit", "_sub")


def heading_above(tables: DataFrame, texts: DataFrame, sections: list[tuple[str, str]]) -> DataFrame:
    """tables with `heading`: the statement of the nearest heading above on the same page, in one ordered pass over
    headings and tables. Of headings at one height the first in the document counts."""
    statement = F.coalesce(*[F.when(F.col("text").startswith(p), F.lit(s)) for p, s in sections]) if sections else F.lit(None).cast("string")
    heads = texts.where(F.col("label").contains("header") & F.col("top").isNotNull()).withColumn("_s", statement).where("_s is not null")
    both = tables.withColumns({"_side": F.lit(1), "_s": F.lit(None).cast("string"), "_o": F.lit(0)}).unionByName(heads.select("doc", "page_no", "top", "_s", F.lit(0).alias("_side"), (-F.col("ord")).cast("int").alias("_o")), allowMissingColumns=True)
    w = Window.partitionBy("doc", "page_no").orderBy(F.col("top").desc_nulls_last(), "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    found = F.when(F.col("top").isNotNull(), F.last("_s", ignorenulls=True).over(w))
    return both.withColumn("heading", found).where("_side = 1").drop("_side", "_s", "_o")


def with_sections(tables: DataFrame, pages: dict[int, str]) -> DataFrame:
    """tables (with heading and `years`, in order) with `section` and `section_source`: the heading's statement, else that
    declared for the page, else that of the table before, if both show the same years. A table of other years, or of none
    known before it, breaks the chain."""
    declared = F.element_at(F.create_map(*[F.lit(x) for kv in pages.items() for x in kv]), F.col("page_no")) if pages else F.lit(None).cast("string")
    own = tables.withColumn("_own", F.coalesce("heading", declared))
    w = Window.partitionBy("doc").orderBy("table_ord")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    apart = F.col("_own").isNull() & ~F.col("years").eqNullSafe(F.lag("years").over(w))
    marked = own.withColumns({"_island": F.sum(F.col("_own").isNotNull().cast("int")).over(so_far), "_apart": apart.cast("int")})
    inner = Window.partitionBy("doc", "_island").orderBy("table_ord").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.when((F.sum("_apart").over(inner) == 0) & (F.col("_island") > 0), F.first("_own").over(inner))
    source = F.when(F.col("heading").isNotNull(), "heading").when(F.col("_own").isNotNull(), "profile_page_map").when(carried.isNotNull(), "continuation")
    return marked.withColumns({"section": carried, "section_source": source}).drop("_own", "_island", "_apart", "heading")


def _scale_in(text: Column, profile: Profile) -> Column:
    """struct(scale, currency) of a text, null where no known scale is named."""
    a, b = (F.regexp_extract(text, profile.scale_pattern, i) for i in (1, 2))
    known = F.create_map(*[F.lit(x) for kv in profile.scales.items() for x in kv])
    at = lambda c: F.element_at(known, c).cast("long")
    found = F.when(at(b).isNotNull(), F.struct(at(b).alias("scale"), a.alias("currency"))).when(at(a).isNotNull(), F.struct(at(a).alias("scale"), b.alias("currency")))
    return F.when(text.rlike(profile.scale_pattern), found)


def with_scales(tables: DataFrame, cells: DataFrame, texts: DataFrame, profile: Profile) -> DataFrame:
    """tables with `scale`, `printed_currency` and `scale_source`: from the table's first four rows, else from the page,
    else the document's, if all that it states are one; nulls and `inferred` where none is found: never a default."""
    in_cells = cells.where("ri < 4").select(*TABLE, "ri", "ci", _scale_in(F.col("text"), profile).alias("s")).where("s is not null")
    in_texts = texts.select("doc", "page_no", "ord", _scale_in(F.col("text"), profile).alias("s")).where("s is not null")
    by_table = in_cells.groupBy(*TABLE).agg(F.min_by("s", F.struct("ri", "ci")).alias("_t"))
    by_page = in_texts.groupBy("doc", "page_no").agg(F.min_by("s", "ord").alias("_p"))
    of_doc = in_cells.select("doc", "s").union(in_texts.select("doc", "s")).groupBy("doc").agg(F.min("s").alias("_d"), F.max("s").alias("_m")).where("_d = _m").drop("_m")
    met = tables.join(by_table, TABLE, "left").join(by_page, ["doc", "page_no"], "left").join(of_doc, "doc", "left")
    s = F.coalesce("_t", "_p", "_d")
    source = F.when(F.col("_t").isNotNull(), "column_header").when(F.col("_p").isNotNull(), "statement_header").when(F.col("_d").isNotNull(), "document_uniform").otherwise("inferred")
    return met.withColumns({"scale": s["scale"], "printed_currency": s["currency"], "scale_source": source}).drop("_t", "_p", "_d")


def footnotes(marked: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, page_no, marker, note) for the markers (doc, page_no, marker) whose note on the page says restated: the marker
    stands at a line's beginning, by itself."""
    body = F.regexp_replace("text", r"^\s+|\s+$", "")
    asked = marked.where("marker <> ''").select("doc", "page_no", "marker").distinct()
    met = asked.join(texts.select("doc", "page_no", "ord", body.alias("_b")), ["doc", "page_no"]).where(F.col("_b").startswith(F.col("marker")))
    rest = F.regexp_replace(F.expr("substring(_b, length(marker) + 1)"), r"^[)\].:]?", "")
    note = F.regexp_replace(rest, r"^\s+", "")
    said = met.withColumn("_n", note).where(rest.rlike(r"^\s+\S") & (F.length("_n") > 3) & F.col("_n").rlike(RESTATED))
    return said.groupBy("doc", "page_no", "marker").agg(F.min_by(F.substring("_n", 1, 160), "ord").alias("note"))


def label_table(spark, labels: list[tuple[str, str, str]], flips: set[str]) -> DataFrame:
    rows = [(i, *row, row[1] in flips) for i, row in enumerate(labels)]
    df = spark.createDataFrame(rows, "ord int, label string, concept string, statement string, flip boolean")
    return df.select("ord", norm_label(F.col("label")).alias("exact"), squash(F.col("label")).alias("squashed"), "concept", "statement", "flip")


def match_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (label, ...) with `named`, what the first declared label equal to it names: struct(concept, statement,
    flip); labels without white space and case count where none is equal."""
    what = F.struct("concept", "statement", "flip").alias("_w")
    first = lambda k: keep_one(labels, [k], [F.col("ord")]).select(k, what)
    keyed = rows.withColumns({"exact": norm_label(F.col("label")), "squashed": squash(F.col("label"))})
    met = keyed.join(F.broadcast(first("exact").withColumnRenamed("_w", "_e")), "exact", "left").join(F.broadcast(first("squashed").withColumnRenamed("_w", "_s")), "squashed", "left")
    return met.withColumn("named", F.coalesce("_e", "_s")).drop("_e", "_s", "exact", "squashed")


def extract(tables: DataFrame, cells: DataFrame, texts: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """(facts, guards). facts: one row per number or nil cell of a claimed row. A concept is claimed, once in a document and
    statement, by the first row that yields a cell. guards (doc, reason, n) counts tables without a section or a scale,
    rows that name a concept but have no number (empty_row) and rows whose concept is claimed already (dup_label). Runs jobs
    when called: year columns and tables with their sections and scales are staged, as facts and guards both read them."""
    years = staged(year_columns(cells, profile.subheader))
    listed = years.groupBy(*TABLE).agg(F.transform(F.sort_array(F.collect_list(F.struct("ci", "year"))), lambda x: x["year"]).alias("years"), F.first("ri").alias("head"))
    placed = with_sections(heading_above(tables, texts, profile.sections).join(listed, TABLE), profile.pages)
    scaled = staged(with_scales(placed, cells, texts, profile))
    reason = F.when(F.col("section").isNull(), "no_section").when(F.col("scale").isNull(), "no_scale")
    fit = scaled.where("section is not null and scale is not null")
    rows = cells.where("ci = 0").select(*TABLE, "ri", F.regexp_replace("text", r"^\s+|\s+$", "").alias("label")).where("label <> ''")
    rows = match_labels(rows, label_table(cells.sparkSession, profile.labels, profile.flips)).where("named is not null")
    rows = rows.join(fit, TABLE).where((F.col("ri") > F.col("head")) & (F.col("named.statement") == F.col("section")))
    raw = F.regexp_replace("text", r"^\s+|\s+$", "")
    shown = cells.join(years.drop("ri"), [*TABLE, "ci"]).select(*TABLE, "ri", "ci", "year", "marker", "first", raw.alias("raw")).where("raw <> ''")
    shown = shown.withColumn("parsed", parse_strict(F.col("raw"), profile.separator)).where("parsed.value is not null or parsed.is_nil")
    read = rows.join(shown, [*TABLE, "ri"], "left")
    order = Window.partitionBy("doc", "named.concept", "section").orderBy("table_ord", "ri")
    # rows without a cell neither claim nor count as repeats
    claimed = F.when(F.col("ci").isNotNull(), F.struct("table_ord", "ri"))
    ranked = read.withColumn("_first", F.first(claimed, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    late = F.col("_first").isNotNull() & (F.struct("table_ord", "ri") > F.col("_first"))
    kept = ranked.where(~late & F.col("ci").isNotNull()).drop("_first")
    notes = footnotes(kept.select("doc", "page_no", "marker"), texts)
    met = kept.join(notes, ["doc", "page_no", "marker"], "left")
    instant = F.col("section") == "balance_sheet"
    value = F.col("parsed.value") * F.col("scale").cast("decimal(20,0)")
    tid = table_id(F.col("page_no"), F.col("n_rows"), F.col("n_cols"))
    facts = met.select(
        "doc",
        fact_id(F.col("doc"), F.col("page_no"), tid, F.col("ri"), F.col("ci")).alias("fact_id"),
        "table_ord",
        "page_no",
        tid.alias("table_id"),
        "ri",
        "ci",
        F.col("section").alias("statement"),
        "section_source",
        "label",
        F.col("named.concept").alias("concept"),
        F.when(~instant, F.to_date(F.concat("year", F.lit("-01-01")))).alias("period_start"),
        F.to_date(F.concat("year", F.lit("-12-31"))).alias("period_end"),
        F.when(~instant, 12).alias("months"),
        F.when(F.col("note").isNotNull(), "restated").otherwise("audited").alias("period_basis"),
        "note",
        (~F.col("first")).alias("is_comparative"),
        "raw",
        F.when(F.col("named.flip"), -value).otherwise(value).cast("decimal(38,6)").alias("value"),
        F.col("parsed.is_nil").alias("is_nil"),
        "scale",
        "scale_source",
        currency_code(F.col("printed_currency")).alias("currency"),
        F.when(F.col("named.flip"), "taxonomy_balance").otherwise("as_printed").alias("sign_rule"),
        F.array(F.col("section"), F.concat_ws(" ", "year", F.nullif(F.col("marker"), F.lit("")))).alias("header_path"),
    )
    row_reason = F.when(late, "dup_label").when(F.col("ci").isNull(), "empty_row")
    per_row = ranked.select("doc", "table_ord", "ri", row_reason.alias("reason")).where("reason is not null").distinct()
    dropped = scaled.select("doc", reason.alias("reason")).where("reason is not null").union(per_row.select("doc", "reason"))
    return facts, dropped.groupBy("doc", "reason").agg(F.count(F.lit(1)).alias("n"))


def document_text(texts: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc, text): all page texts, then all cells that are not empty, in order, a space between."""
    parts = texts.select("doc", F.struct(F.lit(0).alias("kind"), F.col("ord").cast("int").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), "text").alias("p"))
    parts = parts.unionByName(cells.where("text <> ''").select("doc", F.struct(F.lit(1).alias("kind"), F.col("table_ord").cast("int").alias("a"), F.col("ri").cast("int").alias("b"), F.col("ci").cast("int").alias("c"), "text").alias("p")))
    return parts.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["text"]), " ").alias("text"))
