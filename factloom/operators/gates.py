"""Gates in front of the rules: what is wrong within one extracted row, and which rows may become facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import parse_strict
from factloom.operators.truth import split_canonical

# Flags that tell but do not block, and taxonomies that are known.
ADVISORY = ("scale_inferred", "restated")
TAXONOMIES = ("us-gaap", "ifrs-full")
_RATIOS = {"1000": ":1000x", "-1000": ":-1000x", "1000000": ":1e+06x", "-1000000": ":-1e+06x", "0.001": ":0.001x", "-0.001": ":-0.001x"}


def magnitude(raw: Column, separator: Column) -> Column:
    """struct(size, negative) of a printed number; nulls where it is none."""
    value = F.when(separator == ",", parse_strict(raw, ",")["value"]).otherwise(parse_strict(raw, ".")["value"])
    return F.struct(F.abs(value).alias("size"), (value < 0).alias("negative"))


def expected_value(raw: Column, separator: Column, scale: Column, rule: Column) -> Column:
    """What a row's text, scale and sign rule come to. taxonomy_balance turns the printed sign round."""
    m = magnitude(raw, separator)
    size = m["size"] * F.coalesce(scale, F.lit(1)).cast("decimal(20,3)")
    minus = (rule.isin("as_printed", "parenthesis_negative") & m["negative"]) | rule.isin("less_prefix", "outflow_negative") | ((rule == "taxonomy_balance") & ~m["negative"])
    return F.when(F.coalesce(minus, F.lit(False)), -size).otherwise(size)


def flags(row: dict[str, Column] | None = None) -> Column:
    """Names of a row's failed gates, in a fixed order. Columns: span, page_no, grounded, raw, separator, scale, sign_rule,
    value, header_path, period_end, scale_source, period_basis; `row` may put expressions in their place."""
    names = ("span", "page_no", "grounded", "raw", "separator", "scale", "sign_rule", "value", "header_path", "period_end", "scale_source", "period_basis")
    c = {n: F.col(n) for n in names} | (row or {})
    expect = expected_value(c["raw"], c["separator"], c["scale"], c["sign_rule"])
    value = c["value"].cast("decimal(38,6)")
    ratio = value / F.nullif(expect, F.lit(0).cast("decimal(38,6)"))
    suffix = F.coalesce(*[F.when(ratio == F.lit(k).cast("decimal(38,6)"), F.lit(v)) for k, v in _RATIOS.items()], F.lit(""))
    header, year = F.array_join(c["header_path"], " "), F.date_format(c["period_end"], "yyyy")
    return F.array_compact(
        F.array(
            F.when((F.coalesce(c["span"], F.lit("")) == "") | (F.coalesce(c["page_no"], F.lit(0)) == 0), "missing_source_ref"),
            F.when(~F.coalesce(c["grounded"], F.lit(False)), "groundedness_failed"),
            F.when(F.abs(value - expect) > 0.5, F.concat(F.lit("scale_arithmetic_mismatch"), suffix)),
            F.when((F.size(c["header_path"]) > 0) & header.rlike(r"\b(19|20)\d{2}\b") & ~header.contains(year), "header_period_mismatch"),
            F.when(c["scale_source"] == "inferred", "scale_inferred"),
            F.when(c["period_basis"] == "restated", "restated"),
        )
    )


def blocking(found: Column) -> Column:
    """Those of the flags that keep a row out."""
    return F.filter(found, lambda f: ~(f.startswith(ADVISORY[0]) | f.startswith(ADVISORY[1])))


def plain_text(text: Column) -> Column:
    """A document's text for matching spans: tags go only where it is markup."""
    return F.when(text.rlike(r"(?i)^\s*(<\?xml|<!doctype|<html)"), F.regexp_replace(text, "<[^>]+>", "")).otherwise(text)


def gate(rows: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """rows with `flags` and `blocking`. With texts (doc, text) a span that the document does not have is hallucinated,
    whatever the row says of itself."""
    found = flags()
    if texts is not None:
        rows = rows.join(texts.select("doc", plain_text(F.col("text")).alias("_text")), "doc", "left")
        span = F.trim("span")
        false = (span != "") & F.col("_text").isNotNull() & ~F.col("_text").contains(span)
        found = F.array_compact(F.concat(found, F.array(F.when(false, "hallucinated_span"))))
    out = rows.withColumn("flags", found).withColumn("blocking", blocking(F.col("flags")))
    return out.drop("_text") if texts is not None else out


def admit(gated: DataFrame) -> DataFrame:
    """gated rows with `drop_reason`: the first blocking flag, not_canonical, or other_taxonomy (a nil value counts
    there too); null for the rows that become facts, of which taxonomy, name and the period's kind are set."""
    canon = F.col("concept")
    name = split_canonical(canon)
    known = name["taxonomy"].isin(*TAXONOMIES) & F.col("value").isNotNull()
    reason = (
        F.when(F.size("blocking") > 0, F.split(F.get("blocking", F.lit(0)), ":")[0])
        .when(canon.isNull() | ~canon.contains(":"), "not_canonical")
        .when(~F.coalesce(known, F.lit(False)), "other_taxonomy")
    )
    instant = (F.col("statement") == "balance_sheet") | F.col("period_start").isNull()
    out = gated.withColumn("drop_reason", reason).withColumns({"taxonomy": name["taxonomy"], "name": name["name"]})
    return out.withColumn("period_start", F.when(~instant, F.col("period_start")))


def gate_report(gated: DataFrame) -> DataFrame:
    """How many rows each blocking flag or reason kept out; a row counts for every flag it has."""
    admitted = admit(gated)
    by_flag = admitted.select(F.explode(F.transform("blocking", lambda f: F.split(f, ":")[0])).alias("reason"))
    others = admitted.where("size(blocking) = 0 and drop_reason is not null").select(F.col("drop_reason").alias("reason"))
    return by_flag.union(others).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


#: Defects for tests of the gates, each with what finds it: gates, rules, or only the document's text.
DEFECTS = ("scale_1000x", "scale_consistent", "sign_flip", "header_mismatch", "hallucination", "missing_source", "groundedness")


def inject(rows: DataFrame, defect: str, where: Column) -> DataFrame:
    """rows with one kind of defect put into those that `where` names; the others stay as they are."""
    put = lambda name, value: rows.withColumn(name, F.when(where, value).otherwise(F.col(name)))
    if defect == "scale_1000x":
        return put("value", (F.col("value") * 1000).cast(rows.schema["value"].dataType))
    if defect == "scale_consistent":
        big = (F.col("value") * 1000).cast(rows.schema["value"].dataType)
        shown = F.format_number((F.abs("value") * 1000 / F.col("scale")).cast("decimal(38,0)"), 0)
        printed = F.when(F.col("raw").startswith("("), F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)
        return rows.withColumns({"value": F.when(where, big).otherwise(F.col("value")), "raw": F.when(where, printed).otherwise(F.col("raw")), "span": F.when(where, shown).otherwise(F.col("span"))})
    if defect == "sign_flip":
        bare = F.regexp_replace("raw", "[()]", "")
        return rows.withColumns({"value": F.when(where, -F.col("value")).otherwise(F.col("value")), "raw": F.when(where, F.concat(F.lit("("), bare, F.lit(")"))).otherwise(F.col("raw")), "span": F.when(where, bare).otherwise(F.col("span")), "sign_rule": F.when(where, "parenthesis_negative").otherwise(F.col("sign_rule"))})
    if defect == "header_mismatch":
        return put("header_path", F.array(F.lit(""), (F.year("period_end") - 1).cast("string")))
    if defect == "hallucination":
        return put("span", F.lit("999,999"))
    if defect == "missing_source":
        return put("span", F.lit(None).cast("string"))
    if defect == "groundedness":
        return put("grounded", F.lit(False))
    raise ValueError(f"no such defect: {defect}")
