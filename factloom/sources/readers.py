"""Sources: parsed documents, JSON lines, fact collections, paged text. They fail on what they can't trust."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.numbers import parse_strict
from factloom.operators.facts import keep_more_precise

DOCUMENT = (
    "schema_name string, name string, "
    "texts array<struct<label:string,text:string,prov:array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double,coord_origin:string>>>>>, "
    "tables array<struct<prov:array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double,coord_origin:string>>>,data:struct<num_rows:int,num_cols:int,grid:array<array<struct<text:string>>>>>>"
)
ANNUAL_FORMS = ("10-K", "10-K/A", "20-F", "20-F/A")


def parsed_documents(spark: SparkSession, path: str, schema_name: str = "DoclingDocument") -> DataFrame:
    """One row per file; another schema_name stops the read."""
    raw = spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("doc", F.input_file_name())
    wrong = F.raise_error(F.concat(F.lit("not a parsed document: "), F.col("doc")))
    return raw.withColumn("schema_name", F.when(F.col("schema_name") == schema_name, F.col("schema_name")).otherwise(wrong))


def text_blocks(docs: DataFrame) -> DataFrame:
    """(doc, ord, page_no, bbox, label, text) of the blocks that are not blank."""
    rows = docs.select("doc", F.posexplode("texts").alias("ord", "t"))
    first = F.get("t.prov", F.lit(0))
    return rows.select("doc", "ord", first["page_no"].alias("page_no"), first["bbox"].alias("bbox"), "t.label", F.trim("t.text").alias("text")).where("text <> ''")


def table_cells(docs: DataFrame) -> DataFrame:
    """(doc, table_ord, page_no, table_id, ri, ci, text)."""
    tables = docs.select("doc", F.posexplode("tables").alias("table_ord", "t"))
    page = F.get("t.prov", F.lit(0))["page_no"]
    named = tables.select("doc", "table_ord", page.alias("page_no"), F.format_string("p%d-%dx%d", page, "t.data.num_rows", "t.data.num_cols").alias("table_id"), "t.data.grid")
    rows = named.select("*", F.posexplode("grid").alias("ri", "row")).drop("grid")
    return rows.select("doc", "table_ord", "page_no", "table_id", "ri", F.posexplode("row").alias("ci", "cell")).select("doc", "table_ord", "page_no", "table_id", "ri", "ci", F.col("cell.text").alias("text"))


def with_sidecar(docs: DataFrame, meta: DataFrame) -> DataFrame:
    """Joins (stem, sha256, parser_version) by the file's stem; defaults where there is none."""
    stem = F.regexp_extract("doc", r"([^/]+?)(?:\.docling)?\.json$", 1)
    return docs.withColumn("stem", stem).join(meta, "stem", "left").fillna({"sha256": "", "parser_version": "unknown"})


def json_lines(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines; a broken line or a missing required field stops the read, blank lines don't count."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for name in required:
        df = df.withColumn(name, F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(F.lit(f"missing {name}"))))
    return df


def extracted_facts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of extracted facts with `drop_reason`: null values are kept and counted, not read as zero."""
    df = json_lines(spark, path, "line_item_canonical string, statement string, period_start string, period_end string, value decimal(38,6), source_ref struct<page_no:int,verbatim_span:string>")
    return df.withColumn("drop_reason", F.when(F.col("value").isNull(), "nil_value"))


def company_facts(spark: SparkSession, path: str, currency: str = "USD") -> DataFrame:
    """Facts of annual forms in one currency; of rows with one key the last filed stays."""
    kind = "map<string,map<string,struct<units:map<string,array<struct<start:string,end:string,val:decimal(38,6),accn:string,form:string,filed:string>>>>>>"
    raw = spark.read.schema(f"facts {kind}").option("multiLine", True).json(path)
    f = raw.select(F.explode("facts").alias("taxonomy", "concepts")).select("taxonomy", F.explode("concepts").alias("concept", "c"))
    f = f.select("taxonomy", "concept", F.explode("c.units").alias("unit", "rows")).where(F.col("unit") == currency)
    f = f.select("taxonomy", "concept", "unit", F.posexplode("rows").alias("ord", "r")).where(F.col("r.form").isin(*ANNUAL_FORMS))
    keyed = f.select("taxonomy", "concept", "unit", F.to_date("r.start").alias("period_start"), F.to_date("r.end").alias("period_end"), "r.accn", F.to_date("r.filed").alias("filed"), F.col("r.val").alias("value"), "ord")
    return keyed.groupBy("taxonomy", "concept", "unit", "period_start", "period_end", "accn").agg(F.max_by("value", "ord").alias("value"), F.max_by("filed", "ord").alias("filed"))


def xbrl_json_facts(spark: SparkSession, path: str, currency: str) -> DataFrame:
    """Facts without extra dimensions; instants and ends are exclusive, so a day goes off them."""
    raw = spark.read.schema("facts map<string,struct<value:string,decimals:int,dimensions:map<string,string>>>").option("multiLine", True).json(path)
    f = raw.select(F.explode("facts").alias("id", "f")).select("id", "f.*")
    plain = F.size(F.array_except(F.map_keys("dimensions"), F.array(*map(F.lit, ("concept", "entity", "period", "unit", "language"))))) == 0
    f = f.where(plain & (F.element_at("dimensions", "unit") == f"iso4217:{currency}"))
    period, concept = F.split(F.element_at("dimensions", "period"), "/"), F.split(F.element_at("dimensions", "concept"), ":")
    day = lambda c: F.date_sub(F.to_date(F.substring(c, 1, 10)), 1)
    start = F.when(F.size(period) == 2, F.to_date(F.substring(F.get(period, F.lit(0)), 1, 10)))
    return f.select(F.get(concept, F.lit(0)).alias("taxonomy"), F.get(concept, F.lit(1)).alias("concept"), start.alias("period_start"), day(F.element_at(period, -1)).alias("period_end"), F.col("value").try_cast("decimal(38,6)").alias("value"), "decimals")


def ixbrl_contexts(pages: DataFrame, text: str = "text") -> DataFrame:
    """(doc, context, start, end) of the contexts without dimensions."""
    block = r"(?s)<(?:\w+:)?context\b.*?</(?:\w+:)?context>"
    rows = pages.select("doc", F.explode(F.regexp_extract_all(text, F.lit(block), F.lit(0))).alias("c")).where(~F.col("c").contains("explicitMember") & ~F.col("c").contains("typedMember"))
    pick = lambda tag: F.to_date(F.nullif(F.regexp_extract("c", rf"<(?:\w+:)?{tag}>\s*(\d{{4}}-\d\d-\d\d)", 1), F.lit("")))
    return rows.select("doc", F.regexp_extract("c", r'\bid="([^"]+)"', 1).alias("context"), pick("startDate").alias("start"), F.coalesce(pick("endDate"), pick("instant")).alias("end"))


# Currencies that are read.
CURRENCIES = ("USD", "EUR", "GBP", "NOK", "CHF", "JPY", "CAD", "AUD", "BRL", "CNY", "DKK", "SEK")


def currency_of(unit: Column) -> Column:
    """The currency that a unit names: by itself, as its last run of letters, or after iso4217; never inside a word."""
    upper = F.upper(unit)
    letters = F.filter(F.split(upper, "[^A-Z]+"), lambda x: x != "")
    last = F.when(~unit.rlike("[^A-Za-z]$"), F.element_at(F.when(F.size(letters) > 0, letters), -1))
    iso = F.regexp_extract(upper, r"^ISO4217[_-]?([A-Z]{3})$", 1)
    return F.coalesce(*[F.when(c.isin(*CURRENCIES), c) for c in (upper, last, iso)])


def ixbrl_tags(pages: DataFrame, contexts: DataFrame, text: str = "text", taxonomies: tuple[str, ...] = ("us-gaap", "ifrs-full")) -> DataFrame:
    """All tagged numbers with `drop_reason`: nil, other_taxonomy, dimensional (its context is none of `contexts`),
    not_money or unparseable; null for those that are facts. Format, scale and sign are read from the tag."""
    tag = r"(?s)<ix:nonFraction\b[^>]*(?:/>|>.*?</ix:nonFraction>)"
    rows = pages.select("doc", F.posexplode(F.regexp_extract_all(text, F.lit(tag), F.lit(0))).alias("ord", "t"))
    head = F.regexp_extract("t", r"(?s)^(<[^>]*>)", 1)
    attr = lambda n: F.regexp_extract(head, rf'(?:^|\s){n}="([^"]*)"', 1)
    inner = F.regexp_replace(F.regexp_replace("t", "<[^>]*>", ""), "&#160;", "")
    shown = F.regexp_replace(F.regexp_replace(inner, " ", " "), r"^\s+|\s+$", "")
    european = attr("format").contains("comma-decimal")
    parsed = F.when(european, parse_strict(shown, ",")).otherwise(parse_strict(shown, "."))
    read = rows.select("doc", "ord", attr("name").alias("_name"), attr("contextRef").alias("context"), attr("unitRef").alias("unit_ref"), attr("decimals").alias("decimals"), attr("scale").alias("_scale"), attr("sign").alias("_sign"), attr("xsi:nil").alias("_nil"), attr("format").contains("fixed-zero").alias("_zero"), parsed.alias("_p"), shown.alias("raw"))
    met = read.join(contexts.select("doc", "context", "start", "end", F.lit(True).alias("_c")), ["doc", "context"], "left")
    name = F.split("_name", ":")
    value = F.when(F.col("_zero"), F.lit(0).cast("decimal(38,6)")).otherwise(F.col("_p.value"))
    scale = F.pow(F.lit(10.0), F.coalesce(F.col("_scale").try_cast("int"), F.lit(0))).cast("decimal(20,6)")
    signed = (F.when(F.col("_sign") == "-", -value).otherwise(value) * scale).cast("decimal(38,6)")
    reason = (
        F.when(F.col("_nil") == "true", "nil")
        .when(~F.get(name, F.lit(0)).isin(*taxonomies), "other_taxonomy")
        .when(F.col("_c").isNull(), "dimensional")
        .when(currency_of(F.col("unit_ref")).isNull(), "not_money")
        .when(~F.col("_zero") & F.col("_p.is_nil"), "nil")
        .when(value.isNull(), "unparseable")
    )
    digits = F.when(F.upper("decimals") == "INF", 1 << 20).otherwise(F.col("decimals").try_cast("int"))
    return met.select("doc", "ord", F.get(name, F.lit(0)).alias("taxonomy"), F.get(name, F.lit(1)).alias("concept"), F.col("start").alias("period_start"), F.col("end").alias("period_end"), currency_of(F.col("unit_ref")).alias("unit"), digits.alias("decimals"), F.when(reason.isNull(), signed).alias("value"), "raw", reason.alias("drop_reason"))


def ixbrl_facts(pages: DataFrame, contexts: DataFrame, text: str = "text") -> DataFrame:
    """Facts of tagged pages: of a concept's repeats in a period the first, unless a later one differs and is more precise.
    An exact value (INF) is the most precise, 0 decimals are real."""
    good = ixbrl_tags(pages, contexts, text).where("drop_reason is null").drop("drop_reason", "raw")
    return keep_more_precise(good, ["doc", "taxonomy", "concept", "period_start", "period_end"], "value", "decimals", ["ord"]).drop("ord")


def drop_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many rows each reason dropped."""
    return rows.where("drop_reason is not null").groupBy(*(by or []), "drop_reason").agg(F.count(F.lit(1)).alias("n"))


EXTRACTED = (
    "fact_id string, statement string, line_item_canonical string, period_start date, period_end date, period_basis string, value_raw_text string, value decimal(38,6), declared_precision int, scale_multiplier long, "
    "scale_source string, currency string, decimal_separator string, sign_rule_applied string, source_ref struct<page_no:int,verbatim_span:string,col_header_path:array<string>>, groundedness_verified boolean, run_id string"
)


def extraction_rows(spark: SparkSession, path: str) -> DataFrame:
    """Extracted rows as the gates read them; a broken line stops the read."""
    df = json_lines(spark, path, EXTRACTED).withColumn("doc", F.input_file_name())
    return df.select(
        "doc", "fact_id", "statement", F.col("line_item_canonical").alias("concept"), "period_start", "period_end", "period_basis", F.coalesce("value_raw_text", F.lit("")).alias("raw"), "value", F.col("declared_precision").alias("decimals"),
        F.coalesce("scale_multiplier", F.lit(1).cast("long")).alias("scale"), "scale_source", F.col("currency").alias("unit"), F.coalesce("decimal_separator", F.lit(".")).alias("separator"), F.col("sign_rule_applied").alias("sign_rule"),
        F.col("source_ref.page_no").alias("page_no"), F.col("source_ref.verbatim_span").alias("span"), F.col("source_ref.col_header_path").alias("header_path"), F.col("groundedness_verified").alias("grounded"), F.col("run_id").alias("accn"),
    )


def converted(spark: SparkSession, path: str, convert: Callable[[bytes, str], dict]) -> DataFrame:
    """(path, sha256, bytes, ok, json, error) of files that `convert` turns into parsed documents, a file at a time on the
    executors. The parser itself is the caller's; a file that it can't read is a row with an error, not a lost job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path_, content in zip(b["path"], b["content"], strict=True):
                digest = hashlib.sha256(content).hexdigest()
                try:
                    rows.append((path_, digest, len(content), True, json.dumps(convert(content, path_), ensure_ascii=False), None))
                except Exception as e:  # noqa: BLE001  whatever a parser raises belongs to its file
                    rows.append((path_, digest, len(content), False, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "sha256", "bytes", "ok", "json", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, sha256 string, bytes long, ok boolean, json string, error string")


def fetched(targets: DataFrame, retries: int = 3, timeout: float = 90.0, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """targets (url, ...) with content, sha256, status and error: fetched on the executors, a few at a time. States that a
    retry can mend are asked again after what the server says, else after 1, 2, 4, ... seconds."""
    from factloom.operators.control import RETRY_STATUS

    def get(url: str) -> tuple[bytes | None, int, str | None]:
        for i in range(retries):
            try:
                with urllib.request.urlopen(url, timeout=timeout) as answer:
                    return answer.read(), getattr(answer, "status", None) or 200, None
            except urllib.error.HTTPError as e:
                if e.code not in RETRY_STATUS or i == retries - 1:
                    return None, e.code, str(e)
                asked = e.headers.get("Retry-After") if e.headers else None
                wait(min(60.0, max(0.0, float(asked))) if asked and asked.replace(".", "", 1).isdigit() else 2.0**i)
            except OSError as e:
                if i == retries - 1:
                    return None, 0, str(e)
                wait(2.0**i)
        return None, 0, "not tried"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                content, status, error = get(row.url)
                out = row._asdict() | {"content": content, "sha256": hashlib.sha256(content).hexdigest() if content is not None else None, "status": status, "error": error}
                yield pd.DataFrame([out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in targets.schema)
    return targets.mapInPandas(run, f"{kinds}, content binary, sha256 string, status int, error string")


def paged_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc, sha256, page, text) of form-feed separated text files."""
    raw = spark.read.text(path, wholetext=True).withColumn("doc", F.input_file_name())
    return raw.select("doc", F.sha2("value", 256).alias("sha256"), F.posexplode(F.split("value", "\f")).alias("page", "text"))


def gold_values(gold: DataFrame) -> DataFrame:
    """(section, field, data_period, unit, scale, value) of nested gold maps."""
    s = gold.select(F.explode("gold").alias("section", "fields")).select("section", F.explode("fields").alias("field", "vals"))
    return s.select("section", "field", F.explode("vals").alias("v")).select("section", "field", "v.*")


def missing_inputs(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that do not exist, on whatever file system they name."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return [p for p in paths if not at(p).getFileSystem(conf).exists(at(p))]
