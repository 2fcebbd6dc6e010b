"""Label maps from tagged filings: tags with their row's label, sign convention and statement, built into a map."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.facts import label_map

# Beginnings of concepts that are cash flows; labels that are dates or numbers; a note's mark at the end;
# the words before a row's first number; the longest text that can still be one row.
CASH_FLOW_ROOTS = ("CashFlows", "IncreaseDecreaseInCash", "EffectOfExchangeRateChangesOnCash", "ProceedsFrom", "PaymentsFor", "PaymentsTo", "AdjustmentsFor", "CashAndCashEquivalentsAtBeginning", "CashAndCashEquivalentsAtEnd")
DATE_LIKE = r"(?i)^(?:\d{1,2}\s*[./-]\s*\d{1,2}\s*[./-]\s*\d{2,4}|.*\b(19|20)\d{2}\b\s*)$"
NUMERIC_LABEL = r"^[(\-–−+]?[\d.,\s]+[)%]?$"
NOTE_MARK = r"\s*(?:\[[A-Za-z0-9]{1,3}\]|\((?:see\s+)?[Nn]ote[^)]*\))\s*$"
LEAD_TEXT = re.compile(r"^([^\d]{2,}?)\s+[(\-–−+]?\d")
ROW_CHARS = 250
_ABOVE = 4  # levels in which a sign may stand outside its tag
_NEAR = 3  # characters beside a tag in which it may


class _Page(HTMLParser):
    """Elements of a page with their parents and their range in the page's text."""

    def __init__(self, page: str):
        super().__init__()
        self.text, self.size, self.open = [], 0, []
        self.items: list[dict] = []
        self.feed(page)
        self.close()
        while self.open:
            self._end()
        self.body = "".join(self.text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.items.append({"tag": tag.rpartition(":")[2], "name": tag, "attrs": dict(attrs), "up": self.open[-1] if self.open else None, "start": self.size, "end": self.size, "order": len(self.items)})
        self.open.append(len(self.items) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        self._end()

    def handle_endtag(self, tag: str) -> None:
        if any(self.items[i]["name"] == tag for i in self.open):
            while self.items[self._end()]["name"] != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        self.size += len(data)

    def _end(self) -> int:
        i = self.open.pop()
        self.items[i].update(end=self.size, last=len(self.items))
        return i

    def above(self, i: int) -> Iterator[dict]:
        up = self.items[i]["up"]
        while up is not None:
            yield self.items[up]
            up = self.items[up]["up"]

    def words(self, item: dict) -> str:
        return re.sub(r"\s+", " ", self.body[item["start"] : item["end"]]).strip()


def _sign_shows(page: _Page, i: int) -> bool:
    """Whether a bracket or minus stands beside the tag's text on the page, inside one of the elements around it."""
    me = page.items[i]
    if me["start"] == me["end"]:
        return False
    for level, e in enumerate(page.above(i)):
        if level == _ABOVE:
            break
        before = page.body[max(e["start"], me["start"] - _NEAR) : me["start"]]
        after = page.body[me["end"] : min(e["end"], me["end"] + _NEAR)]
        if ")" in after or any(c in before for c in "(-–−"):
            return True
    return False


def _row_label(page: _Page, i: int, children: dict[int, list[dict]]) -> str | None:
    """The first cell with text of the table row around a tag; without a row, the words before the first number of the
    nearest element that begins with some."""
    for e in page.above(i):
        if e["tag"] == "tr":
            cells = (page.words(c) for c in children.get(e["order"], []) if c["tag"] in ("td", "th"))
            return next(filter(None, cells), None)
    for e in page.above(i):
        text = page.words(e)
        if len(text) > ROW_CHARS:
            return None
        m = LEAD_TEXT.match(text)
        if m:
            return m[1].strip()
    return None


def tags_of(html: str) -> list[dict]:
    """The tagged numbers of a page: concept, unit and context as named, the row's label, whether the printed sign and
    the tagged one differ; then units of one plain currency and contexts of instants, which the caller joins."""
    page = _Page(html or "")
    children: dict[int, list[dict]] = {}
    for e in page.items:
        if e["up"] is not None:
            children.setdefault(e["up"], []).append(e)
    inside = lambda e: page.items[e["order"] + 1 : e["last"]]
    instants, money = set(), set()
    for e in page.items:
        if e["tag"] == "context" and any(x["tag"] == "instant" for x in inside(e)):
            instants.add(e["attrs"].get("id"))
        if e["tag"] == "unit":
            parts = inside(e)
            measures = [page.words(x) for x in parts if x["tag"] == "measure"]
            if len(measures) == 1 and measures[0].startswith("iso4217:") and not any(x["tag"] == "divide" for x in parts):
                money.add(e["attrs"].get("id"))
    out = []
    for i, e in enumerate(page.items):
        if e["name"] == "ix:nonfraction":
            a = e["attrs"]
            out.append({"concept": a.get("name", ""), "label": _row_label(page, i, children), "is_money": a.get("unitref") in money, "period": "instant" if a.get("contextref") in instants else "duration", "flip": _sign_shows(page, i) != (a.get("sign") == "-")})
    return out


def harvest(pages: DataFrame, taxonomy: str = "ifrs-full", text: str = "text") -> DataFrame:
    """(doc, concept, label, period, flip, drop_reason) of all tagged numbers of pages (doc, text). The walk over a page's
    elements has no built-in form, so pages go through Arrow in batches; a page is one row's work."""

    @F.pandas_udf("array<struct<concept:string,label:string,is_money:boolean,period:string,flip:boolean>>")
    def read(t: pd.Series) -> pd.Series:
        return t.map(tags_of)

    rows = pages.select("doc", F.explode(read(F.col(text))).alias("t")).select("doc", "t.*")
    reason = F.when(~F.col("concept").startswith(f"{taxonomy}:"), "other_taxonomy").when(~F.col("is_money"), "not_money").when(F.col("label").isNull(), "no_label")
    return rows.withColumn("drop_reason", reason).drop("is_money")


def statement_of(concept: Column, all_instant: Column) -> Column:
    """The statement of a concept, from its name and the kind of its periods alone."""
    local = F.substring_index(concept, ":", -1)
    return F.when(all_instant, "balance_sheet").when(local.rlike(f"^(?:{'|'.join(CASH_FLOW_ROOTS)})"), "cash_flow").otherwise("income_statement")


def label_reason(label: Column) -> Column:
    """Why a label can't name a concept: it is empty or a date, or a number; null if it can."""
    return F.when((label == "") | label.rlike(DATE_LIKE), "date_or_empty").when(label.rlike(NUMERIC_LABEL), "numeric")


def build_map(records: DataFrame, min_count: int = 1) -> tuple[DataFrame, DataFrame]:
    """(label map, drops) of harvested records (label, concept, period, flip). A label stays if all its tags name one
    concept, min_count times or more; it turns signs only if all its tags do."""
    clean = records.withColumn("label", F.regexp_replace(F.regexp_replace("label", NOTE_MARK, ""), r"^\s+|\s+$", "")).withColumn("reason", label_reason(F.col("label")))
    good = clean.where("reason is null")
    kinds = good.groupBy("label").agg(F.every(F.col("period") == "instant").alias("instant"), F.count_distinct("concept").alias("n_concepts"), F.count(F.lit(1)).alias("n_tags"))
    kept = label_map(good.select("label", "concept", "flip"), min_count).join(kinds.select("label", "instant"), "label")
    out = kept.select("label", "concept", statement_of(F.col("concept"), F.col("instant")).alias("statement"), "flip", "n_rows")
    why = F.when(F.col("n_concepts") > 1, "several_concepts").when(F.col("n_tags") < min_count, "too_few")
    drops = clean.select("reason").union(kinds.select(why)).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return out, drops


def load_map(spark: SparkSession, path: str) -> DataFrame:
    """(label, concept, statement, flip) of a JSON map from label to two or three values; anything else stops the read."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>", {"mode": "FAILFAST"})).alias("label", "v"))
    bad = ~F.size("v").isin(2, 3) | ~F.get("v", F.lit(0)).contains(":")
    concept = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("label map: wrong entry "), F.col("label"))).cast("string")).otherwise(F.get("v", F.lit(0)))
    return raw.select("label", concept.alias("concept"), F.get("v", F.lit(1)).alias("statement"), F.coalesce(F.get("v", F.lit(2)) == "true", F.lit(False)).alias("flip"))


def write_map(labels: DataFrame, path: str) -> None:
    """The map as one JSON object, labels in order; an empty one is not written: it would look like a map without labels."""
    if labels.isEmpty():
        raise ValueError("no label is left: the map is not written")
    entry = F.struct(F.col("label").alias("key"), F.array("concept", "statement", F.col("flip").cast("string")).alias("value"))
    labels.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("value")).coalesce(1).write.mode("overwrite").text(path)
