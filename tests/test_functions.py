"""Column functions and operators against hand-computed values."""

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import numbers as N
from factloom.functions import text as X
from factloom.operators import chunks, facts, grids, retrieval, rowsets, signals, traces
from factloom.sources import readers, sinks
from factloom.streaming.breaker import step


def apply(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


GOOD = {
    ".": {"12,756.6": "12756.6", "1,250": "1250", "838": "838", "2742.50": "2742.5", ".3333": "0.3333", "32%": "32", "(1,250)": "-1250", "-4,763.8": "-4763.8", "–4,763.8": "-4763.8", "−4,763.8": "-4763.8"},
    ",": {"24.308": "24308", "13.920.157": "13920157", "13,9": "13.9", ",5": "0.5"},
}
# Tokens that no reading accepts, then some of our own.
REJECT = {
    ".": ("(123", "123)", "((123))", "(12(3)", "(1,250", "--123", "+-123", "-+123", "−−5", "(-123)", "1,23,4", "1,2345", "12,34", ",5", ".", ",", "..", "(.)", "(,)", "-.", "%", "12%%", "1..2", "1 234", "1,234,56", "0x1F", "1e5", "٣", "5-", "$5"),
    ",": ("1.23.4", "1.2.3", ".3333", "1,2,3", "1.2345", "12.34"),
}


@pytest.mark.parametrize("sep", [".", ","])
def test_strict_numbers(spark, sep):
    got = apply(spark, list(GOOD[sep]), lambda c: N.parse_strict(c, sep))
    assert [g["value"] for g in got] == [Decimal(v) for v in GOOD[sep].values()] and not any(g["is_nil"] for g in got)
    assert all(g["value"] is None and not g["is_nil"] for g in apply(spark, REJECT[sep], lambda c: N.parse_strict(c, sep)))
    nil = apply(spark, ["-", "–", "—", "−", "", "  ", None, "N/A", "n/a", "NULL", "n.a.", "NM"], lambda c: N.parse_strict(c, sep))
    assert all(g["is_nil"] and g["value"] is None for g in nil)
    both = [*GOOD[sep], *REJECT[sep]]
    assert apply(spark, both, lambda c: N.is_number_token(c, sep)) == [t in GOOD[sep] for t in both]


def test_lenient_numbers(spark):
    dot = {"2,742.5": 2742.5, "$1,250": 1250, "(2,742.5)": -2742.5, "1.234": 1.234, "1,250": 1250, "13.920.157": 13920157, "1,234,567": 1234567, "1.234,5": 1234.5, "1,234.5": 1234.5, "x": None}
    assert apply(spark, list(dot), lambda c: N.parse_lenient(c, F.lit("."))) == list(dot.values())
    comma = {"1.234": 1234, "1,250": 1.25, "–13.975": -13975, "1.234,5": 1234.5}
    assert apply(spark, list(comma), lambda c: N.parse_lenient(c, F.lit(","))) == list(comma.values())
    texts = ["Umsatzerlöse 24.308 und 13.920.157 sowie 1.234,5", "Revenue 12,756.6 and 1,234,567 plus 2,742.5", "just 42 and 7"]
    assert apply(spark, texts, N.detect_separator) == [",", ".", "."]
    assert {24308.0, 12756.6} <= set(apply(spark, ["24.308 và 12,756.6"], N.numbers_of)[0])


def test_scale_and_cover(spark):
    pairs = [(1000, 1, 3), (1, 1000, -3), (24308, 24308000000, -6), (24.3, 24308, -3), (1500, 1, None), (1100, 1, None), (5, 5, None), (0, 5, None), (5, 0, None)]
    df = spark.createDataFrame([(float(a), float(b), k) for a, b, k in pairs], "d double, g double, k int")
    assert all(r["x"] == r["k"] for r in df.withColumn("x", N.scale_exponent(F.col("d"), F.col("g"))).collect())
    assert apply(spark, [[10040.0], [10800.0]], lambda c: N.covered(F.lit(10000.0), c), "array<double>") == [True, False]


def test_labels(spark):
    same = ["Revenue 2024", "Equity as of 31.12.2022", "davon CH 4 2"]
    assert apply(spark, [*same, "Total assets 1)", "Umsatzerlöse¹", "Revenue*", "Total†"], X.norm_label) == [*same, "Total assets", "Umsatzerlöse", "Revenue", "Total"]
    assert apply(spark, ["Summe Aktiva", "SummeAktiva"], X.squash) == ["summeaktiva"] * 2
    assert apply(spark, ["select 1;", "drop table x", "select 1; select 2", "/* a */ with x as (select 1) select * from x", "select replace(a)", "-- x\ndelete from t"], X.is_safe_select) == [True, False, False, True, False, False]
    assert apply(spark, ['{"a": {"b": "}"}} trailing junk', 'x ```json\n{"a": 1}\n```', "none"], X.extract_json) == ['{"a":{"b":"}"}}', '{"a":1}', None]


def test_headers(spark):
    def columns(grid, bare):
        cells = spark.createDataFrame([(1, r, c, t) for r, row in enumerate(grid) for c, t in enumerate(row)], "doc int, ri int, ci int, text string")
        return sorted((r["ri"], r["ci"], r["year"], r["marker"]) for r in grids.header_columns(cells, bare=bare).collect())

    assert columns([["1. Jänner 2025", "327", "1.520"]], False) == []
    assert columns([["", "", "Nhóm 2024", ""], ["Nhãn", "Đơn vị", "2024", "2023"]], False) == [(1, 2, "2024", ""), (1, 3, "2023", "")]
    assert columns([["", "Anhangangabe", "2025", "2024 1"]], True) == [(0, 2, "2025", ""), (0, 3, "2024", "1")]
    assert columns([["", "2024)", "2024€", "FY2024x", "2024 target"]], True) == []
    head = spark.createDataFrame([(1, c, y) for c, y in ((2, "2024"), (3, "2024"), (4, "2023"), (5, "2023"))], "doc int, ci int, year string")
    below = spark.createDataFrame([(1, c, t) for c, t in ((2, "Totale"), (3, "di cui"), (4, "Totale"), (5, "di cui"))], "doc int, ci int, text string")
    pick = lambda sub: sorted(r["ci"] for r in grids.unique_years(head, below, sub).collect())
    assert (pick("Totale"), pick("Total"), pick("")) == ([2, 4], [], [])


def test_chunks():
    doc = " ".join(f"Sentence number {i} has some words in it to be long enough." for i in range(7))
    out = chunks.chunk(doc, 60, 0.2)
    assert len(out) > 1 and all(chunks.n_tokens(c) <= 60 for c in out)
    assert out[1].startswith(chunks.pieces(out[0], 60)[-1])
    assert all(chunks.n_tokens(c) <= 50 for c in chunks.chunk("word " * 500, 50, 0.2)) and chunks.chunk("", 50, 0.2) == []


def test_packing(spark):
    rows = [("q", i, f"only {'abcdef'[i]} text {i}", 40, i) for i in range(5)] + [("q", 9, "only a text 0", 40, 9), ("q", 10, "too large", 500, 10)]
    df = spark.createDataFrame(rows, "q string, id long, text string, tokens int, rank int")
    got = {r["place"]: r["id"] for r in chunks.pack(df, "q", [F.col("rank")], 1000, 0.99).collect()}
    assert got[0] == 0 and got[max(got)] == 1 and 9 not in got.values() and 10 in got.values()
    assert chunks.pack(df, "q", [F.col("rank")], 0).count() == 0


def test_rrf_and_mmr(spark):
    ranks = lambda ids: spark.createDataFrame([(0, i, r + 1) for r, i in enumerate(ids)], "qid int, id int, rank int")
    top = [r["id"] for r in retrieval.ranked(retrieval.rrf([ranks([7, 1, 2]), ranks([1, 9, 3])]), 3).orderBy("rank").collect()]
    assert top[0] == 1 and set(top) == {1, 7, 9}
    corpus = spark.createDataFrame([(0, "error E-4021 means the card was declined"), (1, "get a refund within thirty days"), (2, "shipping takes five days")], "id int, text string")
    ask = lambda t: [r["id"] for r in retrieval.hybrid_search(corpus, spark.createDataFrame([(0, t)], "qid int, text string"), "id", "text").orderBy("pick").collect()]
    assert ask("E-4021")[0] == 0 and ask("get refund")[0] == 1 and ask("quantum chromodynamics lagrangian") == []


def test_identities(spark):
    terms = spark.createDataFrame([("r", "a", 1, 0), ("r", "b", -1, 1), ("r", "c", 0, 2)], "rule string, concept string, coef int, ord int")
    def status(rows):  # noqa: E306
        f = spark.createDataFrame(rows, "concept string, period int, accn string, filed int, unit string, value double, tol double")
        return [(r["status"], r["suspect"]) for r in facts.check(facts.resolve(f, terms)).collect()]

    row = lambda c, v, accn="x", unit="USD": (c, 1, accn, 1, unit, float(v), 0.5)
    assert status([row("a", 10), row("b", 4), row("c", 6)]) == [("PASS", None)]
    assert status([row("a", 10), row("b", 4), row("c", 7)]) == [("PASS", None)] and status([row("a", 10), row("b", 4), row("c", 9)]) == [("FAIL", None)]
    assert status([row("a", 10), row("b", -4), row("c", 6)]) == [("FAIL", "b")]
    assert status([row("a", 10), row("b", 4), row("c", 6, unit="EUR")]) == [("SKIP", None)]
    assert status([row("a", 10), row("b", 4), row("c", 6, "y")]) == [] and status([row("a", 10)]) == []


def test_series(spark):
    s = spark.createDataFrame([("a", 2019, 200.0), ("a", 2025, 100.0), ("b", 2019, 0.0), ("b", 2025, 9.0), ("c", 2025, 1.0)], "k string, year int, value double")
    assert {r["k"]: r["pct"] for r in signals.change(s, ["k"]).collect()} == {"a": -50.0, "b": None, "c": None}
    rows = spark.createDataFrame([("a", 2024, None, 0), ("a", 2025, 5.0, 1), ("a", 2025, 9.0, 2)], "k string, year int, value double, ord int")
    assert [(r["year"], r["value"], r["n_values"]) for r in signals.build_series(rows, ["k"]).collect()] == [(2025, 9.0, 2)]


def test_sql_scores(spark):
    spark.createDataFrame([(1, 10.0, "a"), (2, 20.0, "b"), (3, 20.0, "b")], "id int, amount double, s string").createOrReplaceTempView("t")
    score = lambda g, p: rowsets.score_sql(spark, g, p)
    gold = "select s, sum(amount) from t group by s"
    assert score(gold, "with x as (select * from t) select s as z, sum(amount) as y from x group by s") == "PASS"
    assert score(gold, "select s from t") == "WRONG_SHAPE" and score(gold, "select s, amount from t") == "WRONG_ROWCOUNT"
    assert score(gold, "select s, sum(id) from t group by s") == "WRONG_VALUES" and score(gold, "select nope from t") == "EXECUTION_ERROR"
    assert score(gold, "drop table t") == "UNSAFE_SQL" and score("select 0.3D", "select 0.1D + 0.2D") == "PASS" and score("select null", "select 0") == "WRONG_VALUES"
    assert score("select id from t order by id", "select id from t order by id desc") == "WRONG_ORDER"


def test_breaker():
    opened, failures, seen = None, 0, []
    for at, ok in ((0, False), (1, False), (2, False), (3, True), (33, True), (34, True)):
        state, opened, failures = step(opened, failures, at, ok, 3, 30)
        seen.append(state)
    assert seen == ["CLOSED", "CLOSED", "CLOSED", "OPEN", "HALF_OPEN", "CLOSED"]


def test_traces(spark):
    same = spark.createDataFrame([("r", t, "f", 0.0002) for t in range(4)], "run string, t int, call string, cost double")
    got = traces.stop_reasons(same, "run", ["t"], ["call"], F.col("cost"), 2, 1.0, 9).first()
    assert (got["reason"], got["stop_turn"]) == ("LOOP_DETECTED", 3)
    got = traces.stop_reasons(same, "run", ["t"], ["call"], F.col("cost"), 9, 0.0005, 9).first()
    assert (got["reason"], got["stop_turn"]) == ("BUDGET_EXCEEDED", 4)


def test_sources(spark, tmp_path):
    good = tmp_path / "d.json"
    good.write_text('{"schema_name": "DoclingDocument", "texts": [{"label": "p", "text": " a ", "prov": [{"page_no": 2}]}, {"text": " "}], "tables": [{"prov": [{"page_no": 1}], "data": {"num_rows": 1, "num_cols": 2, "grid": [[{"text": "x"}, {"text": "y"}]]}}]}')
    docs = readers.parsed_documents(spark, str(good))
    assert [(r["page_no"], r["text"]) for r in readers.text_blocks(docs).collect()] == [(2, "a")]
    assert [(r["table_id"], r["ri"], r["ci"], r["text"]) for r in readers.table_cells(docs).collect()] == [("p1-1x2", 0, 0, "x"), ("p1-1x2", 0, 1, "y")]
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"k": "a"}\n{"k": null}\n')
    with pytest.raises(Exception, match="missing k"):
        readers.json_lines(spark, str(bad), "k string", ("k",)).collect()
    x = tmp_path / "x.json"
    x.write_text('{"facts": {"f1": {"value": "5", "decimals": -3, "dimensions": {"concept": "ifrs-full:Revenue", "entity": "e", "period": "2024-01-01T00:00:00/2025-01-01T00:00:00", "unit": "iso4217:EUR"}}, "f2": {"value": "6", "dimensions": {"concept": "a:b", "axis": "z", "period": "2025-01-01T00:00:00", "unit": "iso4217:EUR"}}}}')
    (r,) = readers.xbrl_json_facts(spark, str(x), "EUR").collect()
    assert (r["concept"], str(r["period_start"]), str(r["period_end"]), r["value"]) == ("Revenue", "2024-01-01", "2024-12-31", Decimal(5))
    assert readers.missing_inputs(spark, [str(x), str(tmp_path / "no")]) == [str(tmp_path / "no")]


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 9)], "k string, t int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, t int")
    assert sorted(map(tuple, sinks.upsert(old, new, "k", "t").collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_lexical_best_equals_pairs(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(i % 9))) for i in range(60)] + [(60, None), (61, "w1 w2"), (62, "w1 w2")]
    asked = spark.createDataFrame([("a", "w1 w2 w2"), ("b", "w3 none"), ("c", None), ("d", "absent")], "qid string, text string")
    met, real = [], retrieval.bm25
    monkeypatch.setattr(retrieval, "bm25", lambda *a: met.append(1) or real(*a))
    for docs, few, calls in ((rows, 2048, 0), (rows, 1, 1), ([*rows, (5, "w3 w3")], 2048, 1)):
        docs = spark.createDataFrame(docs, "id int, text string").repartition(3)
        want = retrieval.ranked(real(docs, asked, "id", "text").withColumn("score", F.round("score", 8)), 4)
        monkeypatch.setattr(retrieval, "FEW_QUERIES", few)
        met.clear()
        got = retrieval.bm25_best(docs, asked, "id", "text", 4)
        assert sorted(map(tuple, got.select("qid", "id", "rank", F.round("score", 6)).collect())) == sorted(map(tuple, want.select("qid", "id", "rank", F.round("score", 6)).collect())) and len(met) == calls


def test_vectors_of_a_batch_and_sense_in_place(spark, monkeypatch):
    texts = ["Refunds refund, E-4021 a ab abc", None, "", "ab ab-c 7 ---", "É naïve 12-34-5"]
    assert (X.unit_vectors(texts) == np.array([X.unit_vector(t or "") for t in texts])).all() and X.unit_vectors([]).shape == (0, 1024)
    docs = spark.createDataFrame([(i, f"alpha{i % 5} beta{i % 3} gamma {i}") for i in range(40)], "id int, text string")
    asked = spark.createDataFrame([(0, "alpha1 gamma"), (1, "beta2 beta2"), (2, "nothing")], "qid int, text string")
    blocks, real = [], retrieval.dense_best
    monkeypatch.setattr(retrieval, "dense_best", lambda *a: blocks.append(1) or real(*a))
    got = []
    for few in (2048, 1):
        monkeypatch.setattr(retrieval, "FEW_QUERIES", few)
        got.append(sorted(map(tuple, retrieval.hybrid_search(docs, asked, "id", "text").collect())))
        assert bool(blocks) == (few == 1)
    assert got[0] == got[1] and got[0]
