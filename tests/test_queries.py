"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pytest

import __spark_entry__
from factloom.operators import grids, retrieval
from factloom.plans import queries
from tests.oracle import difference, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, con, name):
    assert difference(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_fiftieth_vector_is_asked(spark, con, monkeypatch):
    ids, vecs = zip(*con.sql("select vec_id, embedding from embeddings order by 1").fetchall())
    vecs = np.array(vecs, float)
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    want = {}
    for q in (i for i in ids if i % 50 == 0):
        score = (vecs @ vecs[ids.index(q)]).round(8)
        best = sorted((-s, i) for s, i in zip(score, ids) if s > 0.2)[:10]
        want[q] = [(i, -s) for s, i in best]
    for asked, held in ((512, 8192), (3, 70)):
        monkeypatch.setattr(retrieval, "ASKED", asked)
        monkeypatch.setattr(retrieval, "HELD", held)
        v = queries._vectors(spark, SF)
        got = retrieval.dense_best(v.where("id % 50 = 0").selectExpr("id qid", "vec qvec"), v, 10, 0.2).collect()
        for q, best in want.items():
            mine = sorted((r["rank"], r["id"], r["score"]) for r in got if r["qid"] == q)
            assert [i for _, i, _ in mine] == [i for i, _ in best] and np.allclose([s for *_, s in mine], [s for _, s in best])
        assert {r["qid"] for r in got} == set(want)
    assert {r["qid"] for r in queries.QUERIES["mmr_select"](spark, SF).collect()} == {q for q, best in want.items() if best}


def test_header_grids_hold_all_orders(spark, con, monkeypatch):
    met, real = [], grids.header_columns
    monkeypatch.setattr(grids, "header_columns", lambda cells: met.append(cells) or real(cells))
    out = queries.QUERIES["header_detect"](spark, SF).collect()
    counts = con.sql("select o_custkey, year(o_orderdate), count(*) from orders group by all").fetchall()
    cells = met[0].collect()
    assert sorted((r["doc"], r["text"]) for r in cells if r["ri"] == 1) == sorted((d, f"{y} 1") for d, y, _ in counts)
    assert sum(int(r["text"][3:]) for r in cells if r["ri"] == 2) == sum(n for *_, n in counts)
    assert any(y < 2000 for _, y, _ in counts) and sorted((r["doc"], r["year"]) for r in out) == sorted((d, y) for d, y, _ in counts if y >= 2000)


def test_sentence_stats_of_odd_texts_equal_sql(spark, tmp_path):
    texts = [None, "", " ", "\n\n", "a.\x0bb", "a \x0b", "a.\x01 b", "\x01", "one \u2028", "one \x85", "a.\xa0b. c", "x\n\n\ny! z", ". \t", "é 👨‍👩‍👧. Two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(queries.QUERIES["sentence_stats"](spark, str(tmp_path)), c, queries.ORACLES["sentence_stats"]) is None


def test_lines_are_dealt_by_their_number(spark, con, monkeypatch):
    from factloom.sources import stage

    monkeypatch.setattr(stage, "TASK_ROWS", 1000)
    lines = con.sql("select count(*) from lineitem").fetchall()[0][0]
    for name in ("duplicate_conflicts",):
        df = queries.QUERIES[name](spark, SF)
        assert f", {-(-lines // 1000)}), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
        assert difference(df, con, queries.ORACLES[name]) is None
