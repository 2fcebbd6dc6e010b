"""Queries over events as calls and runs, and over facts for checks that need no document."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import numbers as N
from factloom.functions import text as X
from factloom.operators import contracts, control, extraction, facts, signals, traces, truth
from factloom.plans.documents import statements
from factloom.plans.registry import query, table

SCHEMA = {"type": "object", "required": ["k", "name"], "additionalProperties": False, "properties": {"k": {"type": "number", "minimum": 20, "maximum": 80}, "name": {"type": "string", "enum": ["view", "click"]}, "tags": {"type": "array", "minItems": 1, "items": {"type": "string"}}}}

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(f"""WITH e AS (SELECT event_id % 7 AS kind, event_type AS t, {_K} AS k FROM events), m AS (SELECT kind, t, k, list_filter(CASE kind
 WHEN 0 THEN ['$: not a JSON text'] WHEN 1 THEN ['$: expected object, got list']
 ELSE [CASE WHEN kind = 2 THEN '$.k: required field is missing' END, CASE WHEN kind = 3 THEN '$.k: expected number, got str' END,
  CASE WHEN kind > 3 AND k < 20 THEN '$.k: must be >= 20, got ' || k END, CASE WHEN kind > 3 AND k > 80 THEN '$.k: must be <= 80, got ' || k END,
  CASE WHEN t NOT IN ('view', 'click') THEN '$.name: must be one of [''view'', ''click''], got ''' || t || '''' END, CASE WHEN kind = 4 THEN '$.tags: needs at least 1 items, got 0' END, CASE WHEN kind = 5 THEN '$.tags[1]: expected string, got int' END, CASE WHEN kind = 6 THEN '$.more: unexpected field, remove it' END] END, lambda x: x IS NOT NULL) AS p FROM e)
 SELECT array_to_string(p, '; ') AS problems, count(*) AS n FROM m GROUP BY ALL""")
def json_contract(spark, sf):
    kind, name = F.col("event_id") % 7, F.concat(F.lit('"name": "'), F.col("event_type"), F.lit('"'))
    k = F.get_json_object("props", "$.k")
    with_k = F.concat(F.lit('{"k": '), k, F.lit(", "), name)
    text = (
        F.when(kind == 0, F.substring("props", 1, 4)).when(kind == 1, "[1, 2]").when(kind == 2, F.concat(F.lit("{"), name, F.lit("}"))).when(kind == 3, F.concat(F.lit('{"k": "'), k, F.lit('", '), name, F.lit("}")))
        .when(kind == 4, F.concat(with_k, F.lit(', "tags": []}'))).when(kind == 5, F.concat(with_k, F.lit(', "tags": ["a", 2]}'))).otherwise(F.concat(with_k, F.lit(', "more": 1}')))
    )
    found = contracts.contract_problems(text, SCHEMA)
    return table(spark, sf, "events").select(found.alias("p")).groupBy(F.array_join("p", "; ").alias("problems")).agg(F.count(F.lit(1)).alias("n"))


TOOL = {"q": {"type": "string", "required": True}, "side": {"type": "string", "enum": ["buy", "sell"]}, "n": {"type": "number"}}


@query("""SELECT CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'missing argument ''q'' (string)' WHEN 2 THEN 'no argument ''z''; there are [''q'', ''side'', ''n'']' WHEN 3 THEN '''side'' must be one of [''buy'', ''sell''], got ''' || event_type || '''' ELSE 'arguments are not a JSON object' END AS problems, count(*) AS n FROM events GROUP BY ALL""")
def tool_arguments(spark, sf):
    kind = F.col("event_id") % 5
    args = F.when(kind == 0, '{"q": "a", "n": 1.5, "side": "buy"}').when(kind == 1, '{"n": 2}').when(kind == 2, '{"q": "a", "z": 1}').when(kind == 3, F.concat(F.lit('{"q": "a", "side": "'), F.col("event_type"), F.lit('"}'))).otherwise("[1]")
    found = contracts.argument_problems(args, TOOL)
    return table(spark, sf, "events").select(found.alias("p")).groupBy(F.array_join("p", "; ").alias("problems")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT errors, count(*) AS n FROM (SELECT concat_ws(';', CASE WHEN o_orderstatus = 'P' AND NOT o_totalprice < 100000 THEN 'pending: must be small' END, CASE WHEN o_orderpriority LIKE '1%' AND NOT year(o_orderdate) >= 1997 THEN 'urgent: must be new' END) AS errors FROM orders) GROUP BY ALL""")
def conditional_contract(spark, sf):
    c = [(F.col("o_orderstatus") == "P", "pending: must be small", F.col("o_totalprice") < 100000), (F.col("o_orderpriority").like("1%"), "urgent: must be new", F.year("o_orderdate") >= 1997)]
    out = contracts.conditional_errors(table(spark, sf, "orders"), c)
    return out.groupBy(F.array_join("errors", ";").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


# Runs: a user's events are turns; an error makes no call, a purchase is a final answer that cites its own number.
_TURNS = f"""WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS turn, value AS cost, event_type AS e, {_K} AS k FROM events),
 c AS (SELECT *, count(*) FILTER (e NOT IN ('error', 'purchase')) OVER (PARTITION BY user_id, e ORDER BY turn) AS times, coalesce(sum(cost) OVER (PARTITION BY user_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM t),
 r AS (SELECT *, CASE WHEN turn > 9 THEN 'MAX_TURNS' WHEN spent >= 150 THEN 'BUDGET_EXCEEDED' WHEN e = 'purchase' AND k % 2 = 1 THEN 'UNGROUNDED' WHEN e = 'purchase' THEN 'COMPLETED' WHEN e = 'error' AND k % 3 = 0 THEN 'NO_ACTION' WHEN e <> 'error' AND times > 2 THEN 'LOOP_DETECTED' END AS why FROM c)"""


@query(f"""{_TURNS} SELECT user_id, coalesce(arg_min(why, turn) FILTER (why IS NOT NULL), CASE WHEN max(turn) >= 9 THEN 'MAX_TURNS' ELSE 'RUNNING' END) AS reason, CAST(coalesce(min(turn) FILTER (why IS NOT NULL), max(turn)) AS INTEGER) AS stop_turn FROM r GROUP BY user_id""")
def run_ends(spark, sf):
    e = table(spark, sf, "events")
    k = F.from_json("props", "k long")["k"]
    final = F.col("event_type") == "purchase"
    cites = F.when(final & (k % 2 == 1), F.array(k)).otherwise(F.array(F.lit(0).cast("long")))
    calls = F.when(final | ((F.col("event_type") == "error") & (k % 3 == 0)), F.expr("cast(array() as array<string>)")).when(F.col("event_type") == "error", F.array(F.concat(F.lit("retry"), F.col("event_id").cast("string")))).otherwise(F.array("event_type"))
    turns = e.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts")).alias("turn"), F.col("value").alias("cost"), final.alias("is_final"), contracts.false_citations(cites, F.array(F.lit(0).cast("long"))).alias("false_cites"), calls.alias("signatures"))
    return control.run_ends(turns, "user_id", 150, 9, 2)


@query(f"""SELECT event_type, count(*) AS calls, count(*) FILTER (event_id % 4 = 0) AS retries, count(*) FILTER (event_id % 9 = 0) AS repairs, CAST(sum({_K}) AS BIGINT) AS tokens_in, CAST(sum({_K} * 2) AS BIGINT) AS tokens_out, round((sum({_K}) * 0.25 + sum({_K} * 2) * 1.25) / 1000000, 6) AS cost FROM events GROUP BY ALL""")
def usage_costs(spark, sf):
    k = F.from_json("props", "k long")["k"]
    calls = table(spark, sf, "events").select("event_type", (F.col("event_id") % 4 == 0).alias("is_retry"), (F.col("event_id") % 9 == 0).alias("is_repair"), k.alias("tokens_in"), (k * 2).alias("tokens_out"))
    return control.usage(calls, ["event_type"], 0.25, 1.25)


@query(f"""WITH e AS (SELECT event_id, 399 + {_K} + CASE event_id % 3 WHEN 0 THEN 30 WHEN 1 THEN 100 ELSE 0 END AS status, event_id % 5 AS i, CASE event_id % 4 WHEN 0 THEN '7' WHEN 1 THEN 'soon' WHEN 2 THEN '99999' END AS header FROM events)
 SELECT status IN (429, 500, 502, 503, 504) AS retryable, i AS attempt, CASE header WHEN '7' THEN 7.0 WHEN '99999' THEN 60.0 ELSE power(2.0, i) END AS wait, least(0.5 * power(2.0, i), 8.0) AS bound, count(*) AS n FROM e GROUP BY ALL""")
def retry_policy(spark, sf):
    kind = F.col("event_id") % 3
    status = (F.from_json("props", "k long")["k"] + 399 + F.when(kind == 0, 30).when(kind == 1, 100).otherwise(0)).cast("int")
    header = F.when(F.col("event_id") % 4 == 0, "7").when(F.col("event_id") % 4 == 1, "soon").when(F.col("event_id") % 4 == 2, "99999")
    i = F.col("event_id") % 5
    e = table(spark, sf, "events").select(control.is_retryable(status).alias("retryable"), i.alias("attempt"), control.retry_after(header, i).alias("wait"), control.backoff_bound(i).alias("bound"), control.backoff(i, F.col("event_id")).alias("jitter"))
    return e.where("jitter >= 0 and jitter <= bound").groupBy("retryable", "attempt", "wait", "bound").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'permanent' ELSE 'transient' END AS o FROM events),
 s AS (SELECT user_id, min(i) FILTER (o <> 'transient' OR i > 3) AS stop, max(i) AS made, arg_min(o, i) FILTER (o <> 'transient' OR i > 3) AS last FROM n GROUP BY user_id)
 SELECT user_id, CAST(coalesce(stop, made) AS INTEGER) AS attempts, CAST(coalesce(stop, made) - 1 AS INTEGER) AS retries, CASE WHEN stop IS NULL THEN 'PENDING' WHEN last = 'ok' THEN 'OK' WHEN last = 'permanent' THEN 'PERMANENT' ELSE 'RETRIES_SPENT' END AS result FROM s""")
def retry_replay(spark, sf):
    o = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "permanent").otherwise("transient")
    return control.replay_retries(table(spark, sf, "events"), "user_id", ["ts"], o)


@query(f"""WITH n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, CASE WHEN {_K} % 4 = 0 THEN 0 ELSE {_K} % 3 + 1 END AS e FROM events), s AS (SELECT user_id, min(i) FILTER (e = 0) AS good, max(i) AS made, arg_max(e, i) AS e FROM n WHERE i <= 3 GROUP BY user_id)
 SELECT user_id, CAST(coalesce(good, made) - 1 AS INTEGER) AS repairs, CASE WHEN good IS NULL THEN 'INVALID' ELSE 'VALID' END AS result, CAST(CASE WHEN good IS NULL THEN e ELSE 0 END AS INTEGER) AS n_errors FROM s""")
def repair_replay(spark, sf):
    k = F.from_json("props", "k long")["k"]
    errors = F.when(k % 4 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array_repeat(F.lit("wrong"), (k % 3 + 1).cast("int")))
    return control.replay_repairs(table(spark, sf, "events"), "user_id", ["ts"], errors)


@query(f"""SELECT event_type AS tool, CASE WHEN event_type = 'error' THEN 'no tool error' WHEN event_id % 11 = 0 THEN 'wrong arguments: q' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'write refused' WHEN {_K} > 50 THEN 'no answer within 5.0 s; narrow the query' WHEN event_id % 13 = 0 THEN 'ValueError: x' END AS error, count(*) AS n FROM events GROUP BY ALL""")
def tool_observations(spark, sf):
    i = F.col("event_id")
    tools = table(spark, sf, "events").select(F.col("event_type").alias("tool")).distinct().where("tool <> 'error'").select("tool", F.lit(5.0).alias("timeout_s"), (F.col("tool") == "purchase").alias("mutating"))
    calls = table(spark, sf, "events").select(F.col("event_type").alias("tool"), F.when(i % 11 == 0, F.array(F.lit("q"))).otherwise(F.expr("cast(array() as array<string>)")).alias("problems"), (i % 3 != 0).alias("approved"), (F.from_json("props", "k long")["k"] / 10).alias("took_s"), F.when(i % 13 == 0, "ValueError: x").alias("failure"))
    return control.observations(calls, tools).groupBy("tool", "error").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, sha256('Answer from the evidence only.' || chr(10) || chr(10) || '<evidence>' || chr(10) || string_agg('[' || turn || '] (' || role || ') ' || text, chr(10) || chr(10) ORDER BY turn) || chr(10) || '</evidence>' || chr(10) || chr(10) || 'What was said in ' || conv_id || '?') AS prompt_sha256 FROM conversations GROUP BY conv_id""")
def prompts(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").alias("id"), F.col("role").alias("section"), "text"))).alias("chunks"))
    question = F.concat(F.lit("What was said in "), F.col("conv_id").cast("string"), F.lit("?"))
    return c.select("conv_id", F.sha2(control.prompt(question, F.col("chunks"), "Answer from the evidence only."), 256).alias("prompt_sha256"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, list(struct_pack(a := l_shipdate, b := l_partkey, c := l_suppkey, d := l_extendedprice, v := l_quantity, p := CASE WHEN l_suppkey % 4 = 0 THEN -1048576 ELSE l_suppkey % 4 END) ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS xs FROM lineitem GROUP BY ALL),
 k AS (SELECT l_orderkey, l_linenumber, list_reduce(xs, lambda a, x: CASE WHEN x.v <> a.v AND x.p > a.p THEN x ELSE a END) AS x FROM l) SELECT l_orderkey, l_linenumber, x.b AS l_partkey, x.v AS l_quantity FROM k""")
def dedupe_precision(spark, sf):
    d = F.when(F.col("l_suppkey") % 4 != 0, (F.col("l_suppkey") % 4).cast("int"))
    l_ = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", d.alias("decimals"))
    return facts.keep_more_precise(l_, ["l_orderkey", "l_linenumber"], "l_quantity", "decimals", ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT o_custkey, year(o_orderdate) AS year, arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS o_totalprice FROM orders WHERE o_orderpriority < '4' GROUP BY ALL")
def latest_filed(spark, sf):
    o = table(spark, sf, "orders").where("o_orderpriority < '4'").withColumn("year", F.year("o_orderdate"))
    return facts.latest(o, ["o_custkey", "year"], "o_totalprice", "o_orderdate").select("o_custkey", "year", "o_totalprice")


@query("""WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') AS t, trim(regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]+', ' ', 'g')) AS needle, trim(regexp_replace(lower(left(text, 30)), '[^a-z0-9]+', ' ', 'g')) AS own FROM documents)
 SELECT doc_id, needle <> '' AND contains(t, needle) AS has_source, own <> '' AND contains(t, own) AS has_start FROM d""")
def phrases_held(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.holds_phrase(F.concat_ws(" ", "source", "lang"), t).alias("has_source"), X.holds_phrase(F.substring(t, 1, 30), t).alias("has_start"))


@query("""WITH g AS (SELECT c_nationkey AS doc, 'f' || c_custkey % 5 AS field, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS hit, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS base, CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS flip FROM customer),
 p AS (SELECT * FROM g WHERE field <> 'f4'), a AS (SELECT doc, field, count(*) AS n, sum(hit) AS hits, sum(base) AS bases, sum(flip) AS flips, 0 AS level FROM g GROUP BY doc, field UNION ALL SELECT doc, NULL, count(*), sum(hit), sum(base), sum(flip), 1 FROM p GROUP BY doc UNION ALL SELECT NULL, NULL, count(*), sum(hit), sum(base), sum(flip), 2 FROM p)
 SELECT doc, field, n, CAST(hits AS BIGINT) AS hits, CAST(bases AS BIGINT) AS bases, CAST(flips AS BIGINT) AS flips, level, round(hits / n, 4) AS ceiling, round(bases / n, 4) AS floor, round(round(hits / n, 4) - round(bases / n, 4), 4) AS margin FROM a""")
def coverage_fields(spark, sf):
    k = F.col("c_custkey")
    one = lambda m: F.when(k % m == 0, 1).otherwise(0)
    gold = table(spark, sf, "customer").select(F.col("c_nationkey").alias("doc"), F.concat(F.lit("f"), (k % 5).cast("string")).alias("field"), one(3).alias("hit"), one(7).alias("base"), one(11).alias("flip"))
    return truth.field_coverage(gold, ("f4",))


@query("""WITH g AS (SELECT c_nationkey AS doc, c_custkey AS id, abs(c_acctbal) AS v FROM customer WHERE c_acctbal <> 0), n AS (SELECT s_nationkey AS doc, abs(s_acctbal) AS v FROM supplier)
 SELECT doc, avg(CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.doc <> g.doc AND abs(n.v - g.v) <= greatest(0.5, g.v * 0.005)) THEN 1.0 ELSE 0.0 END) AS chance_floor FROM g GROUP BY doc""")
def chance_floors(spark, sf):
    """Suppliers' balances, printed into a text for each nation and read back under both readings, against customers' ones."""
    shown = F.concat(F.lit("("), F.format_number("s_acctbal", 2), F.lit(")"))
    texts = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("doc")).agg(F.array_join(F.collect_list(shown), " ; ").alias("text"))
    held = texts.select("doc", F.explode(N.numbers_of(F.col("text"))).alias("value"))
    gold = table(spark, sf, "customer").select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    return truth.chance_floor(gold, held)


@query("""WITH y AS (SELECT o_custkey AS doc, count(DISTINCT year(o_orderdate)) AS n, count(DISTINCT year(o_orderdate)) FILTER (o_orderstatus = 'F') AS f, count(DISTINCT year(o_orderdate)) FILTER (o_orderstatus = 'O') AS o, count(DISTINCT year(o_orderdate)) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY ALL)
 SELECT doc, t AS table_ord, CASE t WHEN 0 THEN n + f + o + n + 1 WHEN 1 THEN n + p + 1 WHEN 2 THEN 2 * n ELSE n - 1 END AS numeric_cells FROM y, (VALUES (0), (1), (2), (3)) s(t)""")
def cell_counts(spark, sf):
    _, cells, _ = statements(spark, sf)
    return truth.numeric_cells(cells, extraction.TABLE).select("doc", "table_ord", "numeric_cells")


@query("""WITH y AS (SELECT o_custkey AS k, year(o_orderdate) AS y, sum(CAST(round(o_totalprice) AS BIGINT)) AS v FROM orders GROUP BY ALL), h AS (SELECT *, median(v) OVER (PARTITION BY k ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM y)
 SELECT k, y, v > 3 * m AS suspect FROM h WHERE m IS NOT NULL""")
def unit_sanity(spark, sf):
    s = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.sum(F.round("o_totalprice").cast("long")).alias("v"))
    return signals.unit_suspects(s, ["k"], "y", "v", 3).select("k", "y", "suspect")


@query("""WITH y AS (SELECT o_custkey AS k, year(o_orderdate) AS y, sum(CAST(round(o_totalprice) AS BIGINT)) AS v, count(*) AS n FROM orders GROUP BY ALL), c AS (SELECT a.k, a.y, b.v AS before, b.v + CASE WHEN a.n % 2 = 0 THEN 5 ELSE 0 END AS shown FROM y a JOIN y b ON a.k = b.k AND b.y = a.y - 1)
 SELECT k, y, shown - before AS off, shown = before AS continues FROM c""")
def comparative_continuity(spark, sf):
    """Each year's report shows the year before, five more than it was where the year has an even number of orders."""
    s = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.sum(F.round("o_totalprice").cast("long")).alias("v"), F.count(F.lit(1)).alias("n"))
    shown = s.join(s.select("k", (F.col("y") + 1).alias("y"), F.col("v").alias("_b")), ["k", "y"]).select("k", "y", (F.col("_b") + F.when(F.col("n") % 2 == 0, 5).otherwise(0)).alias("comparative"))
    current = s.select("k", "y", F.col("v").alias("current"))
    return signals.comparatives(current, shown, ["k"], "y").select("k", "y", "off", "continues")


@query("SELECT o_custkey, o_orderkey, lag(o_orderpriority) OVER w AS before, o_orderpriority <> lag(o_orderpriority) OVER w AS changed FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) QUALIFY before IS NOT NULL")
def baseline_changes(spark, sf):
    return signals.changed_since(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderpriority").select("o_custkey", "o_orderkey", "before", "changed")


@query(f"""WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, event_type = 'purchase' AS ok, value AS v FROM events), u AS (SELECT user_id, bool_or(ok AND i <= 1) AS p1, bool_or(ok AND i <= 3) AS p3 FROM a GROUP BY user_id)
 SELECT (SELECT round(avg(CAST(p1 AS INTEGER)), 6) FROM u) AS pass_at_1, (SELECT round(avg(CAST(p3 AS INTEGER)), 6) FROM u) AS pass_at_k, (SELECT round(quantile_cont(v, 0.5), 6) FROM a) AS p50, (SELECT round(quantile_cont(v, 0.95), 6) FROM a) AS p95""")
def pass_and_latency(spark, sf):
    e = table(spark, sf, "events")
    return traces.pass_at(e, "user_id", ["ts"], F.col("event_type") == "purchase", 3).crossJoin(F.broadcast(traces.latency(e, F.col("value")))).select(*[F.round(c, 6).alias(c) for c in ("pass_at_1", "pass_at_k", "p50", "p95")])
