"""Secret scans by patterns and by sliding-window entropy, with DataFrame functions only.

Each text is handled inside its own row: no shuffle, no Python, nothing to skew. Null and empty
texts have no spans; repeated rows are scanned alike. Ties: spans that start together stand in the order of KINDS.
A text's work grows with its length, and its length is bounded by an executor's memory only. Other columns pass
through whatever their names; the added one gets underscores in front where the input has its name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import set_aside

#: Fixed patterns. `letters` of the key names match in either case.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
HEX_PART = r"[0-9a-fA-F]{20,}"
#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_b64")
BASE = 3
WINDOW = 20
#: Bits at which a window counts as random, for each class of characters.
BITS = {"hex": 3.0, "b64": 3.9}
SYMBOLS = {"hex": "0123456789abcdefABCDEF", "b64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"}
#: Candidates that match one of these are no secrets.
ALLOWED = (
    r"^[0-9+/_=-]*$",
    r"^[A-Za-z+/_=-]*$",
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|xxxx",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^(?:[a-z]+[/_-])+[a-z]*[0-9]*$",
)
_UNIT = 1_000_000
#: Entries that are folded one by one; blocks of them are joined afterwards.
BLOCK = 256


def _value(expr: Column, use) -> Column:
    """use(expr) with expr computed once, not again at each place that names it."""
    return F.element_at(F.transform(F.array(expr), use), 1)


def _blocks(items: Column) -> Column:
    """An array cut into arrays of BLOCK entries, one at least."""
    return _value(items, lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK))))


def _running(values: Column, first: Column, join) -> Column:
    """For each of values what join() has made of `first` and those before it."""
    start = F.struct(first.alias("now"), F.slice(F.array(first), 1, F.lit(0)).alias("seen"))
    return F.aggregate(values, start, lambda acc, x: F.struct(join(acc["now"], x).alias("now"), F.concat(acc["seen"], F.array(acc["now"])).alias("seen")), lambda acc: acc["seen"])


def _found(text: Column, pattern: str, keep=None) -> Column:
    """Array of (start, end, word) of the leftmost non-overlapping matches, in code points. Places are summed
    within blocks of pieces and then over the blocks, so the work grows with the text, not with its square."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("word"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,word:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["word"]), F.lit(0))
        hit = F.array(F.struct(start.alias("start"), end.alias("end"), x["word"].alias("word")))
        ok = x["word"].isNotNull() if keep is None else x["word"].isNotNull() & keep(x["word"])
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc["hits"], hit)).otherwise(acc["hits"]).alias("hits"))

    done = F.transform(_blocks(pieces), lambda part: F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("hits")), step))

    def moved(parts: Column) -> Column:
        begins = _running(F.transform(parts, lambda p: p["at"]), F.lit(0), lambda a, b: a + b)
        shift = lambda p, at: F.transform(p["hits"], lambda h: F.struct((h["start"] + at).alias("start"), (h["end"] + at).alias("end"), h["word"].alias("word")))
        return F.flatten(F.zip_with(parts, begins, shift))

    return F.when(text.rlike(pattern), _value(done, moved)).otherwise(none)


def _windows(word: Column, kind: str) -> Column:
    """(lo, hi): from the start of the first window of `word` whose Shannon entropy reaches the
    class's bits to the end of the last one, nulls if none does. The counts of the window's
    symbols change by the one that enters and the one that leaves; c·log2(c) is in millionths,
    so sums are exact."""
    clogc = F.array(*[F.lit(round(c * math.log2(c) * _UNIT) if c else 0) for c in range(WINDOW + 2)])
    # entropy = log2(W) - sum/W, so it reaches the bits where the sum is at most this
    most = math.floor((math.log2(WINDOW) - BITS[kind]) * WINDOW * _UNIT)
    n = len(SYMBOLS[kind])
    start = F.struct(F.array_repeat(F.lit(0), n).alias("counts"), F.lit(0).cast("long").alias("total"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))

    def fold(codes: Column) -> Column:
        moves = F.transform(codes, lambda c, i: F.struct(c.alias("came"), F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(-1)).alias("went"), i.alias("i")))

        def step(acc: Column, m: Column) -> Column:
            same = m["came"] == m["went"]
            up = F.get(acc["counts"], m["came"])
            down = F.when(m["went"] >= 0, F.get(acc["counts"], m["went"]))
            value = lambda c: F.get(clogc, c.cast("int")).cast("long")
            change = value(up + 1) - value(up) + F.when(m["went"] >= 0, value(down - 1) - value(down)).otherwise(F.lit(0).cast("long"))
            total = F.when(same, acc["total"]).otherwise(acc["total"] + change)
            put = lambda counts, at, c: F.concat(F.slice(counts, 1, at), F.array(c), F.slice(counts, at + 2, F.lit(n)))
            entered = put(acc["counts"], m["came"], up + 1)
            left = put(entered, F.greatest(m["went"], F.lit(0)), down - 1)
            counts = F.when(same, acc["counts"]).when(m["went"] >= 0, left).otherwise(entered)
            full = (m["i"] >= WINDOW - 1) & (total <= most)
            return F.struct(
                counts.alias("counts"),
                total.alias("total"),
                F.when(full, F.coalesce(acc["lo"], m["i"] - (WINDOW - 1))).otherwise(acc["lo"]).alias("lo"),
                F.when(full, m["i"] + 1).otherwise(acc["hi"]).alias("hi"),
            )

        return F.aggregate(moves, start, step, lambda acc: F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))

    codes = F.transform(F.split(word, ""), lambda c: F.position(c, F.lit(SYMBOLS[kind])) - 1)
    return _value(codes, fold)


def _random(text: Column) -> Column:
    """Array of (start, end, kind) of the random-looking parts of candidate strings: of each as a whole, and
    of the maximal stretches of hex in those that have other characters too."""
    secret = lambda w: ~w.rlike("|".join(f"(?:{p})" for p in ALLOWED))
    tokens = _found(text, TOKEN, secret)
    hexed = lambda t: t["word"].rlike("^[0-9a-fA-F]+$")
    scored = F.transform(
        tokens,
        lambda t: F.struct(t["start"].alias("start"), F.when(hexed(t), F.lit(3)).otherwise(F.lit(4)).alias("kind"), F.when(hexed(t), _windows(t["word"], "hex")).otherwise(_windows(t["word"], "b64")).alias("w")),
    )
    moved = lambda t: F.transform(_found(t["word"], HEX_PART, secret), lambda h: F.struct((t["start"] + h["start"]).alias("start"), F.lit(3).alias("kind"), _windows(h["word"], "hex").alias("w")))
    inside = F.flatten(F.transform(F.filter(tokens, lambda t: ~hexed(t) & t["word"].rlike(HEX_PART)), moved))
    good = F.filter(F.concat(scored, inside), lambda t: t["w"]["lo"].isNotNull())
    return F.transform(good, lambda t: F.struct((t["start"] + t["w"]["lo"]).alias("start"), t["kind"].alias("kind"), (t["start"] + t["w"]["hi"]).alias("end")))


def _outside(spans: Column) -> Column:
    """Sorted spans without those of entropy that lie within one of a pattern. The largest end of a pattern's
    span so far decides, which is carried over blocks as in _found."""
    top = lambda part: F.coalesce(F.array_max(F.transform(part, lambda s: F.when(s["kind"] < BASE, s["end"]))), F.lit(-1))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")

    def step(acc: Column, s: Column) -> Column:
        base = s["kind"] < BASE
        kept = F.when(base | (acc["top"] < s["end"]), F.concat(acc["kept"], F.array(s))).otherwise(acc["kept"])
        return F.struct(F.when(base, F.greatest(acc["top"], s["end"])).otherwise(acc["top"]).alias("top"), kept.alias("kept"))

    def sifted(parts: Column) -> Column:
        before = _running(F.transform(parts, top), F.lit(-1), F.greatest)
        return F.flatten(F.zip_with(parts, before, lambda p, t: F.aggregate(p, F.struct(t.alias("top"), none.alias("kept")), step, lambda acc: acc["kept"])))

    return _value(_blocks(spans), sifted)


def scan_secrets(docs: DataFrame, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """Adds `out`: an array of (start, kind, end), ordered; kind is a place in KINDS. Patterns give
    kinds below BASE; entropy adds others, outside of those."""
    inner, give_back = set_aside(docs, text)
    body = F.coalesce(F.col(text), F.lit(""))
    as_kind = lambda hits, k: F.transform(hits, lambda h: F.struct(h["start"].alias("start"), F.lit(k).alias("kind"), h["end"].alias("end")))
    assign = _found(body, ASSIGN, lambda w: F.length(F.regexp_extract(w, ASSIGN, 2)) >= 12)
    spans = F.concat(as_kind(assign, 0), as_kind(_found(body, ACCESS), 1), as_kind(_found(body, HEX), 2), _random(body))
    return give_back(inner.withColumn(out, _outside(F.array_sort(spans))), (out,))


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the pattern kinds, digest of their spans, all spans."""
    found = scan_secrets(docs.select("doc_id", "text")).drop("text")
    of = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    base = spans_text(F.filter("secret_spans", lambda s: s["kind"] < BASE))
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"),
        spans_text(F.col("secret_spans")).alias("spans"),
    )
