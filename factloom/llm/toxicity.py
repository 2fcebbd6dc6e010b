"""Toxicity by a factorization machine over hashed terms.

A text's features are which of the model's terms (words and beginnings of words) it has. Besides a weight, each term
has RANK factors; the factors' products are the weights of pairs of terms, so a pair can count for more, or less, than
its two terms together. Terms are chosen for what they tell alone, at most TERMS whose presence goes with the label
beyond chance (MIN_G), and for what they tell in pairs: among the CANDIDATES terms that split the sample most evenly,
those of the pairs whose joint presence goes with the label beyond what both tell alone (MIN_PAIR_G). The sample of
labelled documents is bounded (SAMPLE); all texts are scored as a whole.

Null and empty texts have no terms and get the score of the bias; so do all texts where no label
can be learned from. A document with several labels counts as toxic if one of them says so. Rows that repeat an id
are one document in the sample (the least text) and each scored by itself; ties between terms go to the smaller hash.
Texts of any length are scored in one go, terms by terms of the model. Other columns pass through whatever their
names; an added column whose name the input has gets underscores in front. training_set() runs jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import adam, bounded, crc_mod, groups, joined, prefix_hashes, set_aside, sigmoid, small_batches, staged, texts, with_fields, word_hashes, words

SAMPLE = 6000
#: Bytes of the beginnings of words that are terms too.
PREFIXES = range(3, 9)
TERMS = 1024
RANK = 6
MIN_DOCS = 3
#: Log-likelihood ratio (G squared) from which a term's presence goes with the label beyond chance.
MIN_G = 25.0
#: The same for a pair, over what its terms tell alone; of two million pairs chance takes none this far.
MIN_PAIR_G = 60.0
CANDIDATES = 2048
PAIRS = 256


@dataclass
class Machine:
    terms: np.ndarray  # sorted hashes
    bias: float
    weight: np.ndarray
    factor: np.ndarray  # (terms, rank)


def term_sets(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, term hash) of the words of some texts and of their beginnings, repeats included:
    inflected and compound words share a beginning."""
    buf, offsets = joined([t.decode().lower().encode() for t in items], lower=False)
    starts, ends = words(buf)
    doc = np.searchsorted(offsets, starts, "right") - 1
    parts = prefix_hashes(buf, starts, ends, PREFIXES)
    return np.concatenate([doc, *(doc[at] for at, _ in parts)]), np.concatenate([word_hashes(buf, starts, ends), *(h for _, h in parts)])


def raw_scores(m: Machine, x: np.ndarray) -> np.ndarray:
    """For rows of 0/1 over the terms: bias + linear + pairwise part."""
    s = x @ m.factor
    return m.bias + x @ m.weight + 0.5 * ((s * s).sum(axis=1) - x @ (m.factor**2).sum(axis=1))


def likelihood_gain(seen: np.ndarray, bad: np.ndarray, prior: np.ndarray | float) -> np.ndarray:
    """G squared of `bad` toxic ones among `seen` against the share `prior`."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.nan_to_num(bad * np.log(bad / (seen * prior))) + np.nan_to_num((seen - bad) * np.log((seen - bad) / (seen * (1 - prior)))))


def telling_pairs(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Columns of x (0/1) in the pairs that tell most beyond what each tells alone: the four cells of presence against
    the additive log odds of their margins."""
    n, y = len(x), toxic.astype(np.float32)
    prior = float(np.clip(y.mean(), 1e-9, 1 - 1e-9))
    seen, bad = x.sum(axis=0, dtype=np.float64), (x.T @ y).astype(np.float64)
    gain = np.zeros((x.shape[1],) * 2)
    odds = lambda b, s: np.log((b + 0.5) / (s - b + 0.5)) - np.log(prior / (1 - prior))
    has, lacks = odds(bad, seen), odds(y.sum() - bad, n - seen)
    both_seen, both_bad = (x.T @ x).astype(np.float64), (x.T @ (x * y[:, None])).astype(np.float64)
    for one in (1, 0):
        for two in (1, 0):
            s = both_seen if one and two else seen[:, None] - both_seen if one else seen[None] - both_seen if two else n - seen[:, None] - seen[None] + both_seen
            b = both_bad if one and two else bad[:, None] - both_bad if one else bad[None] - both_bad if two else y.sum() - bad[:, None] - bad[None] + both_bad
            expect = sigmoid(np.log(prior / (1 - prior)) + (has if one else lacks)[:, None] + (has if two else lacks)[None])
            gain += likelihood_gain(s, b, expect)
    # terms that nearly always stand together are one term, not a pair
    apart = np.minimum(seen[:, None], seen[None]) - both_seen
    gain[(both_seen < MIN_DOCS) | (apart < MIN_DOCS)] = 0
    gain = np.triu(gain, 1)
    best = np.argsort(-gain, axis=None, kind="stable")[:PAIRS]
    best = best[gain.ravel()[best] >= MIN_PAIR_G]
    return np.unique(np.concatenate(np.unravel_index(best, gain.shape)))


def fit(docs: list[np.ndarray], toxic: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 2e-5) -> Machine:
    """docs are arrays of the distinct term hashes of each document."""
    n = len(docs)
    prior = (toxic.sum() + 0.5) / (n + 1.0) if n else 0.5
    bias = float(np.log(prior / (1 - prior))) if n else 0.0
    none = Machine(np.zeros(0, np.uint64), min(bias, -1e-6), np.zeros(0), np.zeros((0, RANK)))
    if not n or toxic.all() or not toxic.any():
        return none
    owner = np.repeat(np.arange(n), [len(d) for d in docs])
    values, code = np.unique(np.concatenate(docs), return_inverse=True)
    seen = np.bincount(code, minlength=len(values))
    g = likelihood_gain(seen, np.bincount(code, toxic[owner], len(values)), prior)
    g[seen < MIN_DOCS] = 0
    alone = np.argsort(-g, kind="stable")[:TERMS]
    alone = alone[g[alone] >= MIN_G]

    def presence(terms: np.ndarray) -> np.ndarray:
        at = np.full(len(values), -1)
        at[terms] = np.arange(len(terms))
        out = np.zeros((n, len(terms)), np.float32)
        out[owner[at[code] >= 0], at[code][at[code] >= 0]] = 1
        return out

    even = np.where(seen >= MIN_DOCS, np.minimum(seen, n - seen), 0)
    many = np.argsort(-even, kind="stable")[:CANDIDATES]
    many = np.sort(many[even[many] >= MIN_DOCS])
    paired = many[telling_pairs(presence(many), toxic)] if len(many) else many
    best = np.union1d(alone, paired).astype(np.int64)
    if not len(best):
        return none
    x = presence(best)
    y = toxic.astype(np.float32)

    def gradient(p: dict[str, np.ndarray], _: int) -> dict[str, np.ndarray]:
        v = p["factor"]
        s = x @ v
        out = sigmoid(p["bias"][0] + x @ p["weight"] + 0.5 * ((s * s).sum(axis=1) - x @ (v * v).sum(axis=1))).astype(np.float32) - y
        out /= n
        linear = x.T @ out
        pairs = x.T @ (out[:, None] * s) - v * linear[:, None]
        return {"bias": np.array([out.sum()]), "weight": linear + decay * p["weight"], "factor": pairs + 4 * decay * v}

    start = {"bias": np.array([bias]), "weight": np.zeros(len(best), np.float32), "factor": np.random.default_rng(0).normal(0, 0.01, (len(best), RANK)).astype(np.float32)}
    p = adam(gradient, start, steps, rate)
    return Machine(values[best], float(p["bias"][0]), p["weight"].astype(float), p["factor"].astype(float))


def scores(m: Machine, items: list[bytes]) -> np.ndarray:
    out = np.full(len(items), m.bias)
    if len(m.terms):
        for a, z in groups(items):
            doc, h = term_sets(items[a:z])
            at = np.minimum(np.searchsorted(m.terms, h), len(m.terms) - 1)
            hit = m.terms[at] == h
            pair = np.unique(doc[hit] * len(m.terms) + at[hit])
            doc, at = pair // len(m.terms), pair % len(m.terms)
            total = np.zeros(z - a)  # bincount of nothing gives integers
            total += np.bincount(doc, m.weight[at], z - a)
            for f in range(RANK):
                total += 0.5 * (np.bincount(doc, m.factor[at, f], z - a) ** 2 - np.bincount(doc, m.factor[at, f] ** 2, z - a))
            out[a:z] += total
    return sigmoid(out)


def training_set(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray]:
    """Term hashes and labels of a bounded sample of the documents that may be learned from. Terms are hashed and
    counted on the executors; only those that can be chosen come to the driver, however long the texts."""
    small_batches(docs.sparkSession)
    open_ = labels.where("toxic in (0, 1) and doc_id is not null").where(crc_mod(F.col("doc_id"), 5) != 0)
    known = bounded(open_.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "doc_id", sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [np.unique(term_sets([t])[1]).view(np.int64) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), b.column("toxic"), pa.array(terms, pa.list_(pa.int64()))], names=["doc", "toxic", "terms"])

    made = staged(rows.mapInArrow(hashed, "doc string, toxic int, terms array<long>"))
    n, bad = made.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    per = made.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("seen"), F.sum("toxic").alias("bad")).where(F.col("seen") >= MIN_DOCS)
    share = lambda part, of: F.when(part > 0, part * F.log(part / of)).otherwise(0.0)
    p = (bad + 0.5) / (n + 1.0)
    gain = 2 * (share(F.col("bad"), F.col("seen") * p) + share(F.col("seen") - F.col("bad"), F.col("seen") * (1 - p)))
    even = F.least(F.col("seen"), n - F.col("seen"))
    kept = per.where(gain >= MIN_G).orderBy(gain.desc(), "term").limit(2 * TERMS).select("term").union(per.orderBy(even.desc(), "term").limit(CANDIDATES).select("term"))
    chosen = np.unique(np.array(kept.toArrow().column("term"), np.int64))
    sent = docs.sparkSession.sparkContext.broadcast(chosen)

    def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [x.values.to_numpy(zero_copy_only=False) if x.values is not None else np.zeros(0, np.int64) for x in b.column("terms")]
            terms = [x[np.isin(x, sent.value)] for x in keep]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("toxic"), pa.array(terms, pa.list_(pa.int64()))], names=["doc", "toxic", "terms"])

    got = made.mapInArrow(sifted, made.schema).toArrow().sort_by("doc")
    return [np.sort(np.array(t.values if t.values is not None else [], np.int64).view(np.uint64)) for t in got.column("terms")], np.array(got.column("toxic"), np.int64) == 1


def score_toxicity(docs: DataFrame, m: Machine, text: str = "text") -> DataFrame:
    """docs with _toxic, a score from 0 to 1, in place of the text."""
    small_batches(docs.sparkSession)
    docs, give_back = set_aside(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [(n, c) for n, c in zip(b.schema.names, b.columns, strict=True) if n != text]
            yield pa.RecordBatch.from_arrays([*(c for _, c in keep), pa.array(scores(sent.value, texts(b, text)), pa.float64())], names=[*(n for n, _ in keep), "_toxic"])

    return give_back(docs.mapInArrow(run, with_fields(docs, "_toxic double", (text,))), ("_toxic",), (text,))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    m = fit(*training_set(docs, labels))
    out = score_toxicity(docs.select("doc_id", "text"), m)
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("_toxic").alias("score"), (F.col("_toxic") >= 0.5).cast("int").alias("predicted"))
