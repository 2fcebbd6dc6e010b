"""Language ID: a linear-chain conditional random field that labels the words of a text.

A word's features are its character n-grams between boundaries (so affixes too), hashed, and its place in
a lexicon; transitions between the labels of neighbours are learned on sequences, half of which are
spliced from two languages. Forward-backward gives each word's label probabilities; a text's language
is the one with the largest share over all its words.

Null texts and texts without a letter are `und` with score 0; so are all where no label was learned. The model is
fitted on a bounded sample: SAMPLE documents, dealt evenly over the languages so that one of few documents is
learned too (over the SAMPLE most frequent ones if there are more), RUNS runs of LENGTH words of each (the last one shorter, so short texts teach), SEQUENCES sequences,
words of at most 64 bytes. Everything is scored, whole texts and whole words. Ties between languages go to the first by code
point. Rows that repeat an id are one document in the sample (the least text) and each scored by itself. A text of any
length is scored a part at a time. Other columns pass through whatever their names; an added column whose name
the input has gets underscores in front. training_rows() runs jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import adam, bounded, crc_mod, groups, joined, set_aside, small_batches, with_fields, word_hashes, words

SAMPLE = 600
SEQUENCES = 1500
LENGTH = 32
#: Runs of a document that teach, spread evenly over it.
RUNS = 8
WORD_BYTES = 64
LEXICON = 2000
TABLE_BITS = 15
_ORDERS = (2, 3, 4)
#: Letters, in lower case, and all bytes of non-ASCII characters.
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


@dataclass
class Model:
    labels: list[str]
    grams: np.ndarray  # (orders * 2**TABLE_BITS, labels)
    lexicon: np.ndarray  # sorted hashes
    known: np.ndarray  # (lexicon + 1, labels); the last row is for other words
    step: np.ndarray  # (labels, labels) log transitions


def gram_ids(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every word's n-grams, in the order of words, and where each word's begin. Bytes around
    a word read as 0."""
    sizes = ends - starts + 1
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) + np.repeat(starts - 1 - first, sizes) + 4
    clean = np.zeros(len(buf) + 8, np.uint32)
    clean[4 : 4 + len(buf)] = np.where(LETTER[buf], buf, 0)
    a, b = clean[place], clean[place + 1]
    c = np.where(b == 0, 0, clean[place + 2])
    d = np.where(c == 0, 0, clean[place + 3])
    size = 1 << TABLE_BITS
    with np.errstate(over="ignore"):
        two = a * np.uint32(256) + b
        three = two * np.uint32(256) + c  # 24 bits
        four = three * np.uint32(0x01000193) ^ d * np.uint32(0x85EBCA6B)
        ids = [((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS)).astype(np.int64) + k * size for k, x in enumerate((two, three, four))]
    return np.stack(ids, axis=1), first


def emissions(m: Model, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(words, labels) scores before the chain."""
    if not len(starts):
        return np.zeros((0, len(m.labels)))
    ids, first = gram_ids(buf, starts, ends)
    each = m.grams[ids[:, 0]] + m.grams[ids[:, 1]] + m.grams[ids[:, 2]]
    out = np.add.reduceat(each, first, axis=0)
    return out + m.known[lexicon_ids(m.lexicon, word_hashes(buf, starts, ends))]


def lexicon_ids(lexicon: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = np.searchsorted(lexicon, hashes)
    if not len(lexicon):
        return at
    return np.where(lexicon[np.minimum(at, len(lexicon) - 1)] == hashes, np.minimum(at, len(lexicon) - 1), len(lexicon))


def marginals(scores: np.ndarray, first: np.ndarray, step: np.ndarray, block: int = 128) -> np.ndarray:
    """Label probabilities of each word by forward-backward; `first` marks a text's first word. The
    words form blocks, whose matrix products are taken side by side, then chained."""
    n, k = scores.shape
    if not n:
        return scores
    rows = -(-n // block)
    psi = np.ones((rows * block, k))
    psi[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    start = np.ones(rows * block, bool)
    start[:n] = first
    psi, start = psi.reshape(rows, block, k), start.reshape(rows, block)
    move = np.exp(step - step.max())
    reset = np.full((k, k), 1 / k)

    def at(t: int) -> np.ndarray:
        return np.where(start[:, t, None, None], reset, move) * psi[:, t, None, :]

    product = np.broadcast_to(np.eye(k), (rows, k, k))
    for t in range(block):
        product = product @ at(t)
        product = product / product.max(axis=(1, 2), keepdims=True)
    into, out = np.empty((rows, k)), np.empty((rows, k))
    a, b = np.full(k, 1 / k), np.ones(k)
    for r in range(rows):
        into[r] = a
        a = a @ product[r]
        a = a / a.sum()
        q = rows - 1 - r
        out[q] = b
        b = product[q] @ b
        b = b / b.sum()
    alpha, a = np.empty((rows, block, k)), into
    for t in range(block):
        a = (np.where(start[:, t, None], a.sum(axis=1, keepdims=True) / k, a @ move)) * psi[:, t]
        a = a / a.sum(axis=1, keepdims=True)
        alpha[:, t] = a
    b = out
    for t in range(block - 1, -1, -1):
        alpha[:, t] *= b
        b = b * psi[:, t]
        b = np.where(start[:, t, None], b.sum(axis=1, keepdims=True), b @ move.T)
        b = b / b.sum(axis=1, keepdims=True)
    alpha = alpha.reshape(-1, k)[:n]
    return alpha / alpha.sum(axis=1, keepdims=True)


def _training_sequences(rows: list[tuple[bytes, int]], rng: np.random.Generator):
    """Word ranges of the sample cut into runs of LENGTH words, a last run shorter; labels take turns, and half the
    sequences join the beginnings of two runs. -1 fills up what is shorter than LENGTH."""
    buf, offsets = joined([t for t, _ in rows], lower=False)
    starts, ends = words(buf, LETTER)
    doc = np.searchsorted(offsets, starts, "right") - 1
    label = np.array([y for _, y in rows])
    cut = np.searchsorted(doc, np.arange(len(rows) + 1))
    runs = [np.arange(a, min(a + LENGTH, cut[i + 1])) for i in range(len(rows)) for a in range(cut[i], cut[i + 1], LENGTH)]
    of_label: dict[int, list] = {}
    for i in rng.permutation(len(runs)):
        of_label.setdefault(int(label[doc[runs[i][0]]]), []).append(runs[i])
    turns = [r[k] for k in range(max(map(len, of_label.values()), default=0)) for _, r in sorted(of_label.items()) if k < len(r)]
    runs = turns[:SEQUENCES]
    at = np.full((len(runs), LENGTH), -1)
    for i, r in enumerate(runs):
        if i % 2:
            keep, other = int(rng.integers(1, max(2, min(len(r), LENGTH - 4) + 1))), runs[int(rng.integers(len(runs)))]
            r = np.concatenate([r[:keep], other])[:LENGTH]
        at[i, : len(r)] = r
    return buf, starts, ends, at, np.where(at >= 0, label[doc[at]], 0) if len(starts) else at


def fit(rows: list[tuple[bytes, str]], steps: int = 60, rate: float = 0.08, decay: float = 1e-4) -> Model | None:
    """rows are (lower-cased UTF-8 text, label)."""
    labels = sorted({y for _, y in rows})
    k, size = len(labels), 1 << TABLE_BITS
    if not labels:
        return None
    buf, starts, ends, at, y = _training_sequences([(t, labels.index(l)) for t, l in rows], np.random.default_rng(0))
    if not len(starts):
        return Model(labels, np.zeros((len(_ORDERS) * size, k)), np.zeros(0, np.uint64), np.zeros((1, k)), np.zeros((k, k)))
    real = at >= 0
    used, where = np.unique(np.maximum(at, 0), return_inverse=True)
    where = where.reshape(at.shape)
    weight = 1 / real.sum()
    s, e = starts[used], ends[used]
    hashes = word_hashes(buf, s, e)
    values, times = np.unique(word_hashes(buf, starts, ends), return_counts=True)
    lexicon = np.sort(values[np.argsort(-times, kind="stable")[:LEXICON]])
    ids, begin = gram_ids(buf, s, e)
    owner = np.repeat(np.arange(len(used)), np.diff([*begin, len(ids)]))
    known = lexicon_ids(lexicon, hashes)
    gold = np.zeros((*at.shape, k))
    np.put_along_axis(gold, y[:, :, None], 1, axis=2)
    gold *= real[:, :, None]
    linked = (real[:, :-1] & real[:, 1:])[:, :, None]
    seen = np.einsum("ntk,ntl->kl", gold[:, :-1], gold[:, 1:])

    def gradient(p: dict[str, np.ndarray], _: int) -> dict[str, np.ndarray]:
        each = p["grams"][ids[:, 0]] + p["grams"][ids[:, 1]] + p["grams"][ids[:, 2]]
        scores = (np.add.reduceat(each, begin, axis=0) + p["known"][known])[where]
        move = np.exp(p["step"])
        psi = np.exp(scores - scores.max(axis=2, keepdims=True))
        alpha, beta = np.empty_like(psi), np.ones_like(psi)
        alpha[:, 0] = psi[:, 0] / psi[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, LENGTH):
            a = (alpha[:, t - 1] @ move) * psi[:, t]
            alpha[:, t] = a / a.sum(axis=1, keepdims=True)
        pairs = np.zeros((k, k))
        for t in range(LENGTH - 2, -1, -1):
            after = psi[:, t + 1] * beta[:, t + 1]
            joint = alpha[:, t, :, None] * move * after[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True) * linked[:, t, :, None]).sum(axis=0)
            b = after @ move.T
            # nothing follows the last word of a sequence
            beta[:, t] = np.where(linked[:, t], b / b.sum(axis=1, keepdims=True), 1)
        prob = alpha * beta
        prob /= prob.sum(axis=2, keepdims=True)
        over = (prob * real[:, :, None] - gold) * weight
        by_word = np.stack([np.bincount(where.ravel(), over[..., j].ravel(), len(used)) for j in range(k)], axis=1)
        each = by_word[owner]
        grams = sum(np.stack([np.bincount(ids[:, o], each[:, j], len(p["grams"])) for j in range(k)], axis=1) for o in range(len(_ORDERS)))
        lex = np.stack([np.bincount(known, by_word[:, j], len(lexicon) + 1) for j in range(k)], axis=1)
        return {"grams": grams + decay * p["grams"] / len(_ORDERS), "known": lex + decay * p["known"], "step": (pairs - seen) * weight + decay * p["step"]}

    zero = {"grams": np.zeros((len(_ORDERS) * size, k)), "known": np.zeros((len(lexicon) + 1, k)), "step": np.zeros((k, k))}
    p = adam(gradient, zero, steps, rate)
    return Model(labels, p["grams"], lexicon, p["known"], p["step"])


def word_labels(m: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, text index) of the words of some lower-cased texts."""
    buf, offsets = joined(texts, lower=False)
    starts, ends = words(buf, LETTER)
    doc = np.searchsorted(offsets, starts, "right") - 1
    # n-gram arrays are 60 times as large as the bytes they come from, so long texts go in parts
    parts, at = [], 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 18))))
        lo, hi = int(starts[at]), int(ends[end - 1])
        parts.append(emissions(m, buf[lo:hi], starts[at:end] - lo, ends[at:end] - lo))
        at = end
    scores = np.concatenate(parts) if parts else np.zeros((0, len(m.labels)))
    first = np.diff(doc, prepend=-1) != 0
    return marginals(scores, first, m.step), doc


def predict(m: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    label, score = ["und"] * len(texts), np.zeros(len(texts))
    if m is None:
        return label, score
    low = [(t or "").lower().encode() for t in texts]
    for a, z in groups(low):
        prob, doc = word_labels(m, low[a:z])
        share = np.stack([np.bincount(doc, prob[:, j], z - a) for j in range(len(m.labels))], axis=1)
        best = share.argmax(axis=1)
        total = share.sum(axis=1)
        for i in range(z - a):
            if total[i] > 0 and any(map(str.isalpha, texts[a + i])):
                label[a + i], score[a + i] = m.labels[best[i]], min(1.0, share[i, best[i]] / total[i])
            elif any(map(str.isalpha, texts[a + i] or "")):
                label[a + i], score[a + i] = m.labels[0], 1 / len(m.labels)
    return label, score


def _runs(text: bytes) -> bytes:
    """RUNS runs of LENGTH words of a text, or all its words if it has fewer, a space between words."""
    buf, _ = joined([text], lower=False)
    starts, ends = words(buf, LETTER)
    n = -(-len(starts) // LENGTH)
    chosen = np.arange(n) if n <= RUNS else np.arange(RUNS) * n // RUNS
    return b" ".join(bytes(buf[starts[i] : min(ends[i], starts[i] + WORD_BYTES)]) for r in chosen for i in range(r * LENGTH, min(len(starts), (r + 1) * LENGTH)))


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[bytes, str]]:
    """Runs of words and lang of a bounded sample of the documents that may be learned from, cut on the executors.
    Of each language come those with the smallest hashes among a share that leaves some to spare: no task ranks more
    than a few times the sample, whatever a language's share of the corpus."""
    small_batches(docs.sparkSession)
    open_ = docs.where("lang is not null and doc_id is not null and text is not null").where(crc_mod(F.col("doc_id"), 4) != 2)
    counts = open_.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    each = max(1, sample // max(1, counts.count()))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    few = open_.select("doc_id", "lang", place.alias("place")).join(F.broadcast(counts.orderBy(F.desc("n"), "lang").limit(sample)), "lang").where(F.col("place") * F.col("n") < 4 * each + 40)
    few = few.groupBy("lang", "doc_id").agg(F.min("place").alias("place"))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))).where(F.col("rank") <= each)
    chosen = open_.join(F.broadcast(ranked.select("doc_id", "lang").limit(sample)), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [_runs(t.lower().encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), b.column("lang"), pa.array(cut, pa.binary())], names=["doc", "lang", "runs"])

    got = chosen.mapInArrow(run, "doc string, lang string, runs binary").toArrow().sort_by([("doc", "ascending"), ("lang", "ascending")])
    return list(zip(got.column("runs").to_pylist(), got.column("lang").to_pylist(), strict=True))


def identify(docs: DataFrame, m: Model | None, text: str = "text") -> DataFrame:
    """docs with _lang and _score in place of the text."""
    small_batches(docs.sparkSession)
    docs, give_back = set_aside(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, score = predict(sent.value, b.column(text).to_pylist())
            keep = [(n, c) for n, c in zip(b.schema.names, b.columns, strict=True) if n != text]
            yield pa.RecordBatch.from_arrays([*(c for _, c in keep), pa.array(label, pa.string()), pa.array(score, pa.float64())], names=[*(n for n, _ in keep), "_lang", "_score"])

    schema = with_fields(docs, "_lang string, _score double", (text,))
    return give_back(docs.mapInArrow(run, schema), ("_lang", "_score"), (text,))


def language_report(docs: DataFrame) -> DataFrame:
    m = fit(training_rows(docs.select("doc_id", "text", "lang")))
    out = identify(docs.select("doc_id", "text"), m)
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
