"""Quality classifier by co-training on two views of a document.

View one is the text's content: shares of its bytes and of hashed pairs of neighbouring bytes. View two is
the metadata that comes with it: language, source, size. A classifier for each view is fitted on labelled
documents; in each round both score every unlabelled document of the corpus, and of all that a view is sure of it
hands the other a sample to learn from. Calibrated on labelled documents that neither learned from, the views' log
odds add up, less the prior that both contain; every document gets the combined score.

What is fitted is bounded: LABELLED documents with labels and, a round and view, TAKEN of those it is sure of. Null
texts count as empty, null metadata as a value of its own. Without labels of both kinds every document gets the score
1 if the labels say so, or if there are none. Rows that repeat an id are one document in the samples (the least text)
and each scored by itself; samples are those with the smallest hashes of the id, so ties can't change them. A score of
exactly 0.5 counts as good. Texts of any length are read a part at a time. Other columns pass through whatever
their names; an added column whose name the input has gets underscores in front. train() runs jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import adam, bounded, crc_mod, set_aside, sigmoid, small_batches, staged, texts, with_fields

LABELLED = 4000
ROUNDS = 3
#: Documents that a view hands the other in a round, of both labels together, and the log odds from which it is sure.
TAKEN = 400
SURE = 2.0
PAIRS = 512
META = 64
_CHUNK = 1 << 20


@dataclass
class View:
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight + self.bias

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


@dataclass
class Model:
    content: View
    meta: View
    prior: float

    def scores(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.content.logit(content), self.meta.logit(meta)
        return sigmoid(a + b - self.prior), sigmoid(a), sigmoid(b)


def content_features(text: bytes) -> np.ndarray:
    """Square roots of the shares of the 256 byte values and of PAIRS hashed pairs of bytes."""
    one, two = np.zeros(256, np.int64), np.zeros(PAIRS, np.int64)
    for at in range(0, len(text), _CHUNK):
        b = np.frombuffer(text, np.uint8, min(_CHUNK + 1, len(text) - at), at)
        one += np.bincount(b[:_CHUNK], minlength=256)
        pair = (b[:-1].astype(np.uint32) * np.uint32(256) + b[1:]) * np.uint32(0x9E3779B1)
        two += np.bincount((pair >> np.uint32(23)).astype(np.int64), minlength=PAIRS)
    return np.sqrt(np.concatenate([one, two]) / max(1, len(text))).astype(np.float32)


def meta_features(lang: str | None, source: str | None, size: int | None) -> np.ndarray:
    import zlib

    x = np.zeros(2 * META + 2, np.float32)
    x[zlib.crc32(f"lang {lang}".encode()) % META] = 1
    x[META + zlib.crc32(f"source {source}".encode()) % META] = 1
    x[-2] = np.log1p(max(0, size or 0)) / 10
    x[-1] = size is None
    return x


def fit_view(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150, decay: float = 1e-3) -> View:
    """Logistic regression."""
    share = weight / weight.sum()

    def gradient(p: dict[str, np.ndarray], _: int) -> dict[str, np.ndarray]:
        over = ((sigmoid(x @ p["w"] + p["b"][0]) - y) * share).astype(np.float32)
        return {"w": x.T @ over + decay * p["w"], "b": np.array([over.sum()])}

    p = adam(gradient, {"w": np.zeros(x.shape[1], np.float32), "b": np.zeros(1)}, steps, 0.2)
    return View(p["w"], float(p["b"][0]))


def calibrated(v: View, x: np.ndarray, y: np.ndarray) -> View:
    """Slope and shift of the log odds by Platt's method, with his smoothed targets."""
    raw, good = v.raw(x), y.sum()
    aim = np.where(y, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = sigmoid(a * raw + b)
        g, w = p - aim, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(h, [(g * raw).sum() + 1e-3 * (a - 1), g.sum()])
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -2, 2)
    return View(v.weight, v.bias, max(0.0, float(a)), float(b))


def cotrain(content: np.ndarray, meta: np.ndarray, y: np.ndarray, calibrate: np.ndarray, pool, rounds: int = ROUNDS) -> Model:
    """Fits on rows labelled 1 or 0, `calibrate` marks those kept from fitting. pool(views, shares) gives (view, label,
    content, meta) for new documents that `view` is sure of, at most shares[label] for each label."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    views = {"content": content, "meta": meta}
    learn = {k: ([x[~calibrate]], [y[~calibrate]], [np.ones((~calibrate).sum())]) for k, x in views.items()}
    both = calibrate.any() and 0 < y[calibrate].sum() < calibrate.sum()
    set_right = lambda f: {k: calibrated(v, views[k][calibrate], y[calibrate]) for k, v in f.items()} if both else f
    shares = {1: max(1, round(TAKEN * prior)), 0: max(1, round(TAKEN * (1 - prior)))}
    for r in range(rounds + 1):
        fitted = set_right({k: fit_view(*map(np.concatenate, rows)) for k, rows in learn.items()})
        if r < rounds:
            for k, label, *new in pool(fitted, shares):
                other = "meta" if k == "content" else "content"
                x = new[0] if other == "content" else new[1]
                for part, add in zip(learn[other], (x, np.full(len(x), label), np.full(len(x), 0.5)), strict=True):
                    part.append(add)
    return Model(fitted["content"], fitted["meta"], float(np.log(prior / (1 - prior))))


def _features(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    body = texts(b, "text")
    content = np.stack([content_features(t) for t in body]) if body else np.zeros((0, 256 + PAIRS), np.float32)
    meta = [meta_features(*x) for x in zip(*(b.column(c).to_pylist() for c in ("_lang", "_source", "_size")), strict=True)]
    return content, np.stack(meta) if meta else np.zeros((0, 2 * META + 2), np.float32)


def _views(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_lang": F.col("lang").cast("string"), "_source": F.col("source").cast("string"), "_size": F.col("n_chars").cast("long")})


def _gathered(docs: DataFrame, chosen: DataFrame) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(doc and the columns of `chosen`, content, meta) of the documents whose id is in the bounded frame `chosen`;
    features are computed on the executors. An id that repeats gives one row, that of the least text."""
    more = [f for f in chosen.schema if f.name != "doc_id"]
    least = F.min(F.struct("text", "lang", "source", "n_chars")).alias("least")
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *(f.name for f in more)).agg(least)
    rows = _views(rows.select("doc_id", *(f.name for f in more), "least.*")).drop("lang", "source", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [pa.array([row.tobytes() for row in part], pa.binary()) for part in _features(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), *(b.column(f.name) for f in more), *x], names=["doc", *(f.name for f in more), "content", "meta"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in more)
    got = rows.mapInArrow(run, f"doc string, {kinds}content binary, meta binary").toArrow()
    got = got.sort_by([(n, "ascending") for n in ["doc", *(f.name for f in more)]])
    back = lambda c, n: np.frombuffer(b"".join(got.column(c).to_pylist()), np.float32).reshape(-1, n)
    return got, back("content", 256 + PAIRS), back("meta", 2 * META + 2)


def corpus_pool(docs: DataFrame, known: DataFrame):
    """A pool for cotrain: all documents without a label. Each call scores them all; of those a view is sure of the
    ones with the smallest hashes are handed over, each once."""
    spent = [docs.select("doc_id").limit(0)]

    def pool(views: dict[str, View], shares: dict[int, int]):
        sent = docs.sparkSession.sparkContext.broadcast(views)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                logits = [sent.value[k].logit(x) for k, x in zip(("content", "meta"), _features(b), strict=True)]
                cols = [pa.array(np.where(p > SURE, 1, np.where(p < -SURE, 0, -1)), pa.int32()) for p in logits]
                out = pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "content", "meta"])
                yield out.filter(pa.array((np.abs(logits[0]) > SURE) | (np.abs(logits[1]) > SURE), pa.bool_()))

        kind = docs.schema["doc_id"].dataType.simpleString()
        narrow = _views(docs.where("doc_id is not null")).drop("lang", "source", "n_chars")
        sure = narrow.mapInArrow(run, f"doc_id {kind}, content int, meta int").join(known, "doc_id", "left_anti").join(F.broadcast(spent[0]), "doc_id", "left_anti")
        sure = staged(sure.groupBy("doc_id").agg(F.max("content").alias("content"), F.max("meta").alias("meta")))
        picks = [bounded(sure.where(F.col(k) == label), "doc_id", n).select("doc_id", F.lit(k).alias("view"), F.lit(label).alias("label")) for k in ("content", "meta") for label, n in shares.items()]
        chosen = staged(picks[0].union(picks[1]).union(picks[2]).union(picks[3]))
        spent[0] = spent[0].union(chosen.select("doc_id"))
        got, content, meta = _gathered(docs, chosen)
        for k in ("content", "meta"):
            for label in shares:
                at = np.array([v == k and y == label for v, y in zip(got.column("view").to_pylist(), got.column("label").to_pylist(), strict=True)], bool)
                if at.any():
                    yield k, label, content[at], meta[at]

    return pool


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model | None:
    """Learns from labelled documents whose crc32 modulo 4 is not 3 and calibrates on the others, within the bound."""
    small_batches(docs.sparkSession)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("_y"))
    got, content, meta = _gathered(plain, bounded(known, "doc_id", labelled).withColumn("_cal", crc_mod(F.col("doc_id"), 4) == 3))
    y = np.array(got.column("_y"), np.int64)
    if not (y == 1).any() or not (y == 0).any():
        return None if not (y == 0).any() else Model(View(np.zeros(256 + PAIRS), -10.0), View(np.zeros(2 * META + 2), 0.0), 0.0)
    cal = np.array(got.column("_cal").to_pylist(), bool)
    for label in (0, 1):  # too few to set some apart
        if not ((y == label) & ~cal).any() or not ((y == label) & cal).any():
            cal[:] = False
    return cotrain(content, meta, y, cal, corpus_pool(plain, known.select("doc_id")))


def score_quality(docs: DataFrame, m: Model | None) -> DataFrame:
    """docs with _quality, _content and _meta: the combined score and those of the views."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(m)
    docs, give_back = set_aside(docs, "text", "lang", "source", "n_chars")
    inner = ("_lang", "_source", "_size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = (np.ones(b.num_rows),) * 3 if sent.value is None else sent.value.scores(*_features(b))
            keep = [(n, c) for n, c in zip(b.schema.names, b.columns, strict=True) if n not in inner]
            yield pa.RecordBatch.from_arrays([*(c for _, c in keep), *(pa.array(np.asarray(x, float), pa.float64()) for x in out)], names=[*(n for n, _ in keep), "_quality", "_content", "_meta"])

    views = _views(docs)
    out = views.mapInArrow(run, with_fields(views, "_quality double, _content double, _meta double", inner))
    return give_back(out, ("_quality", "_content", "_meta"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    out = score_quality(plain, train(plain, labels)).drop("text")
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 3, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("_quality").alias("score"), F.col("_content").alias("content_score"), F.col("_meta").alias("meta_score"), (F.col("_quality") >= 0.5).cast("int").alias("predicted"))
