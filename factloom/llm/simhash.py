"""SimHash near-dedup by the generalised pigeonhole principle.

A text's fingerprint is the bitwise majority of its shingles' hashes. Fingerprints that differ in at
most `most` bits are linked. The 64 bits are grouped by correlation into partitions; partition i gets
a threshold t_i >= -1 with sum(t_i + 1) = most + 1, so a linked pair is within t_i in some
partition (-1: the partition is not looked at). A dynamic programme allots the thresholds by
estimated work: rows probed plus candidate pairs, from histograms over all distinct fingerprints. A
fingerprint probes, for each partition, its bits with every choice of t_i of them masked; those that
share a probe are candidates and are verified.

Equal fingerprints are one before any link is sought. A probe shared by more than BUCKET distinct
fingerprints makes no pairs: each of these then probes itself and its 64 neighbours at one bit, and
two that share a neighbour differ in at most 2 bits, so a star there loses no link, whatever the
size of the group. (This exact way is for most = 2; most < 2 keeps it with a check of the distance.)

Null texts count as empty; texts without words have fingerprint zero, linked like any other. Rows that
repeat an id share whatever component the id's least fingerprint group gives: each row keeps its own
fingerprint's component. Null ids are in a component but never name it, unless all its ids are null. Very long
texts are hashed a part at a time. Ties at half of the shingles leave the bit 0. Columns other than id and text are
not read by the report and pass through one_of_each, whatever their names. Jobs run when the functions are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import NOT_SPACE, few_files, hot_keys, join_split, set_aside, small_batches, staged, texts, word_hashes, words
from factloom.llm.components import connected_components

SEED = 42
#: Words of a shingle of a fingerprint.
WIDTH = 3
MOST = 2
BUCKET = 64
BINS = 4096
PARTS = (2, 3, 4)
_CHUNK = 100_000
#: Bands of min-wise hashes and hashes of a band: a pair of similarity 0.8 shares no band once in 21,000,000 pairs.
BANDS, ROWS = 32, 4
#: Standard deviations beyond the expected distance of a linked pair at which the sieve drops a candidate: by the
#: binomial distribution one of similarity 0.8 is dropped once in 11,000,000.
SIEVE = 6.0
#: Best-connected members of a bucket with which all others are compared first.
CENTRES = 2
#: Bins of the table that tells rare shingles from common ones.
ORDER_BINS = 1 << 20
#: Shared shingles just before one that are looked at, so that a pair is not made once more for each.
LAST = 16
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, *range(9, 14)]] = False


def fingerprint(text: bytes, width: int) -> int:
    """bytes.lower() and bytes.split() know ASCII only, as the definition of words does."""
    import xxhash

    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - width + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        end = min(n, at + _CHUNK)
        parts = [w[at + k : end + k] for k in range(min(width, len(w)))]
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*parts, strict=True)), "<u8", end - at)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, fp) for each row; fp holds the 64 bits as a long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array([fingerprint(t, width) for t in texts(b)], pa.int64())], names=["doc", "fp"])

    narrow = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc {narrow.schema['doc'].dataType.simpleString()}, fp long")


def _summed(fps: DataFrame, sums) -> np.ndarray:
    """sums(array of fingerprints) gives a fixed number of integers; these, added up over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            part = sums(b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.int64())], names=["i", "n"])

    rows = fps.select("fp").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max([r["i"] for r in rows], default=-1) + 1, np.int64)
    out[[r["i"] for r in rows]] = [r["n"] for r in rows]
    return out


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlation(fps: DataFrame) -> np.ndarray:
    """Absolute correlations of the 64 bits over all fingerprints."""

    def sums(fp: np.ndarray) -> np.ndarray:
        x = _bits(fp).astype(np.float64)
        return np.concatenate([[len(fp)], np.rint(x.T @ x).astype(np.int64).ravel()])

    found = _summed(fps, sums)
    if not len(found):
        return np.eye(64)
    both = found[1:].reshape(64, 64) / found[0]
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both - np.outer(p, p)) / np.outer(spread, spread))


def partitions(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Groups of bits, each grown from a strongly correlated one by those nearest to the group."""
    left, out = set(range(64)), []
    for k in range(parts):
        room = len(left) // (parts - k)
        group = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.remove(group[0])
        while len(group) < room:
            group.append(max(sorted(left), key=lambda b: corr[b, group].sum()))
            left.remove(group[-1])
        out.append(sorted(group))
    return out


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def allocate(cost: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i of least summed cost[i][t_i] with sum(t_i + 1) = total."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (sofar, ts) in best.items():
            for t, x in c.items():
                if used + t + 1 <= total and (used + t + 1 not in after or sofar + x < after[used + t + 1][0]):
                    after[used + t + 1] = (sofar + x, [*ts, t])
        best = after
    return best[total]


def plan(fps: DataFrame, most: int = MOST) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe. The estimate of candidate pairs is that of evenly
    spread values plus what the histogram's bins hold beyond their even share."""
    corr = correlation(fps)
    layouts = [partitions(corr, m) for m in PARTS]
    masks = np.array([_mask(p) for lay in layouts for p in lay], np.uint64)

    def sums(fp: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            bins = [((fp & m) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52) for m in masks]
        return np.concatenate([np.bincount(b.astype(np.int64), minlength=BINS) for b in bins])

    found = _summed(fps, sums)
    counts = iter(found.reshape(len(masks), BINS)) if len(found) else iter(np.zeros((len(masks), BINS), np.int64))
    options = []
    for lay in layouts:
        cost = []
        for p in lay:
            c = next(counts)
            n = int(c.sum())
            over = float((np.maximum(c - n / BINS - 3 * np.sqrt(n / BINS), 0) ** 2).sum() / 2)
            cost.append({-1: 0.0} | {t: comb(len(p), t) * (n + n * n / 2 / 2 ** (len(p) - t) + over) for t in range(most + 1)})
        total, ts = allocate(cost, most + 1)
        options.append((total, [(p, t) for p, t in zip(lay, ts, strict=True) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _probes(masks: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])


def near_edges(distinct: DataFrame, most: int = MOST, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of `distinct.fp` within `most` <= 2 bits."""
    masks = [_mask(set(bits) - set(gone)) for bits, t in plan(distinct, most) for gone in combinations(bits, t)]
    probes = distinct.select("fp", F.inline(_probes(masks)))
    shared = probes.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = probes.join(shared, ["kind", "key"]).select("fp", F.struct("kind", "key").alias("at"), "n")
    met = staged(few_files(met, distinct.count() * len(masks)))
    few = met.where(F.col("n") <= bucket).groupBy("at").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    close = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= most
    pairs = F.flatten(
        F.transform(
            "fps",
            lambda x, i: F.transform(F.filter("fps", lambda y, j: (j > i) & close(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b"))),
        )
    )
    small = few.select(F.inline(pairs))
    # at most 65 distinct fingerprints share a neighbour, however many share a probe
    hot = met.where(F.col("n") > bucket).select("fp").distinct()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)])
    stars = hot.select("fp", F.explode(near).alias("mid")).groupBy("mid").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where("size(fps) > 1")
    if most == 2:
        large = stars.select(F.inline(F.transform(F.slice("fps", 2, 65), lambda y: F.struct(F.element_at("fps", 1).alias("a"), y.alias("b")))))
    else:
        large = stars.select(F.inline(pairs))
    return small.union(large)


def near_duplicates(docs: DataFrame, width: int = WIDTH, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, fp, component) for each row of docs."""
    fps = staged(fingerprints(docs, width, id_col, text_col))
    rows = fps.count()
    classes = staged(few_files(fps.groupBy("fp").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")), rows))
    roots = connected_components(near_edges(classes, most))
    linked = staged(few_files(roots.join(classes, F.col("node") == F.col("fp")).select("node", "root", "least"), rows))
    named = linked.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("n"))
    linked = join_split(linked, named.drop("n"), "root", hot_keys(named, "root", linked.count())).select("node", "component")
    all_classes = classes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "least").alias("component"))
    return join_split(fps, staged(few_files(all_classes, rows)), "fp", hot_keys(classes, "fp", rows)).select("doc", "fp", "component")


def print_edges(prints: DataFrame) -> DataFrame:
    """Edges (a, b) for prints (key binary, fp), each pair once, whose components are those that near_duplicates finds
    for the keys in the place of documents. A fingerprint is a node of its own between its keys."""
    node = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    classes = staged(few_files(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), prints.count()))
    near = staged(near_edges(classes))
    met = classes.where("n > 1").select("fp").union(near.select("a")).union(near.select("b")).distinct()
    return near.select(node("a").alias("a"), node("b").alias("b")).union(prints.join(met, "fp", "left_semi").select("key", node("fp")))


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs.select("doc_id", "text"))
    return out.select(F.col("doc").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles, taken a part of the text at a time."""
    low = np.frombuffer(text.lower(), np.uint8)
    starts, ends = words(low, NOT_BLANK)
    if not len(starts):
        return np.zeros(0, np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(low), 1 << 18))
    w = np.concatenate([word_hashes(low, starts[a:z], ends[a:z]) for a, z in zip(cuts, [*cuts[1:], len(starts)], strict=True)])
    n = max(1, len(w) - width + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(w))):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + w[k : k + n]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(31)))


_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least of each of BANDS * ROWS hashes over a text's shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            np.minimum(least, (shingles[None, at : at + 4096] * _FACTORS).min(axis=1), out=least)
    return least


def _sketch(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the bands, as longs; a bit of each min-wise hash, as two longs."""
    least = min_hashes(shingles)
    band = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = (least ^ (least >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        for column in mixed.reshape(BANDS, ROWS).T:
            band = (band ^ (band >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + column
    bits = np.zeros(128, np.uint8)
    bits[: len(mixed)] = mixed >> np.uint64(63)
    return band.view(np.int64), np.packbits(bits).view(np.int64)


def sketches(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, row, fp, key, n, bands, b0, b1) for each row: hash of the text, fingerprint, digest of its set of
    shingles, size of that, sketch."""
    small_batches(docs.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = texts(b)
            sets = [shingle_set(t, width) for t in whole]
            made = [_sketch(x) for x in sets]
            cols = {
                "doc": b.column("doc"),
                "row": b.column("row"),
                "fp": pa.array([fingerprint(t, WIDTH) for t in whole], pa.int64()),
                "key": pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
                "n": pa.array(map(len, sets), pa.int64()),
                "bands": pa.array([m for m, _ in made], pa.list_(pa.int64())),
                "b0": pa.array([int(f[0]) for _, f in made], pa.int64()),
                "b1": pa.array([int(f[1]) for _, f in made], pa.int64()),
            }
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    narrow = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row"))
    return narrow.mapInArrow(run, f"doc {narrow.schema['doc'].dataType.simpleString()}, row long, fp long, key binary, n long, bands array<long>, b0 long, b1 long")


def _homes(asked: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text): a text of each class whose key is in `asked`. A row that repeats id and text repeats here."""
    homes = classes.join(asked, "key", "left_semi").select("key", F.col("first.doc").alias("home"), F.col("first.row").alias("home_row"))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row"))
    return staged(rows.join(homes, F.col("doc").eqNullSafe(F.col("home")) & (F.col("row") == F.col("home_row"))).select("key", "text"))


def _verified(pairs: DataFrame, held: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of pairs (a, b) of classes whose texts, from `held`, are similar."""
    side = lambda name: held.select(F.col("key").alias(name), F.col("text").alias(f"text_{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, left = None, None
        for b in batches:
            keep = []
            for key, x, y in zip(b.column("a").to_pylist(), texts(b, "text_a"), texts(b, "text_b"), strict=True):
                if key != seen:
                    seen, left = key, shingle_set(x, width)
                right = shingle_set(y, width)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(both >= similarity * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def shingle_counts(held: DataFrame, width: int) -> np.ndarray:
    """How many texts of `held` have a shingle of each of ORDER_BINS bins: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER_BINS, np.int64)
        for b in batches:
            for t in texts(b):
                np.add.at(total, shingle_set(t, width) % np.uint64(ORDER_BINS), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["i", "n"])

    found = held.select("text").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ORDER_BINS, np.int64)
    out[found.column("i").to_numpy()] = found.column("n").to_numpy()
    return out


def rare_prefixes(held: DataFrame, counts: np.ndarray, width: int, similarity: float) -> DataFrame:
    """(key, h, place): the rarest shingles of each text, so many that two similar texts share one. Any
    order of the shingles that all texts keep is right; the rarest first gives the fewest meetings."""
    shared = held.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = []
            for t in texts(b):
                x = shingle_set(t, width)
                rarest = np.lexsort((x, shared.value[x % np.uint64(ORDER_BINS)]))
                sets.append(x[rarest[: len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1]])
            sizes = [len(x) for x in sets]
            cols = {
                "key": b.column("key").take(pa.array(np.repeat(np.arange(len(sets)), sizes), pa.int64())),
                "h": pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64), pa.int64()),
                "place": pa.array(np.concatenate([*map(np.arange, sizes), np.zeros(0, np.int64)]), pa.int64()),
            }
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return held.mapInArrow(run, "key binary, h long, place long")


def similar_edges(known: DataFrame, classes: DataFrame, docs: DataFrame, width: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Edges (a, b) whose components are, for the keys of classes, those of the edges `known` and of all similar
    pairs that share a band. In each bucket all members are compared with its CENTRES. Members of buckets that
    are then still of several components meet over their rarest shingles instead, of which similar texts share one, so a
    passage that many texts have brings none of them together; pairs of two components are compared,
    but for those of two members of their buckets' largest ones."""
    far = BANDS * ROWS * (1 - similarity) / 2
    far += SIEVE * (far * (1 + similarity) / 2) ** 0.5
    met = classes.where("n > 0").select("key", "n", "b0", "b1", F.explode("bands").alias("at"))
    shared = met.groupBy("at").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = staged(met.join(shared, "at"))
    weight = met.groupBy("key").agg(F.sum("size").alias("weight"))
    near = lambda x, y: (F.least(x["n"], y["n"]) >= F.greatest(x["n"], y["n"]) * similarity) & (F.bit_count(x["b0"].bitwiseXOR(y["b0"])) + F.bit_count(x["b1"].bitwiseXOR(y["b1"])) <= far)
    ordered = [F.least(F.col("x.key"), F.col("y.key")).alias("a"), F.greatest(F.col("x.key"), F.col("y.key")).alias("b")]

    ranked = met.join(weight, "key")
    best = F.max(F.struct("weight", "key", "n", "b0", "b1"))
    centre = ranked.groupBy("at").agg(best.alias("x"))
    centres = centre
    for _ in range(CENTRES - 1):
        others = ranked.join(centres.select("at", F.col("x.key").alias("key")), ["at", "key"], "left_anti")
        centres = centres.union(others.groupBy("at").agg(best.alias("x")))
    members = met.select("at", F.struct("key", "n", "b0", "b1").alias("y"))
    first = staged(centres.join(members, "at").where((F.col("x.key") != F.col("y.key")) & near(F.col("x"), F.col("y"))).select(*ordered).distinct())
    asked = first.select(F.col("a").alias("key")).union(first.select("b")).distinct()
    linked = staged(_verified(first, _homes(asked, classes, docs, id_col, text_col), width, similarity).union(known))

    roots = connected_components(linked).distinct()
    now = staged(members.join(roots, F.col("y.key") == F.col("node"), "left").select("at", "y", F.coalesce("root", "y.key").alias("part")))
    parts = now.groupBy("at", "part").agg(F.count(F.lit(1)).alias("in_part"))
    open_ = parts.groupBy("at").agg(F.max(F.struct("in_part", "part"))["part"].alias("main"), F.count(F.lit(1)).alias("n_parts")).where("n_parts > 1").select("at", "main")
    still = staged(now.join(open_, "at").groupBy("y", "part").agg(F.max(F.col("part") != F.col("main")).alias("stray")).select("y.key", "y", "part", "stray"))
    held = _homes(still, classes, docs, id_col, text_col)
    rare = staged(rare_prefixes(held, shingle_counts(held, width), width, similarity).distinct().join(still, "key").drop("key"))
    across = rare.groupBy("h").agg(F.max("stray").alias("any_stray"), F.min("part").alias("p"), F.max("part").alias("q")).where("any_stray and p < q").select("h")
    # a text's shingles before a shared one count only if another component has them; all after it may count
    in_order = Window.partitionBy("y.key").orderBy("place")
    before, last = F.row_number().over(in_order) - 1, F.collect_list("h").over(in_order.rowsBetween(-LAST, -1))
    told = staged(rare.join(across, "h").withColumns({"before": before, "last": last, "after": F.col("y.n") - F.col("place")}))
    x = told.where("stray").select("h", F.col("y").alias("x"), F.col("part").alias("of"), *(F.col(c).alias(f"x_{c}") for c in ("before", "last", "after")))
    y = told.select("h", "y", "part", "stray", "before", "last", "after")
    enough = F.least("x_before", "before") + F.least("x_after", "after") >= (F.col("x.n") + F.col("y.n")) * (similarity / (1 + similarity)) - 1e-9
    # the first shingle that a pair shares always brings it; one shortly after another shared one need not
    first_met = ~F.arrays_overlap("x_last", "last")
    rest = x.join(y, "h").where((F.col("of") != F.col("part")) & (~F.col("stray") | (F.col("x.key") < F.col("y.key"))) & enough & near(F.col("x"), F.col("y")) & first_met)
    second = staged(rest.select(*ordered).distinct().join(first, ["a", "b"], "left_anti"))
    stars = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return stars.union(_verified(second, held, width, similarity))


def _components(docs: DataFrame, width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(doc, row, component) for each row of docs; row is the hash of its text. Fingerprints link as they do in
    near_duplicates, each different set of shingles in the place of a document; similar texts are sought beyond that."""
    made = staged(sketches(docs, width, id_col, text_col))
    known = print_edges(staged(made.select("key", "fp").distinct()))
    one = F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "row"))
    classes = staged(made.groupBy("key").agg(one.alias("first"), *(F.first(c).alias(c) for c in ("n", "bands", "b0", "b1"))))
    roots = connected_components(similar_edges(known, classes, docs, width, similarity, id_col, text_col)).distinct()
    linked = classes.select("key", F.col("first.doc").alias("least")).join(roots, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    named = linked.groupBy("root").agg(F.min("least").alias("component"))
    found = linked.join(named, "root").select(F.col("key").alias("_key"), "component")
    return made.select("doc", "row", "key").join(found, F.col("key") == F.col("_key")).select("doc", "row", "component")


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, component) for each row of docs: component is the least id among the texts that a chain of
    linked fingerprints (those of near_duplicates) and of similar texts reaches. Texts with the same set
    of shingles are one before any similar one is sought; texts without words are alike."""
    return _components(docs, width, similarity, id_col, text_col).select("doc", "component")


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without those that are not their component's least doc_id. Rows that repeat an id are decided
    by their own texts; of those that would stay one does, as they are one document: the least text,
    one with words if any has some. Rows without an id all stay. Other columns pass through whatever their names."""
    inner, give_back = set_aside(docs, "doc_id", "text")
    inner = inner.withColumn("_text_hash", F.xxhash64("text"))
    named = _components(docs, width, similarity, "doc_id", "text")
    kept = named.where("doc = component").groupBy("doc", "row").agg(F.count(F.lit(1)).alias("_n"))
    times = kept.groupBy("doc").agg(F.sum("_n").alias("_times")).withColumnRenamed("doc", "_id")
    reps = kept.join(times, F.col("doc") == F.col("_id")).select(F.col("doc").alias("_rep"), F.col("row").alias("_row"), "_times")
    met = inner.join(reps, (F.col("doc_id") == F.col("_rep")) & (F.col("_text_hash") == F.col("_row")))
    single = met.where("_times = 1").select(*inner.columns)
    no_words = ~F.coalesce(F.col("text").rlike(NOT_SPACE), F.lit(False))
    rest = [c for c in inner.columns if c != "doc_id"]
    order = F.struct(no_words.alias("none"), "text", F.to_json(F.struct(*rest)))
    repeated = met.where("_times > 1").groupBy("doc_id").agg(F.min_by(F.struct(*rest), order).alias("_least"))
    again = repeated.select(*[F.col(c) if c == "doc_id" else F.col(f"_least.{c}") for c in inner.columns])
    return give_back(single.unionByName(again).unionByName(inner.where("doc_id is null")))
