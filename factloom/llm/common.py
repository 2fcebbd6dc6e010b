"""Shared pieces of the training-data operators: tables, scratch space, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.sources.stage import staged, table, unstage  # noqa: F401  the operators take them from here

#: ASCII white space, the only separators of words in most contracts.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch; bounds a Python worker's memory when texts are long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's Arrow batch size to `rows`, so a batch of long texts stays bounded. It stays so: the
    setting is read when the frame runs, which is after the operator has returned it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def set_aside(docs: DataFrame, *own: str):
    """(frame, give_back) for an operator that works on the columns `own`: the frame has these, and all others of
    docs in one struct, so that no name of theirs meets a name of the operator's. give_back(out, added) puts them
    back in their order, then the columns `added`; one whose name docs has already gets underscores in front."""
    own = [c for c in dict.fromkeys(own) if c in docs.columns]
    others = [c for c in docs.columns if c not in own]
    inner = docs.select(*(F.col(f"`{c}`") for c in own), *([F.struct(*(F.col(f"`{c}`") for c in others)).alias(_ASIDE)] if others else []))

    def give_back(out: DataFrame, added: tuple = (), gone: tuple = ()) -> DataFrame:
        taken = {c.lower() for c in docs.columns}
        place = lambda c: F.col(f"`{c}`") if c in own else F.col(f"{_ASIDE}.`{c}`")
        new = []
        for c in added:
            name = c
            while name.lower() in taken:
                name = f"_{name}"
            taken.add(name.lower())
            new.append(F.col(c).alias(name))
        return out.select(*(place(c).alias(c) for c in docs.columns if c not in gone), *new)

    return inner, give_back


_ASIDE = "_factloom_others"
#: Keys that hold over a ten-thousandth of all rows, and over HOT_ROWS, are hot: there are fewer than HOT_KEYS.
HOT_KEYS, HOT_ROWS = 10_000, 1000


def hot_keys(counts: DataFrame, key: str, total: int) -> DataFrame:
    """The hot keys of counts (key, n), n rows of `total`: fewer than HOT_KEYS rows, so small enough to broadcast."""
    return counts.where(F.col("n") > max(HOT_ROWS, total / HOT_KEYS)).select(key)


def join_split(many: DataFrame, one: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """`many` joined with `one`, which has one row a key: rows of a hot key stay where they are and meet that key's
    row by broadcast, all others are dealt out by key. No key's rows gather in one task."""
    h = F.broadcast(hot)
    stay = many.join(h, key, "left_semi").join(F.broadcast(one.join(h, key, "left_semi")), key, how)
    return many.join(h, key, "left_anti").join(one.join(h, key, "left_anti"), key, how).unionByName(stay)


def with_fields(df: DataFrame, ddl: str, without: tuple = ()) -> T.StructType:
    """df's schema without some columns and with those of `ddl`."""
    return T.StructType([*(f for f in df.schema if f.name not in without), *T.StructType.fromDDL(ddl)])


#: Rows of one written file where the number of all rows is known to be small.
FILE_ROWS = 50_000


def few_files(df: DataFrame, at_most: int) -> DataFrame:
    """df, of no more than `at_most` narrow rows, in as many partitions as these rows need: a table of few rows
    is not written as one small file for each shuffle partition. Never more partitions than df has."""
    return df.coalesce(1 + at_most // FILE_ROWS)


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def bounded(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows of df, the same on every run: those with the smallest hashes of key."""
    return df.orderBy(F.xxhash64(F.lit("sample"), key), key).limit(rows)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of a text column; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def groups(items: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of items of about `size` bytes together; a longer item is alone."""
    at, total = 0, 0
    for i, x in enumerate(items):
        if i > at and total + len(x) > size:
            yield at, i
            at, total = i, 0
        total += len(x)
    if at < len(items):
        yield at, len(items)


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def joined(items: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the items, a line feed after each, and the offset at which each begins."""
    buf = b"\n".join([*items, b""])
    sizes = np.fromiter(map(len, items), np.int64, len(items)) + 1
    return np.frombuffer(buf.lower() if lower else buf, np.uint8), np.cumsum(sizes) - sizes


#: Bytes that make up a word: digits, lower-case letters and all bytes of non-ASCII characters.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def words(buf: np.ndarray, is_word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes."""
    edge = np.diff(is_word[buf].view(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word, all words at once."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    powers = np.multiply.accumulate(np.full(int(sizes.max()), _FACTOR, np.uint64))
    with np.errstate(over="ignore"):
        terms = (buf[place + np.repeat(starts, sizes)].astype(np.uint64) + np.uint64(1)) * powers[place]
        h = np.add.reduceat(terms, first)
        h = (h ^ (h >> np.uint64(32))) * _FACTOR
    return h ^ (h >> np.uint64(29))


def prefix_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: range) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size the places of the words that are longer and a hash of their first bytes."""
    out, part = [], np.zeros(len(starts), np.uint64)
    at, with_more = np.arange(len(starts)), ends - starts
    power = _FACTOR
    with np.errstate(over="ignore"):
        for k in range(sizes.stop - 1):
            more = with_more[at] > k
            at, part = at[more], part[more]
            part = part + (buf[starts[at] + k].astype(np.uint64) + np.uint64(1)) * power
            power = power * _FACTOR
            if k + 1 in sizes:
                longer = with_more[at] > k + 1
                h = (part[longer] + np.uint64(k + 1)) * _FACTOR
                out.append((at[longer], h ^ (h >> np.uint64(31))))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def adam(grad, params: dict[str, np.ndarray], steps: int, rate: float) -> dict[str, np.ndarray]:
    """Minimises by Adam; grad(params, step) gives a gradient for each parameter."""
    m = {k: np.zeros_like(v) for k, v in params.items()}
    s = {k: np.zeros_like(v) for k, v in params.items()}
    for t in range(1, steps + 1):
        for k, g in grad(params, t).items():
            m[k] += 0.1 * (g - m[k])
            s[k] += 0.01 * (g * g - s[k])
            step = (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)
            params[k] = params[k] - rate * step
    return params
