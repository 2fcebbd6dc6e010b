"""Chunking with overlap and packing under a token budget: folds over ordered rows."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import overlap_share, token_set

# Fixed pattern: where a text breaks into sentences.
_BREAK = re.compile(r"(?<=[.!?])\s+|\n{2,}")


def n_tokens(text: str) -> int:
    return max(1, (len(text) + 3) // 4)


def _offsets(parts: list[str]) -> list[int]:
    """Where each part begins when all are joined by a space, and where one more would."""
    return [0, *accumulate(len(p) + 1 for p in parts)]


def pieces(text: str, most: int) -> list[str]:
    """Sentences; the words of one longer than a chunk, as many together as reach its size."""
    out: list[str] = []
    for sentence in (x.strip() for x in _BREAK.split(text)):
        if not sentence:
            continue
        if n_tokens(sentence) <= most:
            out.append(sentence)
            continue
        words = sentence.split()
        at, begins = 0, _offsets(words)
        while at < len(words):
            # the first end at which the joined words have the characters of `most` tokens
            end = min(len(words), max(at + 1, bisect_left(begins, begins[at] + 4 * most - 2)))
            out.append(" ".join(words[at:end]))
            at = end
    return out


def chunk_ranges(sizes: list[int], tokens: list[int], most: int, overlap: float) -> list[tuple[int, int]]:
    """Ranges of parts, given their characters and tokens, that make the chunks: each as long as fits in `most` tokens. The
    next one begins with the last parts of the one before: one at least, more until they have overlap * most tokens,
    never over half of most, and only as many as leave room for the part that did not fit."""
    begins = [0, *accumulate(n + 1 for n in sizes)]
    sums = [0, *accumulate(tokens)]
    fits = lambda a, z: (begins[z] - begins[a] - 1 + 3) // 4 <= most
    out, start = [], 0
    for end in range(1, len(sizes) + 1):
        if end < len(sizes) and fits(start, end + 1):
            continue
        out.append((start, end))
        if end < len(sizes):
            by_cap = bisect_left(sums, sums[end] - most // 2)
            by_share = min(end - 1, bisect_right(sums, sums[end] - int(most * overlap)) - 1)
            start = max(start, by_cap, by_share)
            while start < end and not fits(start, end + 1):
                start += 1
    return out


def chunk(text: str, most: int, overlap: float) -> list[str]:
    """Chunks of whole sentences of at most `most` tokens; each repeats the last sentences of the one before."""
    parts = pieces(text, most)
    return [" ".join(parts[a:z]) for a, z in chunk_ranges([*map(len, parts)], [*map(n_tokens, parts)], most, overlap)]


def chunk_documents(docs: DataFrame, id_col: str, text: str, most: int = 60, overlap: float = 0.2) -> DataFrame:
    """(id, chunk, text, tokens); the fold has no built-in form, so batches of texts go through Arrow."""

    @F.pandas_udf("array<string>")
    def cut(t: pd.Series) -> pd.Series:
        return t.map(lambda x: chunk(x or "", most, overlap))

    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(cut(F.col(text))).alias("chunk", "text"))
    return rows.withColumn("tokens", F.greatest(F.lit(1), ((F.length("text") + 3) / 4).cast("int")))


def pack(chunks: DataFrame, key: str, order: list[Column], budget: int, threshold: float = 0.8) -> DataFrame:
    """Greedy packing per key of (key, id, text, tokens): in order, a chunk is taken if it fits what is left
    and is not like one already taken; one that does not fit is skipped, not the end. The first
    goes first, the second last. Candidates are the few that a retrieval stage ranked."""
    w = Window.partitionBy(key).orderBy(*order)
    numbered = chunks.withColumn("_n", F.row_number().over(w))
    words = token_set(F.col("text"))
    lists = numbered.select(key, F.struct("_n", "id", "tokens", words.alias("words")).alias("c")).groupBy(key).agg(F.sort_array(F.collect_list("c")).alias("cs"))
    empty = F.expr("cast(array() as array<struct<_n:int,id:bigint,tokens:int,words:array<string>>>)")

    def step(acc: Column, c: Column) -> Column:
        alike = F.exists(acc["taken"], lambda t: overlap_share(t["words"], c["words"]) >= threshold)
        ok = (acc["used"] + c["tokens"] <= budget) & ~alike
        item = F.struct(c["_n"].alias("_n"), c["id"].cast("bigint").alias("id"), c["tokens"].alias("tokens"), c["words"].alias("words"))
        return F.struct(F.when(ok, acc["used"] + c["tokens"]).otherwise(acc["used"]).alias("used"), F.when(ok, F.concat(acc["taken"], F.array(item))).otherwise(acc["taken"]).alias("taken"))

    packed = lists.select(key, F.aggregate("cs", F.struct(F.lit(0).alias("used"), empty.alias("taken")), step).alias("p"))
    rows = packed.select(key, F.col("p.used").alias("used"), F.size("p.taken").alias("n"), F.posexplode("p.taken").alias("i", "t"))
    place = F.when(F.col("i") == 0, 0).when(F.col("i") == 1, F.col("n") - 1).otherwise(F.col("i") - 1)
    return rows.select(key, F.col("t.id").alias("id"), F.col("t.tokens").alias("tokens"), "used", place.alias("place"))
