"""Benchmark decontamination: one Aho-Corasick automaton over all windows of the test items.

A text is normalised (A-Z lower-cased, words of digits, letters and non-ASCII characters) and scanned once; what is
found is mapped back to words and to code points of the original. The automaton's symbols are words, each coded
by two characters, so a window takes 16 nodes whatever its length: about 100 MB for 1 MB of items (measured).
Each row is handled alone: no shuffle. A benchmark of more than BLOCK_BYTES goes in blocks: one broadcast and one
pass over the texts each, with one automaton alive at a time, built once in a worker process.

Null and empty texts have no words and no hits; items without words match nothing; items that
repeat each count by their id, null ids not at all. Rows that repeat are marked alike; items with a window in common
all occur where it does. A text of any length is scanned in one go, inside a worker's memory. Other columns pass
through whatever their names; an added column whose name the input has gets underscores in front. Reading the
benchmark runs a job.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import set_aside, small_batches, staged, texts, with_fields

WINDOW = 8
BLOCK_BYTES = 1 << 20
#: A-Z in lower case; ASCII that is neither digit nor letter as a space; the rest as it is.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: The same words in a text as it is, capitals included.
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: First and second character of a word's code come from two ranges; this is the code of all other words.
_HIGH, _LOW, _OTHER = 0x100, 0x10000, "\0"
_FOUND = "struct<items:array<string>,ranges:array<struct<first:int,last:int>>>"


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def blocks(items: Iterator[tuple[str, str]], most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    block, size = [], 0
    for item, text in items:
        data = text.encode()
        if block and size + len(data) > most:
            yield block
            block, size = [], 0
        block.append((item, data))
        size += len(data)
    if block:
        yield block


class Scanner:
    """The automaton of a block of items (id, text) and the codes of its words."""

    def __init__(self, block: list[tuple[str, bytes]]):
        import ahocorasick

        items = [(item, normal_words(text)) for item, text in block]
        known = sorted({w for _, ws in items for w in ws})
        side = int(len(known) ** 0.5) + 1
        self.code = {w: chr(_HIGH + k // side) + chr(_LOW + k % side) for k, w in enumerate(known)}
        owners: dict[str, list] = {}
        for item, ws in items:
            for at in range(max(1, len(ws) - WINDOW + 1) if ws else 0):
                window = ws[at : at + WINDOW]
                found = owners.setdefault("".join([self.code[w] for w in window]), [len(window), []])
                if not found[1] or found[1][-1] != item:
                    found[1].append(item)
        self.found = ahocorasick.Automaton()
        for key, value in owners.items():
            self.found.add_word(key, value)
        if owners:
            self.found.make_automaton()
        self.any = bool(owners)

    def scan(self, text: bytes) -> tuple[set[str], list[tuple[int, int]], int]:
        """Items of which a window occurs, merged ranges (first, last) of hit words, number of words."""
        ws = normal_words(text)
        if not ws or not self.any:
            return set(), [], len(ws)
        codes = [self.code.get(w, _OTHER) for w in ws]
        items, ranges = set(), []
        line = "".join(codes)
        hits = list(self.found.iter(line))
        if not hits:
            return items, ranges, len(ws)
        # a word of the items has two characters, any other one: the word that ends at a place
        at, place = {}, -1
        for k, c in enumerate(codes):
            place += len(c)
            at[place] = k
        for end, (n, names) in hits:
            items.update(names)
            ranges.append((at[end] - n + 1, at[end]))
        return items, merged(ranges), len(ws)


_BUILT: dict[str, Scanner] = {}


def _built(name: str, block) -> Scanner:
    """The block's scanner, kept by the worker process for its next tasks until another is asked for."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Scanner(block.value)
    return _BUILT[name]


def _pass(name: str, block, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _built(name, block)
        kind = pa.struct([("items", pa.list_(pa.string())), ("ranges", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])
        for b in batches:
            found, sizes = [], []
            for t, before in zip(texts(b, text), b.column("_found"), strict=True):
                items, ranges, n = scanner.scan(t)
                old = before.as_py()
                if old:
                    items |= set(old["items"])
                    ranges = merged([*ranges, *((r["first"], r["last"]) for r in old["ranges"])])
                found.append({"items": sorted(items), "ranges": [{"first": a, "last": z} for a, z in ranges]} if items else None)
                sizes.append(n)
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            cols |= {"_found": pa.array(found, kind), "_n_words": pa.array(sizes, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def original_spans(text: str, hit: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points [start, end) of the runs of hit words, given as (first, last) ranges of words."""
    places = [m.span() for m in WORDS.finditer(text)]
    return [(places[a][0], places[z][1]) for a, z in merged(hit)]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(z, out[-1][1])
        else:
            out.append([a, z])
    return [tuple(x) for x in out]


def _close(text: str):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits, items, spans = [], [], []
            for body, found in zip(b.column(text), b.column("_found"), strict=True):
                f = found.as_py() or {"items": [], "ranges": []}
                ranges = [(x["first"], x["last"]) for x in f["ranges"]]
                hits.append(sum(z - a + 1 for a, z in ranges))
                items.append(f["items"])
                spans.append([{"start": a, "end": z} for a, z in original_spans(body.as_py(), ranges)] if ranges else [])
            cols = {k: c for k, c in zip(b.schema.names, b.columns, strict=True) if k != "_found"}
            cols |= {"_n_hit": pa.array(hits, pa.int64()), "_items": pa.array(items, pa.list_(pa.string())), "_hit_spans": pa.array(spans, span)}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", min_items: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with _n_words, _n_hit, _items (ids in the order of strings), _hit_spans (code points of
    the original) and _contaminated (min_items items or more occur)."""
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text").distinct().toLocalIterator()
    inner, give_back = set_aside(docs, text)
    out = inner.withColumn("_found", F.lit(None).cast(_FOUND)).withColumn("_n_words", F.lit(0).cast("long"))
    n = 0
    for block in blocks(((r["item"], r["text"]) for r in items), block_bytes):
        # the driver holds one block; what a pass has found is written, so that automata don't stand side by side
        out = staged(out) if n else out
        out = out.mapInArrow(_pass(uuid.uuid4().hex, sc.broadcast(block), text), out.schema)
        n += 1
    if not n:
        out = out.mapInArrow(_pass(uuid.uuid4().hex, sc.broadcast([]), text), out.schema)
    schema = with_fields(out, "_n_hit long, _items array<string>, _hit_spans array<struct<start:int,end:int>>", ("_found",))
    out = out.mapInArrow(_close(text), schema).withColumn("_contaminated", F.size("_items") >= min_items)
    return give_back(out, ("_n_words", "_n_hit", "_items", "_hit_spans", "_contaminated"))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = mark_contaminated(docs.select("doc_id", "text"), benchmark)
    return out.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        F.col("_contaminated").alias("contaminated"),
    )
