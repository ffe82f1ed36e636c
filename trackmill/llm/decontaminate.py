"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Items and documents are sequences of lower-cased words without punctuation. Every run of SEED words
of an item is a seed, however many documents hold it: what leaked widely is no rarer for that, and
the part of an item that didn't leak says nothing of the part that did. Passages meet items by seeds:
hits of one item that lie close together in a text bound a window. A window that holds too few of the
item's words for the least score is left; otherwise the local alignment of the item with the window
scores it, edits, insertions and losses included. The score is the alignment's share of a perfect copy's.

The items are a stated set of queries. They are sent out in blocks of bounded size, so what is
broadcast doesn't grow with the corpus, nor beyond a block with the benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import batches, rolling, text_bytes, word_hashes

SEED = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of a perfect copy's score from which a passage is a leak.
LEAST = 0.5
BLOCK_ITEMS = 20_000
#: Bytes of rows that are filtered together, about.
SLICE_BYTES = 2 << 20
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")


def normal(text: bytes | None) -> np.ndarray:
    """Hashes of a text's words: lower case, letters and digits only."""
    return word_hashes(TOKEN.findall((text or b"").decode("utf-8", "replace").lower().encode()))


class Items:
    """A block of benchmark items and their seeds."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.ids = [i for i, _ in items]
        self.words = [normal(t) for _, t in items]
        parts = [rolling(w, SEED) for w in self.words]
        seeds = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        at = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.empty(0, int)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.item, self.at = seeds[order], item[order].astype(np.int64), at[order].astype(np.int64)
        self.distinct = np.unique(self.seeds)

    def hits(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every seed of an item met in a text: place in the text, item, place in the item."""
        if not len(self.distinct) or not len(edges):
            return (np.empty(0, np.int64),) * 3
        near = np.minimum(np.searchsorted(self.distinct, edges), len(self.distinct) - 1)
        place = np.flatnonzero(self.distinct[near] == edges)
        lo, hi = np.searchsorted(self.seeds, edges[place]), np.searchsorted(self.seeds, edges[place], "right")
        sizes = hi - lo
        rows = np.repeat(lo - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.repeat(place, sizes), self.item[rows], self.at[rows]


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment score (Smith-Waterman) and where it ends in the window.

    A row at a time: gaps along a row are a running maximum of what the row has, tilted by the gap's cost.
    """
    n = len(window)
    tilt = np.arange(n + 1) * -GAP
    row = np.zeros(n + 1, np.int64)
    best, end = 0, 0
    for word in item:
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(window == word, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + tilt) - tilt
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def leaks(text: bytes | None, items: Items, least: float = LEAST) -> list[tuple[int, float, int, int]]:
    """(item number, score, start, end) of the best passage of each item that a text leaks, in its words."""
    words = normal(text)
    place, item, at = items.hits(rolling(words, SEED))
    found = []
    if not len(place):
        return found
    order = np.lexsort((place, item))
    place, item, at = place[order], item[order], at[order]
    length = np.array([len(items.words[i]) for i in item])
    cut = np.ones(len(place), bool)
    cut[1:] = (item[1:] != item[:-1]) | (place[1:] - place[:-1] > 2 * length[1:])
    starts = np.flatnonzero(cut)
    best: dict[int, tuple[float, int, int]] = {}
    for a, b in zip(starts, np.append(starts[1:], len(place)), strict=True):
        i = int(item[a])
        own = items.words[i]
        m = len(own)
        lo = max(0, int((place[a:b] - at[a:b]).min()) - m // 2 - 2)
        hi = min(len(words), int((place[a:b] - at[a:b]).max()) + m + m // 2 + 2)
        window = words[lo:hi]
        if np.isin(own, window).sum() < least * m:  # each match takes a word of the item
            continue
        score, end = align(own, window)
        share = score / (MATCH * m)
        if share >= least and share > best.get(i, (0.0,))[0]:
            _, back = align(own[::-1], window[:end][::-1])
            best[i] = share, lo + end - back, lo + end
    return [(i, *best[i]) for i in sorted(best)]


def _blocks(benchmark: DataFrame) -> list[Items]:
    """Items by number; rows without an id or with a null text are no items, repeated rows count once."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct().orderBy("item_id", "text")
    out, block = [], []
    for r in items.toLocalIterator():
        block.append((r[0], r[1].encode()))
        if len(block) == BLOCK_ITEMS:
            out.append(Items(block))
            block = []
    return out + [Items(block)] if block else out


def _prepared(docs: DataFrame, benchmark: DataFrame) -> list:
    """Blocks of items with their seeds, broadcast."""
    context = docs.sparkSession.sparkContext
    return [context.broadcast(items) for items in _blocks(benchmark)]


def _align(rows: Iterator[pa.RecordBatch], items, least: float) -> Iterator[pa.RecordBatch]:
    own = items.value
    for batch in batches(rows):
        found = [(d, own.ids[i], s, a, b) for d, t in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True) for i, s, a, b in leaks(t, own, least)]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], ["doc_id", "item_id", "score", "start", "end"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, score, start, end): benchmark items that documents hold, with the best passage of each.

    start and end count words of letters and digits. Null or empty texts leak nothing; an item shorter
    than SEED words has no seed and is not looked for; each row of docs is searched, also if its
    doc_id repeats or is null. An empty table on either side gives no rows.
    """
    schema = "doc_id long, item_id long, score double, start int, end int"
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    parts = [rows.mapInArrow(partial(_align, items=items, least=least), schema) for items in _prepared(docs, benchmark)]
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def _clean(rows: Iterator[pa.RecordBatch], items: list, at: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, SLICE_BYTES):
        yield batch.filter(pa.array([not any(leaks(t, own.value, least) for own in items) for t in text_bytes(batch.column(at))], pa.bool_()))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs that hold no passage of the benchmark, with all columns."""
    items = _prepared(docs, benchmark)
    return docs.mapInArrow(partial(_clean, items=items, at=docs.columns.index("text"), least=least), docs.schema)
