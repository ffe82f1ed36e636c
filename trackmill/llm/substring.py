"""Substring dedup over a De Bruijn graph of word k-mers.

A window of ``width`` words is an edge between the nodes of its first and last ``width - 1``
words. Edges are hashed to 64 bits and dealt to buckets by a second, independent hash, so two
windows count as one edge only if about 64 + log2(buckets) bits agree. Edges travel as packed
arrays, and each slice of input first keeps its smallest document for an edge: an edge that
fills a third of the corpus reaches its bucket once per slice, never once per document.

A bucket answers every edge with its source, the smallest document that holds it. Documents that
hold an edge with a smaller source are joined with those answers; in each of them consecutive
answered edges are a nonbranching path through the graph and compact into one span. Answers carry
the source, so a span can be looked up at its source's coordinates (``verify_spans``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import batches, mix, rolling, settle, text_bytes, word_hashes

#: Edges that one bucket should hold.
BUCKET_EDGES = 2_000_000
#: Bytes of text in a slice.
SLICE = 6 << 20


def _edges_of(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All edges of the texts in order, their second hash, and for each the index of its text."""
    split = [(t or b"").split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    hashes = word_hashes([w for words in split for w in words])
    owner = np.repeat(np.arange(len(split), dtype=np.int32), sizes)
    n = max(0, len(hashes) - width + 1)
    inside = owner[:n] == owner[len(owner) - n :]
    other = rolling(mix(hashes + np.uint64(0x632BE59BD9B4E019)), width)
    return rolling(hashes, width)[inside], other[inside], owner[:n][inside]


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary array whose i-th item is values[cuts[i]:cuts[i+1]] as bytes."""
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _cuts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


_DEALT = "bucket int, docs binary, edges binary, sources binary"
_DEALT_ARROW = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("edges", pa.binary()), ("sources", pa.binary())])


def _answers(edges: np.ndarray, docs: np.ndarray, sources: np.ndarray) -> list[pa.Array]:
    """doc_id, edges and sources columns, one row for each document; equal sources stand together and pack well."""
    order = np.lexsort((sources, docs))
    edges, docs, sources = edges[order], docs[order], sources[order]
    cuts = _cuts(docs)
    return [pa.array(docs[cuts[:-1]]), _packed(edges, cuts), _packed(sources, cuts)]


def _resolve(edges: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by (edge, doc): the order, a flag for the first of each edge, the first doc of each edge."""
    order = np.lexsort((docs, edges))
    e = edges[order]
    first = np.ones(len(e), bool)
    first[1:] = e[1:] != e[:-1]
    return order, first, docs[order][np.maximum.accumulate(np.where(first, np.arange(len(e)), 0))]


def _by_block(edges: np.ndarray, docs: np.ndarray, sources: np.ndarray, blocks: int) -> list[pa.Array]:
    """block, docs, edges and sources columns, one row for each block of documents."""
    block = _block(docs, blocks)
    order = np.lexsort((sources, docs, block))
    edges, docs, sources, block = edges[order], docs[order], sources[order], block[order]
    cuts = _cuts(block)
    return [pa.array(block[cuts[:-1]]), _packed(docs, cuts), _packed(edges, cuts), _packed(sources, cuts)]


def _block(docs: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(docs.view(np.uint64)) % np.uint64(blocks)).astype(np.int32)


def _deal(rows: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, SLICE):
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        edges, other, owner = _edges_of(text_bytes(batch.column(1)), width)
        if not len(edges):
            continue
        docs = ids[owner]
        order, first, source = _resolve(edges, docs)
        edges, docs = edges[order], docs[order]
        again = docs > source
        fresh = np.ones(len(edges), bool)
        fresh[1:] = first[1:] | (docs[1:] != docs[:-1])
        again &= fresh
        bucket = (other[order][first] % np.uint64(buckets)).astype(np.int32)
        e, d = edges[first], docs[first]
        by = np.lexsort((d, bucket))
        bucket, e, d = bucket[by], e[by], d[by]
        cuts = _cuts(bucket)
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), _packed(d, cuts), _packed(e, cuts), pa.nulls(len(cuts) - 1, pa.binary())], schema=_DEALT_ARROW)
        if again.any():
            yield pa.RecordBatch.from_arrays(_by_block(edges[again], docs[again], source[again], buckets), schema=_DEALT_ARROW)


def _arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packed docs, edges and sources of some rows, end to end."""
    return tuple(np.frombuffer(b"".join(x or b"" for x in rows[c].to_pylist()), t) for c, t in (("docs", np.int64), ("edges", np.uint64), ("sources", np.int64)))


def _bucket(group: pa.Table, blocks: int) -> pa.Table:
    """Answers of one bucket by block of documents; those that slices gave already pass through."""
    docs, edges, _ = _arrays(group.filter(group["sources"].is_null()))
    given_docs, given, given_sources = _arrays(group.filter(group["sources"].is_valid()))
    order, first, source = _resolve(edges, docs)
    edges, docs = edges[order], docs[order]
    fresh = np.ones(len(edges), bool)
    fresh[1:] = first[1:] | (docs[1:] != docs[:-1])
    again = (docs > source) & fresh
    found = np.concatenate([edges[again], given]), np.concatenate([docs[again], given_docs]), np.concatenate([source[again], given_sources])
    return pa.table(_by_block(*found, blocks), names=["block", "docs", "edges", "sources"])


def _document(group: pa.Table) -> pa.Table:
    """The answers of one block, a row for each document."""
    docs, edges, sources = _arrays(group)
    return pa.table(_answers(edges, docs, sources), names=["doc_id", "edges", "sources"])


def spans_of(text: bytes | None, answered: np.ndarray, width: int) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The words of a text, and the maximal paths of its answered edges as word ranges [start, end)."""
    words = (text or b"").split()
    if not len(answered) or len(words) < width:
        return words, []
    at = np.flatnonzero(np.isin(rolling(word_hashes(words), width), answered))
    if not len(at):
        return words, []
    breaks = np.flatnonzero(np.diff(at) > width)
    starts, ends = at[np.concatenate(([0], breaks + 1))], at[np.concatenate((breaks, [len(at) - 1]))] + width
    return words, list(zip(starts.tolist(), ends.tolist(), strict=True))


def _apply(rows: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows):
        found: tuple[list, list, list] = ([], [], [])
        spans = []
        for text, edges in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            answered = np.frombuffer(edges, np.uint64) if edges else np.empty(0, np.uint64)
            words, ranges = spans_of(text, answered, width)
            kept, at = [], 0
            for start, end in ranges:
                kept += words[at:start]
                at = end
            kept += words[at:]
            found[0].append(len(words))
            found[1].append(len(words) - len(kept))
            found[2].append(b" ".join(kept).decode())
            spans.append([{"start": s, "end": e} for s, e in ranges])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "n_words", "n_removed", "kept", "spans"])


def repeated_edges(docs: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, edges binary, sources binary): 64-bit edges of a document that also start in a smaller one."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, round(size / 6 / BUCKET_EDGES))
    dealt = rows.mapInArrow(partial(_deal, width=width, buckets=buckets), _DEALT)

    def answer(group: pa.Table) -> pa.Table:
        return _bucket(group, buckets)

    answers = dealt.groupBy("bucket").applyInArrow(answer, "block int, docs binary, edges binary, sources binary")
    return settle(answers, "edges").groupBy("block").applyInArrow(_document, "doc_id long, edges binary, sources binary")


def substring_dedup(docs: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words left, joined by one space), spans (removed word ranges).

    One row per row of ``docs(doc_id, text, ...)``. A word goes if a window of ``width`` words that
    covers it also starts in a document with a smaller doc_id; windows are judged on the input.
    A null text has no words. A row without doc_id neither loses words nor takes others'. Rows that
    share a doc_id are one document in several rows: each is judged alone and against smaller ids.
    """
    answers = repeated_edges(docs, width).select("doc_id", "edges")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = rows.join(answers, "doc_id", "left")
    return joined.mapInArrow(partial(_apply, width=width), "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>")


def verify_spans(docs: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, edge, source, same): every answered edge compared, as words, with the source's own words.

    A check of the hashes for audits: windows of both documents are joined on the edge's hash and their
    words compared. It reads the texts of all documents that answers name.
    """
    answers = settle(repeated_edges(docs, width), "verify")
    pairs = answers.mapInArrow(_unpack, "doc_id long, edge long, source long")
    wanted = pairs.select("doc_id", "edge").unionAll(pairs.select(F.col("source").alias("doc_id"), "edge")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    listed = wanted.groupBy("doc_id").agg(F.collect_list("edge").alias("edges"))
    windows = settle(texts.join(listed, "doc_id").mapInArrow(partial(_windows, width=width), "doc_id long, edge long, words binary"), "windows").groupBy("doc_id", "edge").agg(F.min("words").alias("words"))
    own = windows.select("doc_id", "edge", F.col("words").alias("_own"))
    src = windows.select(F.col("doc_id").alias("source"), "edge", F.col("words").alias("_src"))
    return pairs.join(own, ["doc_id", "edge"]).join(src, ["source", "edge"]).select("doc_id", "edge", "source", F.col("_own").eqNullSafe(F.col("_src")).alias("same"))


def _unpack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        edges = [np.frombuffer(e, np.int64) for e in batch.column(1).to_pylist()]
        sources = [np.frombuffer(s, np.int64) for s in batch.column(2).to_pylist()]
        ids = np.repeat(batch.column(0).to_numpy(), [len(e) for e in edges])
        flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (edges, sources)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(flat[0]), pa.array(flat[1])], ["doc_id", "edge", "source"])


def _windows(rows: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The words of the asked windows, as a digest."""
    for batch in batches(rows):
        found: tuple[list, list, list] = ([], [], [])
        for doc_id, text, edges in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = (text or b"").split()
            all_edges = rolling(word_hashes(words), width).view(np.int64)
            for i in np.flatnonzero(np.isin(all_edges, np.array(edges, np.int64))):
                found[0].append(doc_id)
                found[1].append(int(all_edges[i]))
                found[2].append(hashlib.sha256(b" ".join(words[i : i + width])).digest())
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.binary())], ["doc_id", "edge", "words"])
