"""SimHash near-dedup by multi-index hashing.

A fingerprint is cut into segments, and there is a table for each: it files the fingerprint under the
bits of that segment. Of two fingerprints within ``radius`` bits, some segment differs in at most
``radius / segments`` bits, so a search enumerates the Hamming ball of that radius inside each segment,
fetches what the table holds there, and verifies the complete distance of every match.

Exact copies are one fingerprint. Near copies by the thousand may share a segment and so fill one key of
a table; what such a full key can match is searched by points of the whole fingerprint instead: each is
filed under the ball of half the radius around it, two within the radius share a point, and a point
holds one ball of fingerprints at most, so its members link to the least of them and never become pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.llm.common import batches, settle, text_bytes
from trackmill.llm.components import connected_components

SEED = 42
#: Fingerprints under one key of a table beyond which it is full.
FULL = 500
#: Full keys of which a list is broadcast, at most (16 bytes each).
LISTED = 2_000_000
#: A fingerprint that this share of all rows has is handed its component by a broadcast; there are no more of them.
SHARE = 1000
#: Shingles whose bits are counted at once, for long texts.
CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, SEED) for g in grams], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        part = h[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(rows: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows):
        found = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row of docs; bits of fp are those of the unsigned fingerprint."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_fingerprints, shingle=shingle), "doc_id long, fp long")


def ball(radius: int, width: int = 64) -> list[int]:
    """Signed masks of at most ``radius`` of the lowest ``width`` bits."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _keys(segments: int, radius: int) -> Column:
    """The keys of fp in every table: a segment's bits, changed within a ball, and its number."""
    width = 64 // segments
    ours = [F.shiftrightunsigned(F.col("fp"), k * width).bitwiseAND(F.lit((1 << width) - 1)) for k in range(segments)]
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius, width)])

    def keys(k: int) -> Column:
        return F.transform(masks, lambda m: F.shiftleft(ours[k].bitwiseXOR(m), 5).bitwiseOR(F.lit(k).cast("long")))

    return F.flatten(F.array(*map(keys, range(segments))))


def links(prints: DataFrame, radius: int = 2, segments: int = 2) -> DataFrame:
    """Links (a, b, distance) between the fingerprints fp of prints that connect all within ``radius`` bits.

    prints has one row for each fingerprint. Every pair that a table finds and the whole distance confirms is
    a link; where a key is full, links that connect the same. ``radius`` must be even, and segments 2, 4, 8, 16 or 32.
    """
    if radius % 2:
        raise ValueError("radius must be even: each side of a full key takes half of it")
    if segments not in (2, 4, 8, 16, 32):
        raise ValueError("segments must be 2, 4, 8, 16 or 32")
    filed = prints.select("fp", F.explode(_keys(segments, 0)).alias("key"))
    asked = prints.select("fp", F.explode(_keys(segments, radius // segments)).alias("key"))
    full = settle(filed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > FULL).select("key"), "simhash-full", free=False)
    crowded = full.count()
    if crowded:
        listed = F.broadcast(full) if crowded <= LISTED else full
        dense = settle(asked.join(listed, "key", "left_semi").select("fp").distinct(), "simhash-dense", free=False)
        filed, asked = (x.join(listed, "key", "left_anti") for x in (filed, asked))
    one, two = filed.select("key", F.col("fp").alias("b")), asked.select("key", F.col("fp").alias("a"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    met = two.join(one, (two["key"] == one["key"]) & (F.col("a") > F.col("b")) & (apart <= radius)).select("a", "b", apart.alias("distance"))
    return met.unionAll(_by_points(dense, radius)) if crowded else met


def _by_points(prints: DataFrame, radius: int) -> DataFrame:
    """Links that connect what lies within ``radius`` bits, by points of half the radius around each fingerprint."""
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    index = prints.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    least = F.min("fp").over(Window.partitionBy("point"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return index.select(F.col("fp").alias("a"), least.alias("b")).where("a != b").withColumn("distance", apart).where(F.col("distance") <= radius)


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2, segments: int = 2) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, fingerprint, component_id.

    fingerprint is 16 lowercase hex digits. component_id is the least doc_id that can be reached over
    links of at most ``radius`` differing bits. A null or wordless text has fingerprint zero and links
    like any other; repeated rows stay repeated; a row without doc_id links others and gets its component's
    id (null if the component has none). No rows: no rows. Other columns of docs are not looked at.
    """
    prints = settle(fingerprints(docs, shingle), "simhash")
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp"), radius, segments))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    joined = placed.where("fp != root").select("root", "least").unionAll(placed.join(roots.select("root").distinct(), "root", "left_semi").where("fp = root").select("root", "least"))
    ids = joined.groupBy("root").agg(F.min("least").alias("id"))
    labelled = settle(placed.join(ids, "root", "left").select("fp", "n", F.coalesce("id", "least").alias("component_id")), "simhash-labels")
    usual = F.broadcast(labelled.where(F.col("n") * SHARE > prints.count()).drop("n"))
    found = prints.join(usual, "fp").unionByName(prints.join(usual, "fp", "left_anti").join(labelled.drop("n"), "fp"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of docs that stay when one document of each component does: that with the least doc_id.

    Of rows that repeat a doc_id one stays, the first by digest of its text. Rows without a doc_id can't be
    named by a component and all stay. All columns of docs are returned, whatever their names.
    """
    found = simhash_components(docs, shingle, radius)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("_keep_id")).distinct()
    named = docs.where(docs["doc_id"].isNotNull()).join(keep, docs["doc_id"] == keep["_keep_id"], "left_semi")
    first = F.row_number().over(Window.partitionBy(docs["doc_id"]).orderBy(F.sha2(docs["text"].cast("binary"), 256), F.xxhash64(*[docs[c] for c in docs.columns if c != "text"])))
    one = named.withColumn("_keep_rank", first).where("_keep_rank = 1").drop("_keep_rank")
    return one.unionAll(docs.where(docs["doc_id"].isNull()))
