"""Language ID by prediction by partial matching.

Each language has a context tree over bytes of depth ORDER: counts of every byte after every
context of up to ORDER bytes. A byte that a context has not seen costs an escape (method C:
distinct followers against all) and is then coded in the context one byte shorter; below the
empty context all 256 bytes are alike. With the statistics frozen after training, the exact code
length of a byte after ORDER bytes is a constant for each language, so the trees unfold into
tables keyed by the bytes and a text's code length is a sum of lookups. The shortest code wins.

The trees are fitted on a bounded sample: about ``per_language`` documents of each language,
chosen by a hash of doc_id. Every document is scored, over its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import batches, crc32_of_id, text_bytes

ORDER = 3
PAD = b"\0" * ORDER
#: Documents of a language that the trees are fitted on, about.
PER_LANGUAGE = 4000
MOST_LANGUAGES = 500
UNKNOWN = "und"
#: Bytes of text that are held as grams at once, about, and code lengths that are.
SLICE_BYTES, CELLS = 1 << 20, 1 << 20
_EMPTY = np.uint32(0xFFFFFFFF)


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the texts its ORDER predecessors and itself as one number, and the texts' sizes."""
    sizes = np.array([len(t or b"") for t in texts], np.int64)
    data = np.frombuffer(b"".join(PAD + (t or b"").lower() for t in texts) + PAD, np.uint8)
    starts = np.cumsum(sizes + ORDER) - sizes - ORDER
    inside = np.ones(len(data) - ORDER, bool)
    for back in range(1, ORDER + 1):
        ends = starts + sizes + ORDER - back
        inside[ends[ends >= starts + sizes]] = False
    key = data[: len(data) - ORDER].astype(np.uint32)
    for ahead in range(1, ORDER + 1):
        key = key << np.uint32(8) | data[ahead : len(data) - ORDER + ahead]
    return key[inside], sizes


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(re.search(rb"[A-Za-z]", text)) or any(map(str.isalpha, text.decode("utf-8", "ignore")))


class Rows:
    """Row number of each of a set of 32-bit keys: an open-addressed table that is searched a whole array at a time."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.mask = np.uint32((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, _EMPTY, np.uint32)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(left):
            free = self.rows[slot] < 0
            self.rows[slot[free]] = left[free]
            placed = self.rows[slot] == left
            self.keys[slot[placed]] = keys[left[placed]]
            left, slot = left[~placed], (slot[~placed] + np.uint32(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761) >> np.uint32(32 - self.bits)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 for keys that aren't there."""
        slot = self._slot(keys)
        found = self.rows[slot]
        left = np.flatnonzero((found >= 0) & (self.keys[slot] != keys))
        slot = slot[left]
        while len(left):
            slot = (slot + np.uint32(1)) & self.mask
            found[left] = self.rows[slot]
            more = (found[left] >= 0) & (self.keys[slot] != keys[left])
            left, slot = left[more], slot[more]
        return found


class Trees:
    """Code lengths in bits under every language's tree: shape (bytes, languages)."""

    def __init__(self, languages: list[str], of: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> None:
        """of, keys, counts: language number, ORDER + 1 bytes and how often they occur."""
        self.languages = languages
        n = len(languages)
        lower = np.full((1, n), 8.0)  # bits of any byte below the empty context
        self.tables: list[tuple[Rows, np.ndarray, Rows, np.ndarray]] = []
        for order in range(ORDER + 1):
            width = np.uint64(8 * (order + 1))
            part = (keys.astype(np.uint64) & ((np.uint64(1) << width) - np.uint64(1))).astype(np.uint32)
            seen = np.unique(part)
            table = np.zeros((len(seen), n))
            np.add.at(table, (np.searchsorted(seen, part), of), counts)
            contexts, at = np.unique(seen >> np.uint32(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(total, at, table)
            np.add.at(kinds, at, table > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
                direct = np.log2((total + kinds)[at] / table)
            below = self._bits(seen) if order else np.repeat(lower, len(seen), axis=0)
            bits = np.where(table > 0, direct, escape[at] + below)
            self.tables.append((Rows(seen), bits.astype(np.float32), Rows(contexts), escape.astype(np.float32)))

    def _bits(self, keys: np.ndarray) -> np.ndarray:
        """Code lengths by the deepest table there is, then through escapes by the shallower ones."""
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        left = np.arange(len(keys))
        for order in range(len(self.tables) - 1, -1, -1):
            rows, bits, contexts, escape = self.tables[order]
            part = keys[left] & np.uint32((1 << 8 * (order + 1)) - 1)
            found = rows.find(part)
            hit = found >= 0
            out[left[hit]] += bits[found[hit]]
            left, part = left[~hit], part[~hit]
            if not len(left):
                return out
            at = contexts.find(part >> np.uint32(8))
            known = at >= 0
            out[left[known]] += escape[at[known]]
        out[left] += np.float32(8.0)
        return out

    def lengths(self, texts: list[bytes | None]) -> np.ndarray:
        """Bits of each text under each language. Texts are looked up in runs of bounded size, long ones cut from their start on."""
        keys, sizes = grams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        step = max(1, CELLS // max(1, len(self.languages)))
        parts = -(-sizes // step)
        of = np.repeat(np.arange(len(texts)), parts)
        ends = np.cumsum(sizes)
        start = (ends - sizes)[of] + (np.arange(len(of)) - (np.cumsum(parts) - parts)[of]) * step
        stop = np.minimum(start + step, ends[of])
        cuts = np.flatnonzero(np.diff(start // step, prepend=-1, append=-1))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            bits = self._bits(keys[start[x] : stop[y - 1]])
            np.add.at(out, of[x:y], np.add.reduceat(bits, start[x:y] - start[x], axis=0, dtype=np.float64))
        return out

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        """Language and its share of the posterior under equal priors; UNKNOWN and 0 without a letter."""
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        bits = self.lengths(texts)
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
        fine = [has_letter(t) for t in texts]
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, fine, strict=True)], [float(s) if ok else 0.0 for s, ok in zip(share, fine, strict=True)]


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, 2 * SLICE_BYTES):
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = text_bytes(batch.column(1))
        for lang in sorted(set(langs)):
            keys, _ = grams([texts[i] for i in np.flatnonzero(langs == lang)])
            found, counts = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])


def is_held_out(doc_id="doc_id"):
    return F.pmod(crc32_of_id(doc_id), F.lit(4)) == 2


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Trees:
    """Trees from the documents that aren't held out and have a text and a lang.

    At most MOST_LANGUAGES languages; about ``per_language`` documents of each, chosen by hash.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang")).where(~is_held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    if not sizes:
        return Trees([], np.empty(0, int), np.empty(0, np.uint32), np.empty(0))
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r.lang, F.lit(min(1.0, per_language / r.n))).otherwise(share)
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("language sample")), F.lit(1 << 30))
    sample = rows.where(place < share * (1 << 30)).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    of = np.searchsorted(np.array(languages, object), counts["lang"].to_numpy(object)) if languages else np.empty(0, int)
    return Trees(languages, of, counts["gram"].to_numpy().astype(np.uint32), counts["n"].to_numpy().astype(float))


def _score(rows: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, SLICE_BYTES):
        langs, scores = model.value.predict(text_bytes(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, lang, ...).

    lang_pred is "und", with score 0, for a null text or one without a letter, or if nothing could be
    learned. Ties go to the first language by name. lang, source and doc_id don't enter a prediction.
    A null doc_id counts as the empty text in the hold-out rule.
    """
    trees = train(docs) if trees is None else trees
    model = docs.sparkSession.sparkContext.broadcast(trees)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(partial(_score, model=model), "doc_id long, lang_pred string, score double").select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")


def _keep(rows: Iterator[pa.RecordBatch], model, at: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, SLICE_BYTES):
        langs, scores = model.value.predict(text_bytes(batch.column(at)))
        yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in zip(langs, scores, strict=True)]))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is known with a score of at least ``least``, with all columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs))
    return docs.mapInArrow(partial(_keep, model=model, at=docs.columns.index("text"), least=least), docs.schema)
