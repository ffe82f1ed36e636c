"""Alignment of two tokenizers over a corpus: which tokens of the one stand for which of the other.

A text's two token sequences are cut into groups where byte ends of both meet, and all pairs inside a group
are links. How well a link is supported is how many documents hold its pair of ids, against the best of its
first id.

Documents are encoded once. Their links leave as postings: for a slice of documents and one id of side A, the
B ids, documents and multiplicities in packed arrays. Postings are shuffled by A id to ranges of ids that are
split further by documents where they are large, so a frequent id never lands in one task. Counts of pairs,
added up before, go to the same places; there both are read as one stream in sorted order (Spark's external sort, so
it spills), counts before postings, and what is held at a time is one id's counts. Each range
emits a document's contribution once, so what is added up by document is of fixed size a document.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import batches, settle

#: Ranges of A ids, and the postings that one task of a range should read.
RANGES, POSTINGS = 16, 4_000_000
#: Links, counts or contributions that a worker collects before it adds them up.
HELD = 1_500_000
#: Documents of one posting, at most: their places in it are 16 bits wide. Bytes of text that are aligned at a time, about. Groups with more links are expanded by distinct ids.
SLICE, SLICE_BYTES, LARGE_GROUP = 60_000, 2 << 20, 1 << 14


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones themselves, the others from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE vocabulary file of the tokenizers library; special tokens in a text are plain text.

    Where the file has no parts but the usual ones and numbers its merges in their order, its ids are those that the
    same ranks give in tiktoken, which is four times as fast. Other files go through the library.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        special, letters = {t["id"]: t["content"] for t in spec["added_tokens"]}, byte_alphabet()
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.pieces[i] = special[i].encode() if i in special else bytes(map(letters.__getitem__, token))
        self.encode = self._by_ranks(spec, pattern) or self._by_library(path)

    def _by_ranks(self, spec: dict, pattern: str):
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        usual = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
        usual = usual and all(t["special"] for t in spec["added_tokens"]) and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]] if usual else []
        if not made or any(model["vocab"].get(token) != 256 + k for k, token in enumerate(made)) or sorted(model["vocab"][c] for c in byte_alphabet()) != list(range(256)):
            return None
        import tiktoken

        ranks = {self.pieces[i]: i for i in range(256 + len(made))}
        return tiktoken.Encoding("side", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _by_library(self, path: str):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        return lambda text: own.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece model; <0xHH> stands for a byte and U+2581 for a space."""

    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [bytes([int(p[3:5], 16)]) if own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(own.id_to_piece, range(own.get_piece_size())))]
        self.encode = own.encode


@lru_cache(maxsize=2)
def sides(a: str, b: str, pattern: str) -> tuple:
    """Both encoders, the sizes of their tokens in bytes, and the ids' digits with each of the three signs that may follow."""
    one, two = ByteLevel(a, pattern), Pieces(b)
    size = lambda side: np.array([len(p) for p in side.pieces], np.int64)
    digits = [b"%d%s" % (i, sign) for i in range(max(len(one.pieces), len(two.pieces))) for sign in (b",", b"|", b";")]
    return one, two, size(one), size(two), digits


def _tokens(text: str | None, one, two) -> tuple[np.ndarray, np.ndarray]:
    none = np.empty(0, np.int64)
    if not text:
        return none, none
    raw, a, b = b" " + text.encode(), one.encode(" " + text), two.encode(text)
    if b"".join(map(one.pieces.__getitem__, a)) != raw or b"".join(map(two.pieces.__getitem__, b)) != raw:
        return none, none
    return np.array(a, np.int64), np.array(b, np.int64)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1, for one size after the other."""
    return np.arange(sizes.sum()) - np.repeat(_starts(sizes)[:-1], sizes)


def align(texts: list[str | None], one, two, size_a: np.ndarray, size_b: np.ndarray, digits: list[bytes]) -> tuple:
    """For each text n_a, n_b, n_groups, n_links and its groups' digest; and all distinct links as a << 40 | b << 16 | text, sorted, with their multiplicities."""
    both = [_tokens(t, one, two) for t in texts]
    n = np.array([(len(a), len(b)) for a, b in both], np.int64).reshape(-1, 2)
    ids = [np.concatenate([*(x[k] for x in both), np.empty(0, np.int64)]) for k in (0, 1)]
    del both
    ends = [np.cumsum(size[i]) for size, i in zip((size_a, size_b), ids)]
    meet = np.zeros(int(ends[0][-1]) + 1 if len(ends[0]) else 1, np.int8)
    meet[ends[0]] += 1
    meet[ends[1]] += 1
    passed = np.cumsum(meet == 2, dtype=np.int64)
    group = [passed[e - 1] for e in ends]
    held = [np.bincount(g, minlength=passed[-1]) for g in group]
    per_text = [_starts(n[:, k]) for k in (0, 1)]
    bounds = np.append(group[0], passed[-1])[per_text[0]]
    n_groups, links = np.diff(bounds), _starts(held[0] * held[1])
    n_links = np.diff(links[bounds])

    sizes = held[0] + held[1]
    first, last = _starts(sizes)[:-1], [np.append(g[1:] != g[:-1], True)[: len(g)] for g in group]
    order = np.empty(int(sizes.sum()), np.int64)
    for k, shift in ((0, first), (1, first + held[0])):
        order[shift[group[k]] + _ramp(held[k])] = ids[k] * 3 + np.where(last[k], k + 1, 0)
    del passed, meet, ends
    tokens, digests = per_text[0] + per_text[1], []
    for x, y in zip(tokens[:-1].tolist(), tokens[1:].tolist()):
        digests.append(hashlib.sha256(b"".join(map(digits.__getitem__, order[x:y].tolist()))[:-1]).hexdigest() if y > x else "")
    del order

    text_of = np.repeat(np.arange(len(texts)), n_groups)
    usual = held[0] * held[1] <= LARGE_GROUP
    begin = [_starts(h)[:-1] for h in held]
    mine = np.flatnonzero(usual[group[0]])
    g = group[0][mine]
    reach = held[1][g]
    link = (np.repeat(ids[0][mine], reach) << 40) | (ids[1][np.repeat(begin[1][g], reach) + _ramp(reach)] << 16) | np.repeat(text_of[g], reach)
    link, times = np.unique(link, return_counts=True)
    for k in np.flatnonzero(~usual).tolist():
        (a, na), (b, nb) = (np.unique(ids[s][begin[s][k] : begin[s][k] + held[s][k]], return_counts=True) for s in (0, 1))
        more = ((a[:, None] << 40) | (b[None, :] << 16) | text_of[k]).ravel()
        link, times = _summed(np.concatenate([link, more]), np.concatenate([times, np.outer(na, nb).ravel()]))
    return (n[:, 0], n[:, 1], n_groups, n_links, digests), (link, times)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[cuts], *((np.add.reduceat(v[order], cuts) if len(cuts) else v[:0]) for v in values)


def _packed(values: np.ndarray, kind: type, cuts: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(values.astype(kind))
    width = raw.itemsize
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(raw)])


_ENCODED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, size long, b binary, text binary, times binary"
_TYPES = [("row", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("a", pa.int32()), ("size", pa.int64()), ("b", pa.binary()), ("text", pa.binary()), ("times", pa.binary())]


def _batch(n: int, **columns) -> pa.RecordBatch:
    """n rows of _ENCODED, null in all columns that aren't given."""
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _TYPES], [c for c, _ in _TYPES])


def _encode(rows: Iterator[pa.RecordBatch], a: str, b: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """A row for each document, and one for each A id of a slice of documents: its postings, from the slice's first row."""
    own, held = sides(a, b, pattern), _Postings()
    for batch in batches(rows, SLICE_BYTES):
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            base = part.column(0)[0].as_py()
            if held.full(base + part.num_rows):
                yield from held.emptied()
            told, links = align(part.column(2).to_pylist(), *own)
            names = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
            yield _batch(part.num_rows, row=part.column(0), doc_id=part.column(1), **dict(zip(names, told)))
            held.add(base, *links)
    yield from held.emptied()


class _Postings:
    """Links of neighbouring rows, from a first row on, until they are many or too far from it."""

    def __init__(self):
        self.base, self.keys, self.times, self.size = None, [], [], 0

    def full(self, end: int) -> bool:
        return self.base is not None and (self.size > HELD or not 0 < end - self.base <= SLICE)

    def add(self, row: int, keys: np.ndarray, times: np.ndarray) -> None:
        self.base = row if self.base is None else self.base
        self.keys.append(keys + (row - self.base))
        self.times.append(times.astype(np.int32))
        self.size += len(keys)

    def emptied(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            keys, times = np.concatenate(self.keys), np.concatenate(self.times)
            order = np.argsort(keys)
            keys, times, ids = keys[order], times[order], keys[order] >> 40
            cuts = np.append(np.flatnonzero(np.append(True, ids[1:] != ids[:-1])), len(ids))
            found = ids[cuts[:-1]]
            yield _batch(len(found), row=np.full(len(found), self.base), a=found.astype(np.int32), size=np.diff(cuts), b=_packed((keys >> 16) & 0xFFFFFF, np.int32, cuts), text=_packed(keys & 0xFFFF, np.uint16, cuts), times=_packed(times, np.int32, cuts))
        self.__init__()


def _unpack(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents hold each pair, of postings or of earlier counts: one row for an A id and some of its pairs."""
    keys, counts, held = [], [], 0
    for batch in rows:
        a = batch.column(0).to_numpy()
        b = _unpack(batch.column(1), np.int32)
        sizes = np.array([len(x) // 4 for x in batch.column(1).to_pylist()], np.int64)
        n = _unpack(batch.column(2), np.int64) if batch.num_columns > 2 else np.ones(len(b), np.int64)
        key, n = _summed((np.repeat(a.astype(np.int64), sizes) << 32) | b, n)
        keys.append(key)
        counts.append(n)
        held += len(key)
        if held > HELD:
            key, n = _summed(np.concatenate(keys), np.concatenate(counts))
            if len(key) > HELD // 2:
                yield _counts(key, n)
                key, n = key[:0], n[:0]
            keys, counts, held = [key], [n], len(key)
    if held:
        yield _counts(*_summed(np.concatenate(keys), np.concatenate(counts)))


def _counts(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    a = key >> 32
    cuts = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a))
    return pa.RecordBatch.from_arrays([pa.array(a[cuts[:-1]].astype(np.int32)), _packed(key & 0xFFFFFFFF, np.int32, cuts), _packed(n, np.int64, cuts)], ["a", "b", "n"])


_STREAM = ("a", "row", "b", "n", "text", "times")


def _contribute(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_best and count_sum of documents, from a stream in order of range, part and A id, with an id's counts before its postings."""
    found, held, now, known = [], 0, None, None
    for batch in rows:
        for a, row, b, n, text, times in zip(*(batch.column(i).to_pylist() for i in range(len(_STREAM)))):
            if n is not None:
                part = np.frombuffer(b, np.int32), np.frombuffer(n, np.int64)
                if a != now:
                    now, known = a, []
                known.append(part)
                continue
            if isinstance(known, list):
                known = _summed(np.concatenate([x for x, _ in known]), np.concatenate([x for _, x in known]))
                best = known[1].max()
            other = np.frombuffer(b, np.int32)
            count, times = known[1][np.searchsorted(known[0], other)], np.frombuffer(times, np.int32).astype(np.int64)
            found.append((np.frombuffer(text, np.uint16) + np.int64(row), times * (count == best), times * count))
            held += len(other)
            if held > HELD:
                yield _sums(found)
                found, held = [], 0
    if held:
        yield _sums(found)


def _sums(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(*map(np.concatenate, zip(*found)))], ["row", "n_best", "count_sum"])


def ranges(sizes: list[tuple[int, int]], parts: int, target: int) -> list[tuple[int, int, int]]:
    """(a, range, splits) for each (A id, postings): neighbours share a range of about an even share, and a range is split to the target size."""
    share, out, at, held = max(1, sum(n for _, n in sizes) / parts), {}, 0, 0
    for a, n in sorted(sizes):
        if held and held + n > share:
            at, held = at + 1, 0
        held += n
        out.setdefault(at, []).append((a, n))
    return [(a, k, max(1, -(-sum(n for _, n in ids) // target))) for k, ids in out.items() for a, _ in ids]


def token_links(docs: DataFrame, a: str, b: str, pattern: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the corpus says about the tokens of two vocabulary files: (documents, postings, counts), settled.

    documents holds a row for each row of docs(doc_id, text, ...); postings the links by A id, packed; counts(a, b,
    n) how many documents hold a pair, packed too. See ``alignment`` for what the columns mean.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    made = settle(rows.mapInArrow(partial(_encode, a=a, b=b, pattern=pattern), _ENCODED), "aligned")
    postings = made.where("a is not null").select("a", "row", "size", "b", "text", "times")
    counted = postings.select("a", "b").mapInArrow(_count, "a int, b binary, n binary")
    counts = settle(counted.repartition("a").sortWithinPartitions("a").mapInArrow(_count, "a int, b binary, n binary"), "aligned-counts")
    return made.where("a is null").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), postings, counts


def alignment(docs: DataFrame, a: str, b: str, pattern: str, parts: int = RANGES, target: int = POSTINGS) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Side A encodes a space and the text with the byte-level vocabulary ``a``, side B the text with the sentencepiece
    model ``b``; ``pattern`` cuts words for A. A text that is null or empty, or that the joined bytes of a
    side's tokens differ from, has no tokens: zeros, and an empty digest. Each row counts as one document, so repeated
    rows and rows that share a doc_id or have none count each. n_best counts links whose pair has the highest
    count of its A id (all of them if several do). No rows: no rows. Other columns of docs are not looked at.
    """
    told, postings, counts = token_links(docs, a, b, pattern)
    spark = docs.sparkSession
    sizes = [(r["a"], r["n"]) for r in postings.groupBy("a").agg(F.sum("size").alias("n")).collect()]  # as many rows as A has ids, at most
    dealt = F.broadcast(spark.createDataFrame(ranges(sizes, parts, target), "a int, part int, splits long"))
    one = postings.join(dealt, "a").select("part", F.pmod(F.xxhash64("row"), "splits").alias("split"), F.lit(1).alias("kind"), "a", "row", "b", F.lit(None).cast("binary").alias("n"), "text", "times")
    two = counts.join(dealt, "a").select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)).alias("split"), F.lit(0).alias("kind"), "a", F.lit(0).cast("long").alias("row"), "b", "n", F.lit(None).cast("binary").alias("text"), F.lit(None).cast("binary").alias("times"))
    stream = one.unionByName(two).repartition("part", "split").sortWithinPartitions("part", "split", "a", "kind").select(*_STREAM)
    sums = stream.mapInArrow(_contribute, "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return told.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
