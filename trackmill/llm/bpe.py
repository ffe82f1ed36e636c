"""Byte-level BPE encoding and decoding with a file of ranked merges.

``encode_words`` is the fold as Spark higher-order functions over the byte arrays of distinct
words, with the ranks as one literal (an array of small maps, found by a hash of the key, since a
single map literal is searched from end to end). ``encode`` applies the same fold to documents.
There the distinct words are those that a Python worker has met so far, in a table of bounded
size: joining every word of every document with a dictionary of all distinct words would shuffle
several times the input. The words of a batch that are new are folded together, one merge of each word at a time,
over arrays of words of about one length.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import sys
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import batches

#: Words that a worker keeps encoded, how many of them from one task to the next, and the longest word that is kept.
KNOWN_WORDS, LEFT_WORDS, KNOWN_LENGTH = 250_000, 50_000, 64
#: Bytes of text that are encoded together, about.
SLICE_BYTES = 1 << 20
#: Longer words are merged with a heap.
SHORT = 128
#: Symbols of the words that are folded together, about.
FOLDED = 1 << 18
RANK_BUCKETS = 4096
NEVER = 1 << 60
NO_RANK = np.iinfo(np.int32).max
# The code points of Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def splitter(pattern: str) -> regex.Pattern:
    r"""``pattern`` with \s written out as Unicode's White_Space; a plain form of it would also take 1C-1F."""
    return regex.compile(re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\s", WHITE_SPACE), pattern).replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]"))


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one word: the lowest-ranked pair of neighbours merges, the leftmost first, until none can."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > SHORT:
        return _merge_long(word, ranks)
    rank = ranks.get
    cuts = list(range(len(word) + 1))
    pairs = [rank(word[i : i + 2], NEVER) for i in range(len(word) - 1)]
    while pairs and (best := min(pairs)) < NEVER:
        at = pairs.index(best)
        del cuts[at + 1], pairs[at]
        if at < len(pairs):
            pairs[at] = rank(word[cuts[at] : cuts[at + 2]], NEVER)
        if at:
            pairs[at - 1] = rank(word[cuts[at - 1] : cuts[at + 1]], NEVER)
    return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in O(n log n): a heap of (rank, start, end) whose stale entries are skipped."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or after[j] != end:
            continue
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:end])) is not None:
            heapq.heappush(heap, (r, h, end))
    return [ranks[word[i : after[i]]] for i in range(n) if alive[i]]


class Merges:
    """The rank of every pair of tokens that together are one, in a hash table with open addresses."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        pairs = [(a, b, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        bits = max(4, (4 * len(rank)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.found = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_RANK, np.int32)
        keys = left << 32 | right
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.found[slot[placed]] = rank[placed]
            keys, rank, slot = keys[~placed], rank[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens; NO_RANK where they aren't one."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        out = self.found[slot]
        held = self.keys[slot]
        todo = np.flatnonzero((held != keys) & (held >= 0))
        out[(held != keys) & (held < 0)] = NO_RANK
        while len(todo):
            at = slot[todo] = (slot[todo] + 1) & self.mask
            held = self.keys[at]
            out[todo] = np.where(held == keys[todo], self.found[at], NO_RANK)
            todo = todo[(held != keys[todo]) & (held >= 0)]
        return out

    def fold(self, words: list[bytes]) -> list[bytes]:
        """What ``merge`` gives for each word, as int32."""
        ranks, lengths = self.ranks, np.fromiter(map(len, words), np.int64, len(words))
        out = [b"" if (rank := ranks.get(word)) is None else rank.to_bytes(4, sys.byteorder) for word in words]
        for i in np.flatnonzero(lengths > SHORT).tolist():
            out[i] = out[i] or np.array(_merge_long(words[i], ranks), np.int32).tobytes()
        rest = np.array([i for i, found in enumerate(out) if not found and words[i]], np.int64)
        rest = rest[np.argsort(lengths[rest], kind="stable")]
        data = np.frombuffer(b"".join(words) + bytes(SHORT), np.uint8)
        starts = np.cumsum(lengths) - lengths
        while len(rest):
            width = int(lengths[rest[0]])
            some = rest[: FOLDED // width]
            some = some[lengths[some] <= 2 * width]
            rest = rest[len(some) :]
            self._fold(data, starts[some], lengths[some], some, out)
        return out

    def _fold(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, own: np.ndarray, out: list[bytes]) -> None:
        """Folds some words of data, a row each: symbols, and the rank of each with its right neighbour. Rows close up after a merge."""
        columns = np.arange(int(sizes.max()))
        past = columns >= sizes[:, None]
        symbols = self.bytes[data[starts[:, None] + columns]]
        if (symbols[~past] < 0).any():
            raise KeyError("a byte that is no token")
        ranks = np.full(symbols.shape, NO_RANK, np.int32)
        pairs = np.nonzero(~past[:, 1:])
        ranks[pairs] = self.look_up(symbols[pairs], symbols[:, 1:][pairs])
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(own)), at]
            ended = best == NO_RANK
            if ended.any():
                done, step = symbols[ended].tobytes(), 4 * symbols.shape[1]
                for k, (i, n) in enumerate(zip(own[ended].tolist(), sizes[ended].tolist(), strict=True)):
                    out[i] = done[k * step : k * step + 4 * n]
                own, sizes, symbols, ranks, at, best = (x[~ended] for x in (own, sizes, symbols, ranks, at, best))
            if not len(own):
                return
            symbols, ranks, sizes = _without(symbols, at + 1), _without(ranks, at), sizes - 1
            symbols[np.arange(len(own)), at] = best
            for first in (at - 1, at):
                there = np.flatnonzero((first >= 0) & (first + 1 < sizes))
                x = first[there]
                ranks[there, x] = self.look_up(symbols[there, x], symbols[there, x + 1])


def _without(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of an array without one element each."""
    keep = np.ones(rows.shape, bool)
    keep[np.arange(len(rows)), at] = False
    return rows[keep].reshape(len(rows), -1)


class Encoder(dict):
    """Word to its ids (int32), filled as words are met and emptied when it is full."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.merges = Merges(self.ranks)
        self.split = splitter(pattern).findall
        tokens = {rank: token for token, rank in self.ranks.items()}
        self.lengths = np.zeros(max(tokens, default=0) + 1, np.int32)
        self.lengths[list(tokens)] = list(map(len, tokens.values()))
        self.starts = (np.cumsum(self.lengths) - self.lengths).astype(np.int32)
        self.spelled = np.frombuffer(b"".join([tokens[r] for r in sorted(tokens)]), np.uint8)

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens' bytes in order, and where each token's end."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes, dtype=np.int32)
        where = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        where += np.arange(len(where), dtype=np.int32)
        return self.spelled[where], ends

    def decode(self, ids) -> bytes:
        return self.decode_all(np.array(ids, np.int32))[0].tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids (int32) of each text; the words that are new to the table are folded together."""
        split = list(map(self.split, texts))
        new = list(set(chain.from_iterable(split)) - self.keys())
        self.update(zip(new, self.merges.fold([w.encode() for w in new]), strict=True))
        out = [b"".join(map(self.__getitem__, words)) for words in split]
        if len(self) > KNOWN_WORDS:
            self.clear()
        else:
            for word in new:
                if len(word) > KNOWN_LENGTH:
                    del self[word]
        return out

    def encode(self, text: str) -> tuple[np.ndarray, bytes]:
        ids = np.frombuffer(self.encode_all([text])[0], np.int32)
        return ids, self.decode(ids)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """This process's encoder for a file of ranks."""
    key = path, pattern
    if key not in _encoders:
        _encoders[key] = Encoder(path, pattern)
    return _encoders[key]


def _encode(rows: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = encoder(path, pattern)
    for batch in batches(rows, SLICE_BYTES):
        found = own.encode_all([t or "" for t in batch.column(1).to_pylist()])
        ids = np.frombuffer(b"".join(found), np.int32)
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
        decoded, ends = own.decode_all(ids)
        cuts = np.concatenate(([0], ends)).astype(np.int32)[offsets]
        texts = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(cuts), pa.py_buffer(decoded)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), texts], ["doc_id", "ids", "decoded"])
    if len(own) > LEFT_WORDS:  # what this process runs next may be another operator
        own.clear()


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>, decoded binary (the bytes that ids stand for), one row per row of docs.

    A null or empty text has no ids. Ids don't depend on doc_id, which may be null or repeat.
    ``ranks_path`` must be readable on every executor, as an installed package's file is.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_encode, path=ranks_path, pattern=pattern), "doc_id long, ids array<int>, decoded binary")


def rank_literal(ranks: dict[bytes, int], buckets: int = RANK_BUCKETS) -> Column:
    """The ranks as a literal: bucket of the key's XXH64, then the key (bytes as ISO-8859-1 characters)."""
    maps: list[dict[str, int]] = [{} for _ in range(buckets)]
    for token, rank in ranks.items():
        key = token.decode("latin-1")
        maps[xxhash.xxh64_intdigest(key.encode(), 42) % buckets][key] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(word, ids array<int>) of the distinct values of ``words(word string)``, by higher-order functions only.

    Null words are left out; the empty word has no ids.
    """
    table = rank_literal(ranks)

    def bucket(key: Column) -> Column:
        return F.get(table, F.pmod(F.xxhash64(key), F.lit(RANK_BUCKETS)).cast("int"))

    def rank(key: Column) -> Column:
        return F.try_element_at(bucket(key), key)

    def step(parts: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: rank(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))))

        def merged(scores: Column) -> Column:
            at = F.array_position(scores, F.array_min(scores)).cast("int")
            one = F.array(F.concat(F.element_at(parts, at), F.element_at(parts, at + 1)))
            return F.concat(F.slice(parts, F.lit(1), at - 1), one, F.slice(parts, at + 2, F.size(parts)))

        found = F.get(F.transform(F.array(pairs), lambda s: F.when(F.array_min(s).isNull(), parts).otherwise(merged(s))), F.lit(0))
        return F.when(F.size(parts) < 2, parts).otherwise(found)

    raw = F.decode(F.encode("word", "UTF-8"), "ISO-8859-1")
    parts = F.filter(F.split(raw, ""), lambda x: x != "")
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(raw), F.lit(1))), parts, step)
    whole = F.when(rank(raw).isNotNull(), F.array(raw)).otherwise(folded)
    return words.where("word is not null").select("word").distinct().select("word", F.transform(whole, rank).alias("ids"))
