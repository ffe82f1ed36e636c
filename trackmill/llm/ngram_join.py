"""Jaccard self-join of texts on their sets of word n-grams, as a blocked sparse matrix product.

The matrix M has a row for each distinct set and a column for each n-gram; M times its transpose holds the size
of every intersection. It is computed only where it can matter:

* Texts with equal sets are one row.
* A row's rarest columns index it: in one global order of columns, two sets similar enough share one among
  the first ``n - ceil(t n) + 1`` of each. The order is by exact counts over all rows: every entry of M is filed under
  its column's bucket, and what comes back are the columns that several rows hold. A row whose first columns are all its own
  links with nothing. Of a column that very many rows of a batch hold, only their number is filed.
* Rows that share a first column and whose sizes allow a link are joined into clusters, by chains and not by pairs: sorted
  by size, each to the next. A task forwards only the runs of sizes it saw of a column. Rows of different
  clusters can't link.
* A cluster is cut into blocks of bounded size, and blocks are multiplied in tasks over complete rows: overlap
  counts add up column block by column block, and pairs (and pairs of row blocks) are dropped where
  their sizes alone rule a link out. A task emits links that span what it found linked, never all of them.
* Of clusters beyond one block, first each block meets itself and the first block. What is then outside the
  cluster's largest component meets all its blocks. So a large group of near copies costs about its size, and every
  pair that isn't joined by links already is multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import batches, discard, mix, rolling, settle, text_bytes, word_hashes
from trackmill.llm.components import connected_components
from trackmill.llm.substring import _cuts, _packed

SHINGLE, PERCENT = 5, 80
#: Rows of one batch that hold a column, beyond which their number is filed once.
CROWD = 64
#: Packed bytes of text in a slice whose entries are filed together, about.
SLICE_BYTES = 2 << 20
#: Bytes of a column's hash that are filed in its bucket.
FILED = 6
#: Index entries in a bucket, rows and columns' entries of a row block, entries in a task of small clusters: about.
BUCKET_ENTRIES, BLOCK_ROWS, BLOCK_ENTRIES, TASK_ENTRIES = 1_000_000, 1024, 2_000_000, 4_000_000
#: Columns with at most so many rows of a task are counted pair by pair, others as dense tiles of rows and columns.
LIGHT, TILE_ROWS, TILE_COLUMNS = 8, 512, 4096
#: Ids of which a list is broadcast, at most (about 40 bytes each); beyond that both sides are shuffled.
LISTED = 1_000_000
#: Sets that more than one in SHARE rows have get their component by broadcast, so there are at most SHARE of them.
SHARE = 1000


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's distinct word shingles; a shorter text is one, a wordless one has none."""
    words = (text or b"").lower().split()
    return np.unique(rolling(word_hashes(words), min(shingle, len(words)))) if words else np.empty(0, np.uint64)


def _key(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _read(rows: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Of each document its set's key and size, and its text, packed, where the batch holds no earlier one of the set."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches(rows, 4 * SLICE_BYTES):
        keys, sizes, held, seen = [], [], [], set()
        for text in text_bytes(batch.column(2)):
            own = shingles(text, shingle)
            keys.append(_key(own))
            sizes.append(len(own))
            held.append(pack.compress(text) if len(own) and keys[-1] not in seen else None)
            seen.add(keys[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(held, pa.binary())], ["node", "doc_id", "key", "n", "held"])


def _slices(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """First node, distances from it and texts of rows that are near enough to it to be told by four bytes."""
    for batch in batches(rows, SLICE_BYTES):
        node = batch.column(0).to_numpy()
        cuts = _cuts(node >> 31)
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(node[x:y].min()), node[x:y] - node[x:y].min(), batch.column(1).slice(x, y - x).to_pylist()


_FILED = "bucket int, base long, s binary, far binary, n binary"
#: Distance that stands for a crowd of rows.
ALL = (1 << 32) - 1


def _file(rows: Iterator[pa.RecordBatch], shingle: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries of M by bucket of their column. A slice also sends itself (bucket -1) the sizes of its rows and what crowds hold."""
    unpack = zstandard.ZstdDecompressor()
    for base, far, texts in _slices(rows):
        sets = [shingles(unpack.decompress(t), shingle) for t in texts]
        n = np.array([len(x) for x in sets], np.int64)
        s, who = np.concatenate(sets), np.repeat(far.astype(np.uint32), n)
        del texts, sets  # what follows takes some 40 bytes an entry
        bucket = (mix(s) % np.uint64(buckets)).astype(np.int32)
        s &= np.uint64((1 << 8 * FILED) - 1)
        order = np.lexsort((s, bucket))
        s = s[order]
        who = who[order]
        bucket = bucket[order]
        del order
        columns = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (bucket[1:] != bucket[:-1]))).astype(np.int32)
        held = np.diff(np.append(columns, np.int32(len(s))))
        crowd = np.repeat(held > CROWD, held)
        keep = ~crowd
        keep[columns] = True
        out = [(-1, base, b"", far.astype(np.uint32).tobytes(), n.tobytes())]
        if crowd.any():
            out.append((-1, base, _column(s[crowd], bucket[crowd]).tobytes(), who[crowd].tobytes(), b""))
        yield _filed(*zip(*out))
        count = np.repeat(np.where(held > CROWD, held, np.int32(1)), held)[keep]
        who = np.where(crowd, np.uint32(ALL), who)[keep]
        s, bucket = s[keep], bucket[keep]
        del out, columns, held, crowd, keep
        cuts = _cuts(bucket)
        planes = np.empty(FILED * len(s), np.uint8)
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # sorted, so the first bytes of neighbours are alike
            planes[FILED * x : FILED * y].reshape(FILED, -1)[:] = s[x:y].view(np.uint8).reshape(-1, 8)[:, :FILED].T
        del s
        told = bucket[cuts[:-1]]
        yield _filed(told, np.full(len(told), base), _packed(planes, cuts * FILED), _packed(who, cuts), _packed(count, cuts))


def _filed(*columns) -> pa.RecordBatch:
    kinds = pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["bucket", "base", "s", "far", "n"])


def _column(s: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
    """One number for a column: what is filed of its hash, and its bucket."""
    return ((s.astype(np.int64) << 16) | (bucket & 0xFFFF)).astype(np.int64)


_SHARED = "base long, column binary, far binary, n binary"


def _shared(group: pa.Table) -> pa.Table:
    """The entries of one bucket whose column several rows hold, with their number, by slice."""
    bucket = group["bucket"][0].as_py()
    if bucket < 0:
        return pa.table([group["base"], group["s"], group["far"], group["n"]], names=["base", "column", "far", "n"])
    far, n = (np.frombuffer(b"".join(group[c].to_pylist()), t) for c, t in (("far", np.uint32), ("n", np.int32)))
    ends = np.cumsum([len(raw) // FILED for raw in group["s"].to_pylist()])
    s = np.zeros((len(far), 8), np.uint8)
    for end, raw in zip(ends.tolist(), group["s"].to_pylist()):
        s[end - len(raw) // FILED : end, :FILED] = np.frombuffer(raw, np.uint8).reshape(FILED, -1).T
    s = s.view(np.uint64).ravel()
    order = np.argsort(s, kind="stable")
    cuts = _cuts(s[order])
    total = np.repeat(np.add.reduceat(n[order], cuts[:-1], dtype=np.int64), np.diff(cuts))
    order, total = order[total > 1], total[total > 1]
    base = group["base"].to_numpy()[np.searchsorted(ends, order, side="right")]
    back = np.argsort(base, kind="stable")
    order, total, base = order[back], total[back], base[back]
    cuts = _cuts(base)
    return pa.table([pa.array(base[cuts[:-1]]), _packed(_column(s[order], bucket), cuts), _packed(far[order], cuts), _packed(total, cuts)], names=["base", "column", "far", "n"])


def _first(group: pa.Table, percent: int) -> pa.Table:
    """The rows of a slice that share a column among their first ones: node, n, and which of the first columns are shared."""
    base, sizes, crowds, answers = group["base"][0].as_py(), [], [], []
    for column, far, n in zip(*(group[c].to_pylist() for c in ("column", "far", "n"))):
        entry = np.frombuffer(column, np.int64), np.frombuffer(far, np.uint32), np.frombuffer(n, np.int64)
        (sizes if not column else crowds if not n else answers).append(entry)
    far, n = sizes[0][1], sizes[0][2]
    column, who, total = (np.concatenate([*(x[i] for x in answers), np.empty(0, np.int64)]).astype(np.int64) for i in range(3))
    whole = who == ALL
    if whole.any():
        known = np.argsort(column[whole])
        names, counts = column[whole][known], total[whole][known]
        inside, holders = (np.concatenate([x[i] for x in crowds]).astype(np.int64) for i in (0, 1))
        column = np.concatenate([column[~whole], inside])
        who = np.concatenate([who[~whole], holders])
        total = np.concatenate([total[~whole], counts[np.searchsorted(names, inside)]])
    order = np.argsort(far)
    far, n = far[order].astype(np.int64), n[order]
    at = np.searchsorted(far, who)
    order = np.lexsort((column, total, at))
    column, at = column[order], at[order]
    shared = np.bincount(at, minlength=len(far))
    taken = n + (-percent * n // 100) + 1 - (n - shared)
    rank = np.arange(len(at)) - (np.cumsum(shared) - shared)[at]
    column, at = column[rank < taken[at]], at[rank < taken[at]]
    cuts = _cuts(at)
    some = at[cuts[:-1]]
    return pa.table([pa.array(far[some] + base), pa.array(n[some].astype(np.int32)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(column))], names=["node", "n", "first"])


_RUNS = "bucket int, s binary, lo binary, more binary, high binary, low binary, a binary, b binary"


def _chained(s: np.ndarray, lo: np.ndarray, hi: np.ndarray, percent: int) -> np.ndarray:
    """Of runs sorted by column and least size: whether each is near enough in size to those before it in its column."""
    same = np.append(False, s[1:] == s[:-1])[: len(s)]
    top = np.maximum.accumulate((np.cumsum(~same) << 33) + hi) & ((1 << 33) - 1)
    return same & (np.append(0, top[:-1])[: len(s)] * 100 >= lo * percent)


def _deal(rows: Iterator[pa.RecordBatch], buckets: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Runs of near sizes of each column, and the chains inside them, packed by bucket of the column."""
    for batch in batches(rows):
        node, n = (batch.column(i).to_numpy() for i in (0, 1))
        sizes = np.diff(np.asarray(batch.column(2).offsets))
        s = batch.column(2).flatten().to_numpy().view(np.uint64)
        node, n = np.repeat(node, sizes), np.repeat(n.astype(np.int64), sizes)
        bucket = (mix(s) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((n, s, bucket))
        s, node, n, bucket = s[order], node[order], n[order], bucket[order]
        if not len(s):
            continue
        chained = _chained(s, n, n, percent)
        begin = np.flatnonzero(~chained)
        end = np.append(begin[1:], len(s)) - 1
        runs = {"s": s[begin].view(np.int64), "lo": n[begin].astype(np.int32), "more": (n[end] - n[begin]).astype(np.int32), "high": (node[begin] >> 33).astype(np.int32), "low": (node[begin] & ((1 << 33) - 1)).astype(np.uint32)}
        cuts = _cuts(bucket[begin])
        told = bucket[begin][cuts[:-1]]
        near = np.flatnonzero(chained)
        where = np.append(np.searchsorted(bucket[near], told), len(near))
        yield pa.RecordBatch.from_arrays([pa.array(told.astype(np.int32)), *(_packed(x, cuts) for x in runs.values()), *(_packed(x, where) for x in (node[near - 1], node[near]))], ["bucket", *runs, "a", "b"])


def _meet(group: pa.Table, percent: int) -> pa.Table:
    """Chains over a bucket's runs, and those inside them."""
    kinds = {"s": np.int64, "lo": np.int32, "more": np.int32, "high": np.int32, "low": np.uint32, "a": np.int64, "b": np.int64}
    s, lo, more, high, low, a, b = (np.frombuffer(b"".join(group[c].to_pylist()), t) for c, t in kinds.items())
    order = np.lexsort((lo, s))
    node = ((high.astype(np.int64) << 33) + low)[order]
    near = np.flatnonzero(_chained(s[order], lo[order].astype(np.int64), (lo.astype(np.int64) + more)[order], percent))
    pairs = np.unique(np.stack([np.concatenate([a, node[near - 1]]), np.concatenate([b, node[near]])], axis=1), axis=0)
    return pa.table([pairs[:, 0], pairs[:, 1]], names=["a", "b"])


def overlaps(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Intersection sizes of rows sorted by size, above the diagonal; zero where sizes rule a link out."""
    rows, n = len(sets), np.array([len(x) for x in sets])
    column, row = np.concatenate(sets), np.repeat(np.arange(rows), n)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    cuts = _cuts(column)
    held = np.repeat(np.diff(cuts), np.diff(cuts))
    counts = np.zeros(rows * rows, np.int64)
    light = (held > 1) & (held <= LIGHT)
    c, r = column[light], row[light]
    for k in range(1, LIGHT):
        both = np.flatnonzero(c[k:] == c[:-k])
        if not len(both):
            break
        counts += np.bincount(r[both] * rows + r[both + k], minlength=rows * rows)
    counts = counts.reshape(rows, rows)
    c, r = column[held > LIGHT], row[held > LIGHT]
    c = np.cumsum(np.append(False, c[1:] != c[:-1])[: len(c)])
    tops = [n[i : i + TILE_ROWS].max() for i in range(0, rows, TILE_ROWS)]
    for at in range(0, c[-1] + 1 if len(c) else 0, TILE_COLUMNS):
        x, y = np.searchsorted(c, [at, at + TILE_COLUMNS])
        tile = np.zeros((rows, TILE_COLUMNS), np.float32)
        tile[r[x:y], c[x:y] - at] = 1
        for i, top in enumerate(tops):
            for j in range(i, len(tops)):
                if top * 100 >= n[j * TILE_ROWS] * percent:
                    one, two = slice(i * TILE_ROWS, (i + 1) * TILE_ROWS), slice(j * TILE_ROWS, (j + 1) * TILE_ROWS)
                    counts[one, two] += (tile[one] @ tile[two].T).astype(np.int64)
    counts[n[:, None] * 100 < n[None, :] * percent] = 0
    return np.triu(counts, 1)


def _spanned(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what a symmetric matrix of links does."""
    out, seen = [], np.zeros(len(linked), bool)
    for root in range(len(linked)):
        front = [] if seen[root] else [root]
        seen[root] = True
        while front:
            one = front.pop()
            new = np.flatnonzero(linked[one] & ~seen)
            seen[new] = True
            out += [(one, two) for two in new.tolist()]
            front += new.tolist()
    return out


def _product(nodes: np.ndarray, sides: np.ndarray, texts: list[bytes], shingle: int, percent: int) -> list[tuple[int, int]]:
    """Spanning links of one task of a cluster; two rows of side 1 don't meet here."""
    first = np.lexsort((sides, nodes))
    first = first[np.append(True, nodes[first][1:] != nodes[first][:-1])]
    unpack = zstandard.ZstdDecompressor()
    sets = [shingles(unpack.decompress(texts[i]), shingle) for i in first.tolist()]
    order = np.argsort([len(x) for x in sets], kind="stable")
    sets, first = [sets[i] for i in order], first[order]
    n = np.array([len(x) for x in sets])
    linked = overlaps(sets, percent) * (100 + percent) >= (n[:, None] + n[None, :]) * percent
    linked &= np.triu(np.ones_like(linked), 1) & ~((sides[first][:, None] == 1) & (sides[first][None, :] == 1))
    return [(int(nodes[first[i]]), int(nodes[first[j]])) for i, j in _spanned(linked | linked.T)]


def _multiply(group: pa.Table, shingle: int, percent: int) -> pa.Table:
    group = group.sort_by("cluster")
    cuts, out = _cuts(group["cluster"].to_numpy()), []
    node, side, text = group["node"].to_numpy(), group["side"].to_numpy(), group["text"]
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        out += _product(node[x:y], side[x:y], text.slice(x, y - x).to_pylist(), shingle, percent)
    ends = np.array(out, np.int64).reshape(-1, 2)
    return pa.table([ends[:, 0], ends[:, 1]], names=["a", "b"])


def _listed(ids: DataFrame) -> DataFrame:
    """A settled list, to be broadcast if its counted size allows."""
    return F.broadcast(ids) if ids.count() <= LISTED else ids


def _clusters(rows: DataFrame, shingle: int, percent: int, more: DataFrame | None = None) -> DataFrame:
    """(node, cluster) of those rows(node, n, held) that can link with another; rows of different clusters can't. Pairs of more(a, b) share a cluster."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, (rows.agg(F.sum("n")).first()[0] or 0) // BUCKET_ENTRIES)
    filed = rows.select("node", "held").mapInArrow(partial(_file, shingle=shingle, buckets=buckets), _FILED)
    home = F.when(F.col("bucket") < 0, F.col("base")).otherwise(-1)
    shared = settle(filed.groupBy("bucket", home).applyInArrow(_shared, _SHARED), "join-shared")
    first = settle(shared.groupBy("base").applyInArrow(lambda group: _first(group, percent), "node long, n int, first array<long>"), "join-first")
    discard(spark, shared)
    buckets = max(parts, (first.agg(F.sum(F.size("first"))).first()[0] or 0) // BUCKET_ENTRIES)
    dealt = first.mapInArrow(partial(_deal, buckets=buckets, percent=percent), _RUNS)
    met = settle(dealt.groupBy("bucket").applyInArrow(lambda group: _meet(group, percent), "a long, b long"), "join-met", free=False)
    found = connected_components(met if more is None else met.unionAll(more))
    for done in (first, met):
        discard(spark, done)
    return settle(found.unionAll(found.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "cluster"), "join-clusters", free=False)


def _gather(rows: DataFrame, members: DataFrame) -> DataFrame:
    """node, cluster, n, blocks of its cluster, text (packed) of each member."""
    sizes = rows.select("node", "n").join(_listed(members), "node")
    size = settle(sizes.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_ENTRIES)).alias("blocks")), "join-sizes", free=False)
    found = rows.select("node", "n", F.col("held").alias("text")).join(_listed(members), "node").join(_listed(size), "cluster")
    return settle(found.select("node", "cluster", "n", "blocks", "text"), "join-texts")


def _verified(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between the nodes of gathered rows that connect what all links would."""
    spark = rows.sparkSession
    block = F.pmod(F.xxhash64("node"), "blocks")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (rows.where("blocks = 1").agg(F.sum("n")).first()[0] or 0) // TASK_ENTRIES)
    held = ["cluster", "node", "text"]
    small = rows.where("blocks = 1").select(F.pmod(F.xxhash64("cluster"), F.lit(tasks)).alias("task"), F.lit(-1).cast("long").alias("other"), *held, F.lit(0).alias("side"))
    large = rows.where("blocks > 1").withColumn("block", block)
    own = large.select(F.col("block").alias("task"), F.lit(0).cast("long").alias("other"), *held, F.lit(0).alias("side"))
    lead = large.where("block = 0").select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1)).alias("task"), F.lit(0).cast("long").alias("other"), *held, F.lit(1).alias("side"))

    def multiplied(dealt: DataFrame) -> DataFrame:
        keys = ["task", "other", F.when(F.col("other") >= 0, F.col("cluster")).otherwise(-1)]
        return dealt.groupBy(*keys).applyInArrow(lambda group: _multiply(group, shingle, percent), "a long, b long")

    links = settle(multiplied(small.unionAll(own).unionAll(lead)), "join-links")
    if large.isEmpty():
        return links
    placed = large.join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    core = placed.groupBy("cluster", "root").agg(F.count_distinct("node").alias("c")).groupBy("cluster").agg(F.max_by("root", F.struct("c", "root")).alias("core"))
    loose = settle(placed.join(core, "cluster").where("root != core").select("node", "cluster", "n", "blocks", "text"), "join-loose")
    parts = loose.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_ENTRIES)).alias("parts"))
    two = loose.join(parts, "cluster").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("task"), F.pmod(F.xxhash64("node"), "parts").alias("other"), *held, F.lit(0).alias("side"))
    all_of = large.join(parts, "cluster").select(F.col("block").alias("task"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"), *held, F.lit(1).alias("side"))
    more = settle(multiplied(two.unionAll(all_of)), "join-more")
    discard(spark, loose)
    return links.unionAll(more)


def similar(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, more: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keys, nodes, links) of docs(doc_id long, text string), all settled.

    keys holds doc_id, key and n (the set's size) of each row; nodes the distinct sets that aren't empty: node,
    key, n, least (doc_id), copies; links pairs (a, b) of nodes with ``100 * intersection >= percent * union``
    that connect all that such pairs do. ``more`` takes rows(node, n, held), a
    row for each such set and its packed text, and gives pairs (a, b) of nodes that are to be multiplied too.
    """
    spark = docs.sparkSession
    numbered = docs.select(F.monotonically_increasing_id().alias("node"), "doc_id", "text")
    read = settle(numbered.mapInArrow(partial(_read, shingle=shingle), "node long, doc_id long, key binary, n int, held binary"), "join-read", free=False)
    keys = read.select("doc_id", "key", "n")
    held = F.when(F.col("held").isNotNull(), F.col("node"))
    nodes = settle(read.where("n > 0").groupBy("key").agg(F.min(held).alias("node"), F.count(held).alias("times"), F.min("doc_id").alias("least"), F.count("*").alias("copies")), "join-nodes")
    later = read.where("held is not null").select("node", "key").join(_listed(nodes.where("times > 1").select("key", F.col("node").alias("first"))), "key").where("node != first").select("node")
    rows = read.where("held is not null").join(_listed(settle(later, "join-later", free=False)), "node", "left_anti").select("node", "n", "held")
    found = _gather(rows, _clusters(rows, shingle, percent, None if more is None else more(rows)))
    links = _verified(found, shingle, percent)
    discard(spark, found)
    return keys, nodes, links


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, n_shingles, component_id.

    A set holds the distinct runs of ``shingle`` words, A-Z lower-cased; fewer words are one run. Texts link when
    ``100 * intersection >= percent * union``; component_id is the least doc_id that links reach. A text that is
    null or has no word has no shingle, links with nothing and is its own component. Repeated rows stay repeated. A row
    without doc_id links others; it gets its component's id (null if that has none). No rows: no rows. Other columns of
    docs are not looked at.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    keys, nodes, links = similar(rows, shingle, percent)
    roots = connected_components(links)
    placed = nodes.join(roots, "node", "left").select("key", "copies", "least", "node", F.col("root").isNotNull().alias("moved"), F.coalesce("root", "node").alias("root"))
    heads = placed.join(roots.select("root").distinct(), "root", "left_semi")
    ids = heads.groupBy("root").agg(F.min("least").alias("id"))
    labelled = settle(placed.join(ids, "root", "left").select("key", "copies", F.coalesce("id", "least").alias("component_id")), "join-labels")
    usual = F.broadcast(labelled.where(F.col("copies") * SHARE > keys.count()).drop("copies"))
    worded = keys.where("n > 0")
    found = worded.join(usual, "key").unionByName(worded.join(usual, "key", "left_anti").join(labelled.drop("copies"), "key"))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").unionAll(keys.where("n = 0").select("doc_id", F.lit(0).cast("long"), F.col("doc_id")))
