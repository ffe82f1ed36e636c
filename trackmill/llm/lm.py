"""Language-model scoring with a hashed maximum-entropy model.

P(word | text so far) = P(class | features) * P(word | class). The class softmax has one weight for
each pair of a hashed feature and a class; the features are a bias, the word before, the two words
before as a pair, and the word before the last as a skip. The softmax inside a class has one weight
for each word, whose maximum-likelihood value is known: the log of its count. Classes are the most
frequent words, each alone, and the other words by the last two bytes of their spelling.

Counts come from every training document. The class weights are trained by distributed gradient
updates: in each round every partition sums observed and expected feature counts over its part of
that round's documents, the sums are added block by block while they stream past, and the weights
move along their difference, scaled by the expected count of each weight. Every training
document is in one round. The feature slots follow the square root of the training tokens; a partition sends
only the blocks of slots that it met, and there are no more partitions than cores.

Scoring needs the count of each word of each text. Frequent words, a table of bounded size, are
looked up in place. The others meet their counts in buckets by hash, as packed arrays with one
entry for each pair of a document and a word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import batches, crc32_of_id, mix, settle, text_bytes, word_hashes

#: The end of a text, a token that no word equals.
END = b"\n"
END_HASH = np.uint64(xxhash.xxh3_64_intdigest(END))
SINGLES, SPELLED = 31, 33
CLASSES = SINGLES + SPELLED
#: Hashed features, at least; feature 0 is the bias. A model has GROWTH for each root of its training tokens.
FEATURES, GROWTH = 1 << 15, 8
ROUNDS = 3
#: Words that are looked up in place, at most.
FREQUENT = 1 << 16
BUCKET_PAIRS = 2_000_000
#: Features in a block of sums; tokens that are scored, and whose shares are added up, at once.
BLOCK, CHUNK = 16, 1 << 13
#: Scores below this can't overflow a float's exponential.
TAME = 60.0
#: Weight of a step, and what is added to an expected count.
RATE, SMOOTH = 0.6, 2.0


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts in order, their spelling class, and the number of tokens of each text."""
    split = [(t or b"").lower().split() for t in texts]
    sizes = np.array([len(w) + 1 for w in split], np.int64)
    words = [w for part in split for w in (*part, END)]
    hashes = word_hashes(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    last, before = data[ends - 1].astype(np.uint32), data[ends - 2].astype(np.uint32)
    spelled = (last * np.uint32(31) + before * np.uint32(131)) * np.uint32(2654435761) >> np.uint32(16)
    return hashes, (spelled % np.uint32(SPELLED)).astype(np.int16), sizes


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, 6 << 20):
        hashes, spelled, _ = tokens(text_bytes(batch.column(0)))
        found, at, counts = np.unique(hashes, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(spelled[at]), pa.array(counts)], ["h", "spelled", "c"])


class Model:
    """What scoring needs besides the counts of rare words."""

    def __init__(self, total: int, distinct: int, frequent: np.ndarray, counts: np.ndarray, spelled: np.ndarray, class_tokens: np.ndarray, class_words: np.ndarray, slots: int | None = None) -> None:
        """frequent: hashes by falling count. class_tokens and class_words: of the spelling classes over all words. slots: FEATURES unless given."""
        self.total, self.distinct = total, distinct
        order = np.argsort(frequent)
        self.known, self.known_counts = frequent[order], counts[order]
        n = min(SINGLES, len(frequent))
        self.singles = frequent[:n][np.argsort(frequent[:n])]
        self.single_class = np.argsort(frequent[:n]).astype(np.int16)
        tokens_in, words_in = np.zeros(CLASSES), np.zeros(CLASSES)
        tokens_in[:n], words_in[:n] = counts[:n], 1
        tokens_in[SINGLES:], words_in[SINGLES:] = class_tokens, class_words
        np.subtract.at(tokens_in, SINGLES + spelled[:n], counts[:n])
        np.subtract.at(words_in, SINGLES + spelled[:n], 1)
        self.inside = np.log10(tokens_in + 0.5 * (words_in + 1))
        self.weights = np.zeros((slots or FEATURES, CLASSES), np.float32)
        self.weights[0] = np.log((tokens_in + 0.5) / (tokens_in + 0.5).sum())
        self.tame = self._is_tame()

    def _is_tame(self) -> bool:
        return float(np.abs(self.weights[0]).max() + 3 * np.abs(self.weights[1:]).max(initial=0)) < TAME

    def features(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return features(hashes, sizes, len(self.weights))

    def classes(self, hashes: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        out = spelled.astype(np.int64) + SINGLES
        if len(self.singles):
            at = np.minimum(np.searchsorted(self.singles, hashes), len(self.singles) - 1)
            hit = self.singles[at] == hashes
            out[hit] = self.single_class[at[hit]]
        return out

    def log_counts(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10(count + 0.5) of the frequent words and whether each is one."""
        if not len(self.known):
            return np.zeros(len(hashes)), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hit = self.known[at] == hashes
        return np.where(hit, np.log10(self.known_counts[at] + 0.5), 0.0), hit

    def logits(self, features: np.ndarray) -> np.ndarray:
        """Scores of all classes for each token, less the greatest where they might overflow."""
        out = self.weights.take(features[:, 0], axis=0)
        more = np.empty_like(out)
        for column in features.T[1:]:
            out += self.weights.take(column, axis=0, out=more, mode="clip")
        out += self.weights[0]
        if not self.tame:
            out -= out.max(axis=1, keepdims=True)
        return out

    def class_shares(self, features: np.ndarray) -> np.ndarray:
        """Probabilities of all classes for each token."""
        p = self.logits(features)
        np.exp(p, out=p)
        p /= (p @ _ONES)[:, None]
        return p

    def class_logs(self, features: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Natural log probability of each token's class."""
        out = np.empty(len(classes))
        for at in range(0, len(classes), CHUNK):
            scores = self.logits(features[at : at + CHUNK])
            own = scores[np.arange(len(scores)), classes[at : at + CHUNK]].astype(np.float64)
            out[at : at + CHUNK] = own - np.log(np.exp(scores, out=scores) @ _ONES)
        return out

    def step(self, changes: Iterable[tuple[int, np.ndarray]]) -> None:
        """Moves weights: of each change those of the features from its first on."""
        for first, change in changes:
            self.weights[first : first + len(change)] += change
        self.tame = self._is_tame()


_ONES = np.ones(CLASSES, np.float32)
_PAIRS = np.arange(CLASSES // 2)


def slots_for(total: int) -> int:
    """Features of a model of so many training tokens: whole blocks, FEATURES at least."""
    return max(FEATURES, int(GROWTH * total**0.5) // BLOCK * BLOCK)


def _add_rows(sums: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds each of rows to the row of sums that at names. Two neighbours go as one complex number, so that half as many are added."""
    where = (at[:, None].astype(np.int64) * len(_PAIRS) + _PAIRS).ravel()
    np.add.at(sums.view(np.complex64).ravel(), where, rows.view(np.complex64).ravel())


def features(hashes: np.ndarray, sizes: np.ndarray, slots: int | None = None) -> np.ndarray:
    """Feature numbers of each token: word before, pair before, skip. Texts begin with END behind them."""
    n = len(hashes)
    starts = np.cumsum(sizes) - sizes
    one, two = np.empty(n, np.uint64), np.empty(n, np.uint64)
    one[1:], two[2:] = hashes[:-1], hashes[:-2]
    one[starts] = END_HASH
    two[starts] = END_HASH
    two[(starts + 1)[sizes > 1]] = END_HASH
    rest = np.uint64((slots or FEATURES) - 1)
    return np.stack([1 + mix(one) % rest, 1 + mix(one * np.uint64(3) + mix(two)) % rest, 1 + mix(two ^ np.uint64(0x5BD1E995)) % rest], axis=1).astype(np.int32)


def _gradient(rows: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    own = model.value
    slots = len(own.weights)
    observed, expected = np.zeros((slots, CLASSES), np.int32), np.zeros((slots, CLASSES))
    met, some = np.zeros((slots, CLASSES), np.float32), False
    for batch in batches(rows, 4 << 20):
        hashes, spelled, sizes = tokens(text_bytes(batch.column(0)))
        classes, found = own.classes(hashes, spelled), own.features(hashes, sizes)
        some |= len(hashes) > 0
        for column in found.T:
            np.add.at(observed.ravel(), column * CLASSES + classes, np.int32(1))
        observed[0] += np.bincount(classes, minlength=CLASSES).astype(np.int32)
        for at in range(0, len(hashes), CHUNK):
            f = found[at : at + CHUNK]
            shares = own.class_shares(f)
            expected[0] += shares.sum(axis=0, dtype=np.float64)
            for column in f.T:
                _add_rows(met, column, shares)
        expected += met
        met[:] = 0
    if some:
        blocks = [b for b in range(slots // BLOCK) if expected[b * BLOCK : (b + 1) * BLOCK].any()]
        kinds = [pa.array([part[b * BLOCK : (b + 1) * BLOCK].astype(np.float32).tobytes() for b in blocks], pa.binary()) for part in (observed, expected)]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), *kinds], ["block", "observed", "expected"])


def _add_blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of the weights of the blocks of one partition, from one running sum for each block."""
    sums: dict[int, np.ndarray] = {}
    for batch in rows:
        for block, *parts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            both = np.stack([np.frombuffer(p, np.float32) for p in parts]).astype(np.float64)
            sums[block] = sums[block] + both if block in sums else both
    if sums:
        changes = [RATE * np.clip((observed - expected) / (expected + SMOOTH), -1, 3) for observed, expected in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.astype(np.float32).tobytes() for c in changes], pa.binary())], ["block", "change"])


_BLOCKS = "block int, observed binary, expected binary"


def word_counts(rows: DataFrame) -> DataFrame:
    """(h, spelled, c): count of every distinct token of rows(text)."""
    return rows.select("text").mapInArrow(_count, "h long, spelled short, c long").groupBy("h").agg(F.max("spelled").alias("spelled"), F.sum("c").alias("c"))


def is_held_out(doc_id="doc_id"):
    return F.pmod(crc32_of_id(doc_id), F.lit(5)) == 1


def frequent_from(counts: DataFrame) -> int:
    """A count that at most FREQUENT words reach, from a histogram with a few hundred bins."""
    level = F.floor(F.log2("c") * 8).cast("int")
    bins = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("level")).collect()
    least, seen = 1 << 62, 0
    for r in bins:
        seen += r.n
        if seen > FREQUENT:
            break
        least = r.c
    return least


def train(rows: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> Model:
    """A model from training rows(doc_id, text) and their word_counts."""
    spark = rows.sparkSession
    by = counts.groupBy("spelled").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    class_tokens, class_words = np.zeros(SPELLED), np.zeros(SPELLED)
    for r in by:
        class_tokens[r.spelled], class_words[r.spelled] = r.c, r.n
    top = counts.where(F.col("c") >= frequent_from(counts)).toPandas().sort_values(["c", "h"], ascending=[False, True])
    total = int(class_tokens.sum())
    model = Model(total, int(class_words.sum()), top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.float64), top["spelled"].to_numpy(np.int64), class_tokens, class_words, slots_for(total))
    turn = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("round")), F.lit(rounds))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for i in range(rounds):
        now = spark.sparkContext.broadcast(model)
        own = rows.where(turn == i).select("text").coalesce(spark.sparkContext.defaultParallelism)
        changes = own.mapInArrow(partial(_gradient, model=now), _BLOCKS).repartition(parts, "block").mapInArrow(_add_blocks, "block int, change binary")
        model.step((r.block * BLOCK, np.frombuffer(r.change, np.float32).reshape(-1, CLASSES)) for r in changes.collect())
        now.destroy()
        spark.sparkContext._jvm.System.gc()
    return model


_SCORED = "key long, doc_id long, n_tokens long, bucket int, logs double, n_known long, context double, hashes binary, keys binary, repeats binary"
_PARTIAL = "key long, doc_id long, n_tokens long, logs double, n_known long, context double"


def _scan(rows: Iterator[pa.RecordBatch], model, buckets: int) -> Iterator[pa.RecordBatch]:
    """For each document a row of sums over context and frequent words; for each bucket a row of the rare ones."""
    own = model.value
    key = TaskContext.get().partitionId() << 40
    for batch in batches(rows, 4 << 20):
        hashes, spelled, sizes = tokens(text_bytes(batch.column(1)))
        if not len(sizes):
            continue
        starts = np.cumsum(sizes) - sizes
        classes, found = own.classes(hashes, spelled), own.features(hashes, sizes)
        context = own.class_logs(found, classes) / np.log(10) - own.inside[classes]
        logs, hit = own.log_counts(hashes)
        keys = key + np.arange(len(sizes))
        key += len(sizes)
        docs = [pa.array(keys), batch.column(0), pa.array(sizes), pa.array((mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)), pa.array(np.add.reduceat(logs, starts)), pa.array(np.add.reduceat(hit.astype(np.int64), starts)), pa.array(np.add.reduceat(context, starts))]
        none = pa.nulls(len(keys), pa.binary())
        yield pa.RecordBatch.from_arrays([*docs, none, none, none], _NAMES)
        owner = np.repeat(np.arange(len(sizes)), sizes)[~hit]
        rare = hashes[~hit]
        order = np.lexsort((rare, owner))
        rare, owner = rare[order], owner[order]
        new = np.ones(len(rare), bool)
        new[1:] = (rare[1:] != rare[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        repeats = np.diff(np.append(first, len(rare))).astype(np.uint32)
        rare, owner = rare[first], owner[first]
        bucket = (mix(rare) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, rare, owner, repeats = bucket[order], rare[order], keys[owner[order]], repeats[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, int)
        n = len(cuts) - 1
        if n:
            packed = [pa.array([part[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()) for part in (rare, owner, repeats)]
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64())] * 3 + [pa.array(bucket[cuts[:-1]])] + [pa.nulls(n, pa.float64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), *packed], _NAMES)


_NAMES = ["key", "doc_id", "n_tokens", "bucket", "logs", "n_known", "context", "hashes", "keys", "repeats"]


def _meet(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums of the documents over the words of one bucket, and the documents' own rows passed through."""
    names = [f.split()[0] for f in _PARTIAL.split(", ")]
    docs = rows.filter(rows["key"].is_valid()).select(names)
    words = rows.filter(rows["key"].is_null())
    rare, keys, repeats = (np.frombuffer(b"".join(words[c].to_pylist()), t) for c, t in (("hashes", np.uint64), ("keys", np.int64), ("repeats", np.uint32)))
    if not len(rare):
        return docs
    h, c = counts["h"].to_numpy().view(np.uint64), counts["c"].to_numpy()
    order = np.argsort(h)
    h, c = h[order], c[order]
    have = np.zeros(len(rare), np.int64)
    if len(h):
        at = np.minimum(np.searchsorted(h, rare), len(h) - 1)
        have = np.where(h[at] == rare, c[at], 0)
    order = np.argsort(keys, kind="stable")
    keys, logs, known = keys[order], (repeats * np.log10(have + 0.5))[order], np.where(have > 0, repeats, 0).astype(np.int64)[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1))
    n = len(first)
    part = pa.table([pa.array(keys[first]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.add.reduceat(logs, first)), pa.array(np.add.reduceat(known, first)), pa.nulls(n, pa.float64())], names=names)
    return pa.concat_tables([docs, part])


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row of docs.

    Tokens are the lower-cased words and one end. Learns from rows whose crc32(doc_id as text) mod 5 is
    not 1; a null doc_id counts as the empty text there, a null text as empty. base_score is the
    smoothed unigram log10 probability and score the model's. With nothing to learn from every count is
    zero and both are those of the smoothing alone.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    training = rows.where(~is_held_out())
    counts = settle(word_counts(training), "lm-counts")
    model = train(training, counts, rounds)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, round(size / 12 / BUCKET_PAIRS))
    shared = spark.sparkContext.broadcast(model)
    scanned = rows.mapInArrow(partial(_scan, model=shared, buckets=buckets), _SCORED)
    return _finish(scanned, counts, model, buckets)


def _bucketed(rows: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        h = batch.column(0).to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((mix(h) % np.uint64(buckets)).astype(np.int32))], ["h", "c", "bucket"])


def _finish(scanned: DataFrame, counts: DataFrame, model: Model, buckets: int) -> DataFrame:
    known = counts.select("h", "c").mapInArrow(partial(_bucketed, buckets=buckets), "h long, c long, bucket int")
    partials = scanned.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_meet, _PARTIAL)
    sums = partials.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("logs").alias("logs"), F.sum("n_known").alias("n_known"), F.max("context").alias("context"))
    norm = float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    return sums.where("n_tokens is not null").select("doc_id", is_held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * norm).alias("base_score"), (F.col("logs") + F.col("context")).alias("score"))
