"""Quality classifier from weak labels.

Heuristic labellers look at a text and each votes good, bad or nothing. They overlap and err, so a
latent-class model (Dawid and Skene) estimates by expectation-maximisation how each labeller votes on
good and on bad texts, without any true label. A silent labeller says nothing about a text, so short
texts, on which most are silent, aren't bad for that. It needs only how often each pattern of votes occurs,
a table whose size the number of labellers bounds, counted over all documents. The posterior of a
document's pattern is its label for a linear scorer over hashed words and word shapes, which then
also judges texts on which most labellers are silent. The scorer is fitted on a bounded sample,
about SAMPLE documents chosen by a hash of doc_id; every document is scored over its whole text.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import batches, mix, text_bytes, word_hashes

BAD, GOOD, SILENT = 0, 1, 2
#: Documents that the scorer is fitted on, about.
SAMPLE = 10_000
WORD_SLOTS, SHAPE_SLOTS = 1 << 15, 1 << 11
SLOTS = WORD_SLOTS + SHAPE_SLOTS
EPOCHS, BATCH, RATE, DECAY = 12, 256, 1.0, 1e-5
# Frequent function words of the corpus's languages.
FUNCTION_WORDS = frozenset(b"the of and to in is that it with for on as are this was be by an or at from a de la le et les des en un une du que qui dans pour par el los las y del se por con su al der die das und den von zu mit ist auf im nicht ein eine".split())
_UPPER, _LOWER = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
_SYMBOLS = b"#*$%&|<>~^@{}[]\\"


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else SILENT


def votes(text: bytes, words: list[bytes]) -> list[int]:
    """One vote of each labeller."""
    n = len(words)
    if not n:
        return [BAD] + [SILENT] * (LABELLERS - 1)
    size = len(text)
    letters = sum(map(len, words))
    symbols = size - len(text.translate(None, _SYMBOLS))
    upper, lower = size - len(text.translate(None, _UPPER)), size - len(text.translate(None, _LOWER))
    lines = [x for x in text.split(b"\n") if x.strip()]
    marks = text.count(b"!")
    mean, stuck, distinct = letters / n, sum(map(eq, words, words[1:])) / n, len(set(words)) / n
    common = sum(map(FUNCTION_WORDS.__contains__, words)) / n
    shout, again = upper / max(1, upper + lower), 1 - len(set(lines)) / max(1, len(lines))
    ended = text.count(b".") / n
    return [
        _vote(n < 2, n >= 60),
        _vote(mean > 14 or mean < 2, 3 <= mean <= 9),
        _vote(symbols > 0.05 * letters, symbols * 200 < letters),
        _vote(shout > 0.3, shout < 0.12),
        _vote(marks > 0.1 * n, marks <= 0.02 * n),
        _vote(stuck > 0.15, stuck < 0.02 and n >= 20),
        _vote(n >= 40 and distinct < 0.2, n >= 40 and distinct > 0.35),
        _vote(n >= 20 and common < 0.03, common > 0.12),
        _vote(len(lines) >= 3 and again > 0.3, len(lines) >= 3 and again < 0.1),
        _vote(n >= 30 and ended < 0.005, ended > 0.03),
    ]


LABELLERS = 10
_POWERS = 3 ** np.arange(LABELLERS)


def pattern(text: bytes | None) -> int:
    """A text's votes as one number in base 3."""
    text = text or b""
    return int(np.dot(votes(text, text.split()), _POWERS))


def _patterns(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(3**LABELLERS, np.int64)
    for batch in batches(rows):
        np.add.at(counts, [pattern(t) for t in text_bytes(batch.column(0))], 1)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["pattern", "n"])


class LabelModel:
    """Shares of good and bad texts and each labeller's votes on them, by EM over counted patterns."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> None:
        self.prior = np.array([0.2, 0.8])
        self.rates = np.full((2, LABELLERS, 2), 0.5)
        if not len(patterns):
            return
        cast = patterns[:, None] // _POWERS % 3
        good, bad = (cast == GOOD).sum(axis=1), (cast == BAD).sum(axis=1)
        p = np.clip((good + 1) / (good + 3 * bad + 2), 0.02, 0.98)  # to begin with a bad vote weighs more: labellers find faults
        hot = np.eye(3)[cast][:, :, :2]
        last = -np.inf
        for _ in range(rounds):
            both = np.stack([1 - p, p]) * counts
            self.prior = (both.sum(axis=1) + 1) / (counts.sum() + 2)
            seen = np.einsum("kp,plv->klv", both, hot) + 0.5
            self.rates = seen / seen.sum(axis=2, keepdims=True)
            logs = self._logs(cast)
            top = logs.max(axis=0)
            total = float((counts * (top + np.log(np.exp(logs - top).sum(axis=0)))).sum())
            p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
            if total - last < 1e-6 * abs(total):
                break
            last = total

    def _logs(self, cast: np.ndarray) -> np.ndarray:
        logs = np.concatenate([np.log(self.rates), np.zeros((2, LABELLERS, 1))], axis=2)
        return np.log(self.prior)[:, None] + logs[:, np.arange(LABELLERS), cast].sum(axis=2)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes is good."""
        logs = self._logs(np.asarray(patterns)[:, None] // _POWERS % 3)
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    def accuracies(self) -> np.ndarray:
        """Share of right votes of each labeller when it votes on every text."""
        return self.prior[BAD] * self.rates[0, :, BAD] + self.prior[GOOD] * self.rates[1, :, GOOD]


def slots(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashed features of each word of the texts (its spelling, its shape), and the texts' word counts."""
    split = [(t or b"").split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    words = [w for part in split for w in part]
    if not words:
        return np.empty((0, 2), np.int32), sizes
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b" ".join(words), np.uint8).astype(np.uint64)
    ends = np.cumsum(lengths + 1) - 2
    first, last, middle = data[ends - lengths + 1], data[ends], data[ends - lengths // 2]
    upper = [(x >= 65) & (x <= 90) for x in (first, middle)]
    shape = last * np.uint64(97) + np.minimum(lengths, 15).astype(np.uint64) * np.uint64(7) + upper[0] * np.uint64(3) + upper[1] * np.uint64(5 << 20)
    return np.stack([mix(word_hashes(words)) % np.uint64(WORD_SLOTS), WORD_SLOTS + mix(shape) % np.uint64(SHAPE_SLOTS)], axis=1).astype(np.int32), sizes


def _examples(rows: Iterator[pa.RecordBatch], labels) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, 4 << 20):
        texts = text_bytes(batch.column(1))
        p = labels.value.posterior([pattern(t) for t in texts])
        found, sizes = slots(texts)
        where, values = [], []
        for part in np.split(found, np.cumsum(sizes)[:-1]):
            at, n = np.unique(part, return_counts=True)
            where.append(at.astype(np.int32))
            values.append((n / max(1, len(part))).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(where, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["doc_id", "p", "at", "value"])


def fit(p: np.ndarray, at: list[np.ndarray], value: list[np.ndarray]) -> np.ndarray:
    """Weights of a logistic scorer on soft labels by AdaGrad; the last one is the bias."""
    weights = np.zeros(SLOTS + 1)
    squares = np.full(SLOTS + 1, 1e-8)
    random = np.random.default_rng(0)
    for _ in range(EPOCHS):
        order = random.permutation(len(p))
        for lo in range(0, len(order), BATCH):
            chosen = order[lo : lo + BATCH]
            where, x = np.concatenate([at[i] for i in chosen]), np.concatenate([value[i] for i in chosen])
            row = np.repeat(np.arange(len(chosen)), [len(at[i]) for i in chosen])
            z = np.bincount(row, weights[where] * x, len(chosen)) + weights[-1]
            error = 1 / (1 + np.exp(-z)) - p[chosen]
            gradient = np.append(np.bincount(where, error[row] * x, SLOTS), error.sum()) / len(chosen) + DECAY * weights
            squares += gradient**2
            weights -= RATE * gradient / np.sqrt(squares)
    return weights


class Scorer:
    def __init__(self, labels: LabelModel, weights: np.ndarray) -> None:
        self.labels, self.weights = labels, weights

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Probability that a text is good; 0 for a text without words."""
        found, sizes = slots(texts)
        sums = np.zeros(len(texts))
        full = np.flatnonzero(sizes)
        if len(full):
            sums[full] = np.add.reduceat(self.weights[found].sum(axis=1), (np.cumsum(sizes) - sizes)[full]) / sizes[full]
        return np.where(sizes > 0, 1 / (1 + np.exp(-np.clip(sums + self.weights[-1], -500, 500))), 0.0)


def train(docs: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Label model over all rows of docs(doc_id, text), scorer over about ``sample`` of them."""
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    counts = rows.select("text").mapInArrow(_patterns, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    labels = LabelModel(np.array([r.pattern for r in counts], np.int64), np.array([r.n for r in counts], np.float64))
    total = sum(r.n for r in counts)
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("quality sample")), F.lit(1 << 30))
    chosen = rows.where(place < int(min(1.0, sample / max(1, total)) * (1 << 30)))
    shared = spark.sparkContext.broadcast(labels)
    examples = chosen.mapInArrow(partial(_examples, labels=shared), "doc_id long, p double, at array<int>, value array<float>").toArrow().sort_by("doc_id")
    shared.destroy()
    at, value = (examples[c].combine_chunks() if examples.num_rows else pa.array([], pa.list_(pa.float32())) for c in ("at", "value"))
    cuts = np.asarray(at.offsets)[1:-1] if len(at) else []
    weights = fit(examples["p"].to_numpy(), np.split(at.flatten().to_numpy(), cuts), np.split(value.flatten().to_numpy(), cuts)) if len(at) else np.zeros(SLOTS + 1)
    return Scorer(labels, weights)


def _score(rows: Iterator[pa.RecordBatch], scorer, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, 4 << 20):
        texts = text_bytes(batch.column(1))
        scores = scorer.value.scores(texts)
        p = scorer.value.labels.posterior([pattern(t) for t in texts])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(scores), pa.array(scores >= least)], ["doc_id", "label_p", "score", "kept"])


def classify(docs: DataFrame, least: float = 0.5, scorer: Scorer | None = None) -> DataFrame:
    """doc_id, label_p (posterior of the labellers' votes), score, kept (score >= least), a row for each row of docs.

    A null, empty or wordless text has score 0. With nothing to learn from every score is 0.5.
    """
    scorer = train(docs) if scorer is None else scorer
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(partial(_score, scorer=shared, least=least), "doc_id long, label_p double, score double, kept boolean")
