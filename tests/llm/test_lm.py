import math
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from trackmill.llm import lm


def words(text):
    return [*(text or "").encode().lower().split(), lm.END]


def base(rows):
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    c = Counter(w for d, t in rows if not held[d] for w in words(t))
    norm = math.log10(sum(c.values()) + 0.5 * (len(c) + 1))
    return {d: (held[d], len(words(t)), sum(w in c for w in words(t)), sum(c.values()), sum(math.log10(c[w] + 0.5) - norm for w in words(t))) for d, t in rows}


@pytest.fixture(scope="module")
def scored(docs):
    return lm.score(docs).collect()


def test_base_score_equals_brute_force(scored, rows):
    want = base(rows)
    assert len(scored) == len(want)
    for r in scored:
        held, n, known, total, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9)


def test_the_model_beats_unigrams_on_held_out_texts(scored):
    held = [r for r in scored if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def scrambled(x):
    """The 64-bit mixing of lm's features, one number at a time."""
    full = (1 << 64) - 1
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ x >> shift) * factor) & full
    return x ^ x >> 31


def spelling(word):
    last, before = word[-1], word[-2] if len(word) > 1 else ord(" ")
    return (((last * 31 + before * 131) * 2654435761) % (1 << 32) >> 16) % lm.SPELLED


def test_scores_equal_a_token_by_token_twin(docs, rows, monkeypatch):
    """Class by the softmax over the weights of a token's features, then the word's share of its class."""
    kept = {}

    def train(*args, real=lm.train):
        kept["model"] = real(*args)
        return kept["model"]

    monkeypatch.setattr(lm, "train", train)
    got = {r.doc_id: r.score for r in lm.score(docs).collect()}
    weights = kept["model"].weights.astype(float)
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    counts = Counter(w for d, t in rows if not held[d] for w in words(t))
    code = {w: xxhash.xxh3_64_intdigest(w) for _, t in rows for w in words(t)}
    signed = lambda w: code[w] - (1 << 64) if code[w] >> 63 else code[w]
    singles = sorted(counts, key=lambda w: (-counts[w], signed(w)))[: lm.SINGLES]
    where = {w: i for i, w in enumerate(singles)}
    of = lambda w: where.get(w, lm.SINGLES + spelling(w))
    tokens_in, words_in = Counter(), Counter()
    for w, c in counts.items():
        tokens_in[of(w)] += c
        words_in[of(w)] += 1
    full, rest = (1 << 64) - 1, lm.FEATURES - 1
    for d, t in rows[:60]:
        total, before = 0.0, [code[lm.END]] * 2
        for w in words(t):
            two, one = before
            found = [0, 1 + scrambled(one) % rest, 1 + scrambled((one * 3 + scrambled(two)) & full) % rest, 1 + scrambled(two ^ 0x5BD1E995) % rest]
            logits = sum(weights[f] for f in found)
            total += (logits[of(w)] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()) / math.log(10)
            total += math.log10((counts[w] + 0.5) / (tokens_in[of(w)] + 0.5 * (words_in[of(w)] + 1)))
            before = [one, code[w]]
        assert got[d] == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_rare_words_meet_their_counts_in_buckets(docs, rows, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 40)
    want = base(rows)
    for r in lm.score(docs, rounds=1).collect():
        assert (r.n_known, pytest.approx(r.base_score, rel=1e-9)) == (want[r.doc_id][2], want[r.doc_id][4])


def test_the_model_is_a_distribution():
    h, s, n = lm.tokens([b"a b c a b", b"a a d", None])
    found, at, counts = np.unique(h, return_index=True, return_counts=True)
    order = np.argsort(-counts)
    tokens_in, words_in = np.zeros(lm.SPELLED), np.zeros(lm.SPELLED)
    np.add.at(tokens_in, s[at], counts)
    np.add.at(words_in, s[at], 1)
    model = lm.Model(int(counts.sum()), len(found), found[order], counts[order].astype(float), s[at][order].astype(int), tokens_in, words_in)
    f, c = lm.features(h, n), model.classes(h, s)
    p = model.class_shares(f)
    assert np.allclose(p.sum(axis=1), 1)
    assert np.allclose(model.class_logs(f, c), np.log(p[np.arange(len(c)), c]), atol=1e-5)
    inside = np.zeros(lm.CLASSES)
    classes = model.classes(found, s[at])
    np.add.at(inside, classes, 10 ** (np.log10(counts + 0.5) - model.inside[classes]))
    assert (inside <= 1 + 1e-9).all()


def test_feature_slots_follow_the_training_tokens(docs, monkeypatch):
    """A model of more tokens has more slots, and all of them are reached."""
    kept = []
    monkeypatch.setattr(lm, "FEATURES", 64)
    monkeypatch.setattr(lm, "train", lambda *args, real=lm.train: kept.append(real(*args)) or kept[-1])
    for part in (docs.where("doc_id % 4 = 0"), docs):
        assert lm.score(part).count() == part.count()
    few, all_of = kept
    assert 64 < len(few.weights) < len(all_of.weights)
    for model in kept:
        assert len(model.weights) == pytest.approx(lm.GROWTH * model.total**0.5, abs=lm.BLOCK)
        assert np.abs(model.weights[1:]).max(axis=1).astype(bool).mean() > 0.9


def test_sums_of_a_part_equal_plain_sums():
    """Observed and expected counts of each feature and class, block by block, only of blocks that were met."""
    texts = ["a b c a b", "a a d", None]
    h, s, n = lm.tokens([t and t.encode() for t in texts])
    found, at, counts = np.unique(h, return_index=True, return_counts=True)
    order = np.argsort(-counts)
    tokens_in, words_in = (np.bincount(s[at], w, lm.SPELLED) for w in (counts, None))
    model = lm.Model(int(counts.sum()), len(found), found[order], counts[order].astype(float), s[at][order].astype(int), tokens_in, words_in, 4096)
    f, c = model.features(h, n), model.classes(h, s)
    observed, expected = np.zeros((4096, lm.CLASSES)), np.zeros((4096, lm.CLASSES))
    for token, share in enumerate(model.class_shares(f)):
        for slot in (0, *f[token]):
            observed[slot, c[token]] += 1
            expected[slot] += share
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    (sums,) = lm._gradient(iter([batch]), SimpleNamespace(value=model))
    assert sums.num_rows < 4096 // lm.BLOCK
    for block, *parts in zip(*sums.to_pydict().values(), strict=True):
        for part, want in zip(parts, (observed, expected), strict=True):
            rows = slice(block * lm.BLOCK, (block + 1) * lm.BLOCK)
            assert np.allclose(np.frombuffer(part, np.float32).reshape(-1, lm.CLASSES), want[rows], atol=1e-5)
            want[rows] = 0
    assert not observed.any() and not expected.any()


def test_odd_rows(odd, empty):
    found = lm.score(odd).collect()
    assert len(found) == odd.count()
    assert all(math.isfinite(r.score) for r in found)
    assert {r.n_tokens for r in found if r.doc_id in (2, 3, 5)} == {1}
    assert lm.score(empty).collect() == []
