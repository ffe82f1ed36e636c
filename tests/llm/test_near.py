"""Near copies by word shingles against the similarity of every pair."""

import random

import zstandard

import corpus_pipeline as p
from tests.llm.conftest import SCHEMA
from trackmill.llm import near
from trackmill.llm.components import connected_components
from trackmill.llm.simhash import fingerprint


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(rows):
    """The least id of each component over all pairs."""
    sets = {d: grams(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if 5 * len(x & y) >= 4 * len(x | y):
                a_root, b_root = find(a), find(b)
                root[max(a_root, b_root)] = min(a_root, b_root)
    return {find(d) for d in ids}


def test_edited_copies_go(spark):
    """Copies from 0.75 to 0.97 beside a phrase that all texts hold, and chains of edits."""
    random.seed(7)
    phrase = [f"c{i}" for i in range(30)]
    texts = []
    for g in range(40):
        words = [f"w{random.randrange(4000)}" for _ in range(random.randrange(40, 160))]
        texts.append(phrase + words)
        for _ in range(4):
            words = list(words)
            for _ in range(random.randrange(1, 5)):
                words[random.randrange(len(words))] = f"e{random.randrange(10**6)}"
            texts.append(phrase + words)
    random.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    want = kept(rows)
    assert len(want) < len({t for _, t in rows}) and len(want) > 40
    assert {r.doc_id for r in p.simhash_near_dedup(spark, docs, "").collect()} == want


def test_equals_the_similarity_of_every_pair(docs, rows):
    assert {r.doc_id for r in near.near_dedup(docs).collect()} == kept(rows)


def test_near_prints_meet_before_the_check(spark, monkeypatch):
    """The stage searches fingerprints: what lies within two bits meets, as over every pair, and the check decides."""
    random.seed(3)
    texts = []
    for _ in range(30):
        words = [f"w{random.randrange(9000)}" for _ in range(random.randrange(300, 900))]
        for _ in range(4):
            texts.append(" ".join(words))
            words = [*words[:-1], f"e{random.randrange(10**6)}"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    met = []
    monkeypatch.setattr(near, "print_meetings", lambda rows, *more, real=near.print_meetings: met.append((rows.collect(), real(rows, *more))) or met[-1][1])
    assert {r.doc_id for r in p.simhash_near_dedup(spark, docs, "").collect()} == kept(rows)
    ((nodes, pairs),) = met
    prints = {r.node: fingerprint(zstandard.decompress(r.held), near.SHINGLE) for r in nodes}
    close = {(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= near.RADIUS}
    joined = {r.node: r.root for r in connected_components(pairs).collect()}
    root = {n: joined.get(n, n) for n in prints}
    assert len(prints) == len(rows) and len(close) > 30 and all(root[a] == root[b] for a, b in close)
    assert set(root.values()) == kept_by(close, root)


def kept_by(pairs, ids):
    """The least id of each component of pairs."""
    root = {i: i for i in ids}
    for _ in range(9):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return set(root.values())


def test_odd_rows(odd, empty):
    got = near.near_dedup(odd)
    assert got.columns == odd.columns and sorted((r.doc_id or 0) for r in got.collect()) == [0, 0, 1, 2, 4]
    assert near.near_dedup(empty).collect() == []
