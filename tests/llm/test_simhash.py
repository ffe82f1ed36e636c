import random

import pytest
import xxhash

from trackmill.llm import simhash
from trackmill.llm.components import connected_components
from trackmill.llm.simhash import near_dedup, simhash_components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [words] if len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(b" ".join(g), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    found = list(range(len(rows)))

    def root(i):
        while found[i] != i:
            i = found[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                found[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted((d, f"{prints[i]:016x}", least[root(i)]) for i, (d, _) in enumerate(rows))


def test_equals_brute_force(docs, rows):
    assert sorted(map(tuple, simhash_components(docs).collect())) == brute(rows)


def print_components(prints, radius=2):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for p in prints:
        groups.setdefault(find(p), set()).add(p)
    return {frozenset(g) for g in groups.values()}


def near_prints():
    """Clusters around centres, many within one segment, and chains of single bits."""
    random.seed(3)
    out = set()
    for _ in range(30):
        centre = random.getrandbits(63)
        for _ in range(12):
            out.add(centre ^ sum(1 << random.randrange(60) for _ in range(random.randrange(1, 5))))
    base = random.getrandbits(63)
    return sorted(out | {base ^ (random.getrandbits(31) & random.getrandbits(31) & random.getrandbits(31)) for _ in range(150)})


@pytest.mark.parametrize("segments", [2, 4, 8])
@pytest.mark.parametrize("full", [500, 3])
def test_links_by_segments_equal_brute_force(spark, monkeypatch, segments, full):
    monkeypatch.setattr(simhash, "FULL", full)
    prints = near_prints()
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), 2, segments).collect()
    assert all((r.a ^ r.b).bit_count() == r.distance <= 2 for r in found)
    near = {(max(a, b), min(a, b)) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 2}
    if full == 500:
        assert {(r.a, r.b) for r in found} == near
    linked = {p: {p} for p in prints}
    for r in found:
        if linked[r.a] is not linked[r.b]:
            both = linked[r.a] | linked[r.b]
            linked.update(dict.fromkeys(both, both))
    assert {frozenset(g) for g in linked.values()} == print_components(prints)


def test_segments_change_the_tables(spark):
    prints = spark.createDataFrame([(7,)], "fp long")
    n = {s: prints.select(simhash._keys(s, 2 // s).alias("k")).first().k for s in (2, 4, 8)}
    assert [len(n[s]) for s in (2, 4, 8)] == [2 * 33, 4, 8] and all(len(set(k)) == len(k) for k in n.values())


def test_rows_without_id_link_others(spark, monkeypatch):
    """Fingerprints 0, 3 (of a row without id) and 15: the one in the middle links both."""
    prints = spark.createDataFrame([(1, 0), (None, 3), (2, 15), (None, 255 << 40), (9, -1)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: prints)
    docs = spark.createDataFrame([(1, "")], "doc_id long, text string")
    got = {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in simhash.simhash_components(docs).collect()}
    assert got == {(1, 0): 1, (None, 3): 1, (2, 15): 1, (None, 255 << 40): None, (9, (1 << 64) - 1): 9}


def test_rows_of_one_doc_id_keep_the_same_one(spark):
    rows = [(1, "a b c d"), (1, "completely other words here"), (2, "a b c d")]
    kept = [{r.text for r in near_dedup(spark.createDataFrame(r, "doc_id long, text string").repartition(n)).collect()} for r, n in ((rows, 1), (rows[::-1], 3))]
    assert kept[0] == kept[1]


def test_odd_rows(odd, empty):
    got = simhash_components(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[2] == by[3] == by[5] == {("0" * 16, 2)}
    assert len(by[1]) == 1 and by[7] == by[1] and by[6] == by[4]
    assert simhash_components(empty).collect() == []


def test_near_dedup_keeps_one_of_each(odd, empty):
    kept = near_dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 2, 4]
    assert near_dedup(empty).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (None, 3)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 50)}
