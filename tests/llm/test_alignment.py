import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from trackmill.llm import alignment, queries

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["", None, " ", "a", "a  b\n\tc  ", "<s> </s><unk> x", "<|endoftext|>ab<|endoftext|>", "▁ under", "a▁b", "<0x41>", "ﬁ é ①\x00b", "中文字符測試😀👩‍👩‍👧", "é" * 300, "ab" * 3000, " " * 700, "\n" * 400 + "x", "\x1c\x1d a\x85b c　d᠎", "I'LL don't 'S", "x y​", "the cat", "the cat", "ꙮ" * 200 + "😀" * 100]


@pytest.fixture(scope="module")
def libraries():
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    letters = alignment.byte_alphabet()
    special = {t["content"] for t in json.load(open(A))["added_tokens"]}
    bytes_a = {i: w.encode() if w in special else bytes(letters[c] for c in w) for w, i in one.get_vocab().items()}
    bytes_b = {i: bytes([int(w[3:5], 16)]) if two.is_byte(i) else w.replace("▁", " ").encode() for i, w in ((i, two.id_to_piece(i)) for i in range(two.get_piece_size()))}
    return one, two, bytes_a, bytes_b


def groups_of(text, libraries):
    """A text's groups, token by token: a group ends where the bytes of both sides so far are as many."""
    one, two, bytes_a, bytes_b = libraries
    if not text:
        return []
    a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
    whole = (" " + text).encode()
    if b"".join(bytes_a[i] for i in a) != whole or b"".join(bytes_b[i] for i in b) != whole:
        return []
    out, i, j, x, y, ga, gb = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            x += len(bytes_a[a[i]])
            ga.append(a[i])
            i += 1
        else:
            y += len(bytes_b[b[j]])
            gb.append(b[j])
            j += 1
        if x == y:
            out.append((ga, gb))
            ga, gb = [], []
    return out


def twin(texts, libraries):
    cut = [groups_of(t, libraries) for t in texts]
    count = Counter(p for g in cut for p in {(a, b) for x, y in g for a in x for b in y})
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    for g in cut:
        links = Counter((a, b) for x, y in g for a, m in Counter(x).items() for b, k in Counter(y).items() for _ in range(m * k))
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        yield (sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(links.values()), sum(m for p, m in links.items() if count[p] == best[p[0]]), sum(m * count[p] for p, m in links.items()), hashlib.sha256(text.encode()).hexdigest() if g else "")


def compare(found, data, libraries):
    want = [(i, *t) for (i, _), t in zip(data, twin([t for _, t in data], libraries))]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_ranks_and_pieces_are_the_libraries(libraries):
    """The fast way to A's ids is the library's, and the tables of token bytes are whole."""
    one, two, bytes_a, bytes_b = libraries
    own, other = alignment.sides(A, B, P.PATTERN)[:2]
    assert [bytes_a[i] for i in range(len(own.pieces))] == own.pieces and [bytes_b[i] for i in range(len(other.pieces))] == other.pieces
    draw, signs = random.Random(3), [" ", "  ", "\n", "\t", "a", "The", "é", "中", "😀", "'s", "1", "²", "-", "<|endoftext|>", "̀", "\x85", "‍", "﻿", "\x1f"]
    for _ in range(3000):
        text = "".join(draw.choices(signs, k=draw.randrange(1, 12))) + chr(draw.choice([*range(1, 0xD7FF), *range(0xE000, 0x20000)]))
        assert own.encode(text) == one.encode(text, add_special_tokens=False).ids


def test_against_a_plain_version(spark, rows, libraries):
    data = rows[:120] + [(1000 + k, t) for k, t in enumerate(ODD)] + [(None, "the cat sat"), (7, "repeated row"), (7, "repeated row")]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    compare(alignment.alignment(frame, A, B, P.PATTERN), data, libraries)


def test_small_parts_slices_and_groups(spark, libraries, monkeypatch):
    """Hot ids split over parts, slices of few documents, sums added up early and groups by distinct ids change nothing."""
    data = [(k, t) for k, t in enumerate([*ODD, "the cat " * 40, "the the the", *(f"the {w}" for w in "abcdefghij")] * 2)]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    compare(alignment.alignment(frame, A, B, P.PATTERN, parts=3, target=20), data, libraries)
    sides = alignment.sides(A, B, P.PATTERN)
    texts = [t for _, t in data]
    want = alignment.align(texts, *sides)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 1)
    got = alignment.align(texts, *sides)
    assert got[0][4] == want[0][4] and all((x == y).all() for x, y in zip(got[1], want[1]))
    assert any(len(x) * len(y) > 1 for t in texts for x, y in groups_of(t, libraries))
    monkeypatch.setattr(alignment, "HELD", 7)
    made = list(alignment._encode(iter([pa.RecordBatch.from_pydict({"row": list(range(len(texts))), "doc_id": list(range(len(texts))), "text": texts})]), A, B, P.PATTERN))
    posts = [m.select(["a", "b"]) for m in made if m.num_rows and m.column("a").null_count == 0]
    total = Counter()
    for part in alignment._count(iter(posts)):
        for a, b, n in zip(*(part.column(i).to_pylist() for i in range(3))):
            for x, y in zip(np.frombuffer(b, np.int32).tolist(), np.frombuffer(n, np.int64).tolist()):
                total[a, x] += y
    assert total == Counter(p for t in texts for p in {(a, b) for x, y in groups_of(t, libraries) for a in x for b in y})


def test_ranges_split_what_is_hot():
    found = alignment.ranges([(5, 1000), (1, 10), (2, 10), (9, 10)], 4, 100)
    assert {a: n for a, _, n in found} == {1: 1, 2: 1, 5: 10, 9: 1}
    assert len({r for a, r, _ in found if a in (1, 2)}) == 1 and alignment.ranges([], 4, 100) == []


def test_odd_rows(spark, odd, empty, libraries):
    compare(alignment.alignment(odd, A, B, P.PATTERN), [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], libraries)
    assert alignment.alignment(empty, A, B, P.PATTERN).collect() == []
    found = queries.op13_token_alignment(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
