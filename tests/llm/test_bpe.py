import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from trackmill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_equals_the_library_and_decodes(docs, library):
    for r in docs.join(bpe.encode(docs, PATH, public_tokenizers.PATTERN), "doc_id").collect():
        assert r.ids == library.encode_ordinary(r.text)
        assert bytes(r.decoded) == r.text.encode()


def test_odd_texts(spark, odd, empty, library):
    found = bpe.encode(odd, PATH, public_tokenizers.PATTERN).collect()
    assert len(found) == odd.count()
    assert all(bytes(r.decoded) == library.decode_bytes(r.ids) for r in found)
    assert bpe.encode(empty, PATH, public_tokenizers.PATTERN).collect() == []
    own = bpe.encoder(PATH, public_tokenizers.PATTERN)
    for text in ("", "\x1c a\x85 b", "éʰ²٣中文😀", "<|endoftext|>", "ab" * 3000, " " * 500 + "\n" * 300 + "x", "'S'LL can't"):
        assert own.encode(text)[0].tolist() == library.encode_ordinary(text)


def test_words_folded_together_equal_the_library(docs, library, monkeypatch):
    """Words of all lengths, known tokens, copies and odd characters in one call, in folds of many and of few words."""
    random.seed(5)
    letters = "abcdefghijklmnopqrstuvwxyzé中😀\x00\x1c   019_"
    words = ["", "x", " the", "ab" * 40, "é" * 64, "z" * 129] + ["".join(random.choices(letters, k=random.choice([2, 3, 5, 9, 17, 40, 63, 90, 200]))) for _ in range(3000)]
    words += [w for r in docs.limit(30).collect() for w in bpe.splitter(public_tokenizers.PATTERN).findall(r.text)]
    raw, ranks = [w.encode() for w in words], bpe.read_ranks(PATH)
    want = [library._encode_single_piece(w) if w else [] for w in raw]
    assert [list(memoryview(x).cast("i")) for x in bpe.Merges(ranks).fold(raw)] == want
    monkeypatch.setattr(bpe, "FOLDED", 300)
    assert [list(memoryview(x).cast("i")) for x in bpe.Merges(ranks).fold(raw[:300])] == want[:300]


def test_a_full_table_changes_nothing(docs, library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 50)
    monkeypatch.setattr(bpe, "KNOWN_LENGTH", 3)
    own = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    texts = [r.text for r in docs.limit(20).collect()]
    for part in (texts[:10], texts[5:], texts):
        assert [list(memoryview(ids).cast("i")) for ids in own.encode_all(part)] == library.encode_ordinary_batch(part)
        assert len(own) <= 50


def test_a_task_leaves_few_words_behind(monkeypatch, library):
    """FINDINGS_r03, F1: workers carried the words of their last task into the next operator."""
    own = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    monkeypatch.setitem(bpe._encoders, (PATH, public_tokenizers.PATTERN), own)
    letters = "bcdfghjklmnpqrst"
    texts = [" ".join("".join(letters[n >> k & 15] for k in (0, 4, 8, 12, 16)) for n in range(i, i + 400)) for i in range(0, 80_000, 400)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    for _ in range(2):
        ids = [row for b in bpe._encode(iter([batch]), PATH, public_tokenizers.PATTERN) for row in b.column(1).to_pylist()]
        assert ids == library.encode_ordinary_batch(texts)
        assert len(own) <= 50_000


def test_fold_by_higher_order_functions(spark, docs, library):
    words = sorted({w for r in docs.limit(20).collect() for w in bpe.splitter(public_tokenizers.PATTERN).findall(r.text)})[:150] + ["", "中文😀", "x"]
    found = bpe.encode_words(spark.createDataFrame([(w,) for w in words] + [(None,), ("x",)], "word string"), library._mergeable_ranks).collect()
    assert {r.word: r.ids for r in found} == {w: library.encode_ordinary(w) for w in words}
