import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trackmill.llm import records

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_equals_the_library(docs, rows):
    found = records.digests(records.record_round_trip(docs, PATH)).collect()
    assert sorted(map(tuple, found)) == brute(rows)


def test_odd_rows(odd, empty):
    found = records.digests(records.record_round_trip(odd, PATH)).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert len(found) == len(rows) and sum(r.n_tokens for r in found) == sum(r[2] for r in brute(rows))
    assert sorted(r.start for r in found)[0] == 0
    assert records.record_round_trip(empty, PATH).collect() == []


def test_frames_survive_and_damage_shows():
    ids = np.array([1, 2, 70_000], np.uint32)
    data = records.frame(5, ids) + records.frame(None, ids[:2])
    doc_id, got, at = records.unframe(data, 0)
    assert (doc_id, got.tolist()) == (5, ids.tolist())
    assert records.unframe(data, at)[0] is None
    for i in (0, 9, 14, len(data) - 1):
        bad = bytearray(data)
        bad[i] ^= 1
        with pytest.raises((ValueError, OverflowError)):
            records.unframe(bytes(bad), 0)
            records.unframe(bytes(bad), at)


def test_cutting_texts_here_changes_nothing():
    import random

    random.seed(2)
    own = records.words_of(PATH)
    plain, odd = "aéÉ ß\n\t's12²_#'reſŉĲ¼ªº«»·÷×ĿıŸÞÐ'LL'dDµ", "aéÉ ß\n\t’'s12²٣中\x85 \x1c😀ʰ_#'reΣİ<|endoftext|>ſŉĲ\xad\xa0'LL'd"
    texts = ["".join(random.choice(odd if i % 2 else plain) for _ in range(random.randrange(60))) for i in range(3000)] + ["Don't", "L'été", "ΑΣ", "é", "~" * 70]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_what_the_library_makes_of_them(spark):
    texts = ["x<|endoftext|>y", "<|startoftext|>", "a <|ENDOFTEXT|> b", "<|endoftext|", None, "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = records.record_round_trip(docs, PATH).collect()
    assert {r.doc_id: r.ids for r in found}[0] == [343, 49407, 344, 1]
    assert sorted(map(tuple, records.digests(records.record_round_trip(docs, PATH)).collect())) == brute(list(enumerate(texts)))


def test_another_tokenizer_file_keeps_its_own_cuts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Some Text  with  Spaces\n\tand CAPS", "x<|endoftext|>y", "", "naïve 12 don't"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenizer = Tokenizer.from_file(path)
    got = {r.doc_id: r.ids for r in records.record_round_trip(docs, path, end_id=50256).collect()}
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 50256] for i, t in enumerate(texts)}


def test_rows_of_one_doc_id_have_one_order(spark):
    rows = [(1, f"text {i % 7} {i}") for i in range(60)] + [(None, "a b"), (None, "c d e"), (2, "z")]
    docs = [spark.createDataFrame(r, "doc_id long, text string").repartition(n) for r, n in ((rows, 3), (rows[::-1], 5))]
    one, two = (sorted((r.start, r.doc_id or -1, r.ids) for r in records.record_round_trip(d, PATH).collect()) for d in docs)
    assert one == two


def test_full_tables_change_nothing(monkeypatch, rows):
    monkeypatch.setattr(records, "KNOWN_WORDS", 50)
    own = records.Words(PATH)
    for _, text in rows[:40]:
        assert own.encode([text])[0].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
