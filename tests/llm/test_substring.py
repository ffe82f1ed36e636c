import numpy as np

from trackmill.llm.common import rolling
from trackmill.llm.substring import substring_dedup


def brute(rows, width=13):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - width + 1):
                key = tuple(w[i : i + width])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def got(docs):
    return sorted((tuple(r) for r in substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


def test_equals_brute_force(docs, rows):
    found = got(docs)
    assert found == brute(rows)
    assert any(r[2] for r in found)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(odd) == brute(rows)
    assert got(empty) == []


def test_rows_that_share_an_id_and_differ(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(base[:20])), (2, " ".join(base)), (2, " ".join(["x", *base])), (3, " ".join(base[19:]))]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_rolling_depends_on_order_and_width():
    a = np.arange(1, 40, dtype=np.uint64)
    for width in (1, 2, 3, 5, 8, 13):
        assert len(rolling(a, width)) == 40 - width
        assert len(set(rolling(a, width).tolist())) == 40 - width
        assert rolling(a, width)[3] == rolling(a[3 : 3 + width], width)[0]
    assert len(rolling(a, 41)) == 0


def test_answers_hold_word_by_word(docs):
    from trackmill.llm.substring import verify_spans

    found = verify_spans(docs).collect()
    assert found and all(r.same and r.source < r.doc_id for r in found)
