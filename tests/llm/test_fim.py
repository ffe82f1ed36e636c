import hashlib
import re

import duckdb
import pytest

from trackmill.llm import fim, queries, sql

# The same grammars as patterns that match whole units.
WHOLE = {
    "line": r"[^\n]*\n|[^\n]+",
    "paragraph": r"(?:(?!\n\n)[\s\S])*\n{2,}|[\s\S]+",
    "sentence": r"(?:(?![.!?][ \n])[\s\S])*[.!?][ \n]|[\s\S]+",
    "word": r"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+",
    "run": r"[^ \t-\r]+|[ \t-\r]+",
    "character": r"[\s\S]",
}
TEXTS = ["", None, "\n", "\n\n\n", "a", "a\n", "\na", "one\ntwo\r\nthree", "a  b\n\n\nc. d! e?f?\n g", "😀é\n中文 <P\n", "x<S>y", "<M>", "a<\nP>\n", "<S\n<S", "tail \n \n", " a\u0085b\x0bc\n", "w " * 5000 + "\n" * 500]


def twin(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(WHOLE["line"], text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, len(units), "plain", None, None, text)
    form = "spm" if h[3] % 100 < spm else "psm"
    return (doc_id, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def full(found):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return [(*r[:5], sha(r[5])) for r in found]


def test_units_of_each_grammar(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for grammar, pattern in WHOLE.items():
        for r in frame.select("t", fim.units(frame["t"], grammar).alias("u")).collect():
            assert r.u == (None if r.t is None else re.findall(pattern, r.t)), (grammar, r.t)


def test_against_a_plain_version(spark, docs, rows):
    data = rows + [(k, t) for k, t in enumerate(TEXTS)] + [(None, "a\nb\nc"), (5, "a\nb"), (5, "a\nb")]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    found = fim.digest(frame).collect()
    key = lambda x: str(x)
    assert sorted([tuple(r)[:6] for r in found], key=key) == sorted(full(twin(*x) for x in data), key=key)
    sha = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in data}
    assert {r.restored_sha256 for r in found} == sha
    made = fim.transform(frame, seed=3, rate=40, spm_rate=10)
    assert sorted([(r.doc_id, r.n, r.form, None if r.prefix is None else len(r.prefix), None if r.middle is None else len(r.middle), r.output) for r in made.collect()], key=key) == sorted((twin(*x, 3, 40, 10) for x in data), key=key)
    for grammar in WHOLE:
        back = fim.restored(fim.transform(frame, grammar=grammar)).select("doc_id", "restored")
        assert sorted([(r.doc_id, r.restored) for r in back.collect()], key=key) == sorted([(i, t or "") for i, t in data], key=key)


def test_odd_rows_and_plan(spark, odd, empty):
    found = fim.digest(odd)
    assert found.count() == odd.count() and fim.digest(empty).collect() == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError, match="grammar"):
        fim.transform(odd, grammar="verse")


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view documents as select * from '{sf}/documents.parquet'")
    want = duckdb.sql(sql.fill_in_middle())
    found = queries.op12_fim(spark, sf)
    assert want.columns == found.columns
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())
