import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trackmill.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_features_equal_brute_force(spark, docs, rows, odd):
    extra = ["a b c d e f g h " * 3, "w " * 9, "x\ny\nx\n \n \nx y", "a b c d e f g h i a b c d e f g h"]
    table = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(10_000 + i, t, None) for i, t in enumerate(extra)], "doc_id long, text string, lang string"))
    texts = dict(rows) | {10_000 + i: t for i, t in enumerate(extra)}
    for r in q.features(table).withColumn("failed", q.base_failed()).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.failed) == brute(texts[r.doc_id])
    found = q.features(odd).collect()
    assert len(found) == odd.count()
    assert {r.n_words for r in found if r.doc_id in (2, 3, 5)} == {0}


@pytest.mark.parametrize(("k", "n"), [(0, 10), (3, 1000), (40, 5000), (2, 40_000)])
def test_binomial_sum_is_exact(spark, k, n):
    got = spark.range(1).select(q.binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), 0.01)).first()[0]
    want = 1.0 if k >= n * 0.01 else sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.01) + (n - i) * math.log(0.99)) for i in range(k + 1))
    assert got == pytest.approx(want, rel=1e-9)


def texts(n, noisy, noisier):
    """n texts of 30 words of their own; the first ``noisier`` with many symbols, up to ``noisy`` with some."""
    return [(i, " ".join(f"w{i}x{j}" for j in range(30)) + " " + "#" * (150 if i < noisier else 20 if i < noisy else 0), "en") for i in range(n)]


def test_steps_hold_the_risk_of_all_rules_and_stop_at_the_first_failure(spark):
    docs = spark.createDataFrame(texts(4000, 60, 20), "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(4000)] + [(5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    found = {r: [q.STEPS.index((rule, cut)) for rule, cut in q.STEPS if rule == "symbols" and cut < share][0] for r, share in ((20, 150 / 400), (60, 20 / 190))}
    got = {risk: q.calibrate(q.features(docs), labels, risk, 0.1).first().last for risk in (0.03, 0.01, 0.004)}
    assert got == {0.03: len(q.STEPS) - 1, 0.01: found[60] - 1, 0.004: found[20] - 1}
    assert q.calibrate(q.features(docs), labels.limit(0)).collect() == []


def test_copies_are_one_trial(spark):
    one = texts(1, 0, 0)[0][1]
    docs = spark.createDataFrame([(i, one, "en") for i in range(3000)] + texts(50, 0, 0)[1:], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 as quality")
    assert q.calibrate(q.features(docs), labels, 0.03, 0.1).collect() == []
    assert q.calibrate(q.features(docs), labels, 0.06, 0.1).first().last == len(q.STEPS) - 1


def test_rules_reject_more_than_the_base_does(spark):
    sf = "/root/testdata/sf0.01"
    rows = q.judge(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    lost = [r for r in rows if not r.base_failed and not r.kept]
    assert lost and all(r.broken_rule for r in lost)
    assert sum(r.doc_id in good for r in lost) <= q.RISK * sum(r.doc_id in good for r in rows)


def test_judging_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert q.judge(odd, labels).count() == odd.count()
    assert q.judge(empty, labels).collect() == []
    assert not any(r.kept for r in q.judge(odd, labels.limit(0)).collect() if r.doc_id in (1, 2, 3))
