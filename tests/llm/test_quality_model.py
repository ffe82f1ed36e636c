import numpy as np

from trackmill.llm import quality_model as q


def test_em_recovers_planted_accuracies():
    random = np.random.default_rng(4)
    good = random.random(40_000) < 0.7
    accuracy = np.linspace(0.6, 0.95, q.LABELLERS)
    cast = np.where(random.random((len(good), q.LABELLERS)) < 0.3, q.SILENT, np.where(random.random((len(good), q.LABELLERS)) < accuracy, good[:, None], ~good[:, None]))
    patterns, counts = np.unique(cast @ 3 ** np.arange(q.LABELLERS), return_counts=True)
    model = q.LabelModel(patterns, counts.astype(float))
    assert np.abs(model.accuracies() - accuracy).max() < 0.03
    assert abs(model.prior[q.GOOD] - 0.7) < 0.03


def test_held_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = q.classify(docs).join(labels, "doc_id").collect()
    good, bad = [r for r in found if r.quality == 1], [r for r in found if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in bad) >= 0.85 * len(bad)


def test_odd_rows(odd, empty):
    found = q.classify(odd).collect()
    assert len(found) == odd.count()
    assert all(r.score == 0 and not r.kept for r in found if r.doc_id in (2, 3, 5))
    assert q.classify(empty).collect() == []
