import random

import numpy as np

from glossmeter.llm import toxicity as T
from glossmeter.stage import staged


def test_held_out_grades(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(vocab) for _ in range(40)]
        grade = i % 3
        words += [["nice"], ["spam!!", "buy!!"], ["awful", "vermin"]][grade] * rng.randint(1, 2)
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        if i < 600:
            labels.append((i, 0 if grade == 1 else 1, int(grade == 2)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.learn(T.sample(docs, labels))
    assert model.cuts[0] <= model.cuts[1]
    rows = T.severity(docs, model, ["doc_id"]).where("doc_id >= 600").collect()
    assert np.mean([r["grade"] == r["doc_id"] % 3 for r in rows]) > 0.95
    assert np.mean([r["toxic"] == (r["doc_id"] % 3 == 2) for r in rows]) > 0.97
    by = [np.mean([r["expected_severity"] for r in rows if r["doc_id"] % 3 == g]) for g in range(3)]
    assert by[0] < by[1] < by[2]
    assert all(abs(r["expected_severity"] - r["p_poor"] - r["p_toxic"]) < 1e-12 for r in rows)


def test_sample_is_not_written(spark, tmp_path, monkeypatch):
    """The fit reads the sample once, so only the chosen labels are written before it."""
    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'vile'} text {i}") for i in range(40)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    written = []
    monkeypatch.setattr(T, "staged", lambda frame: written.append(frame.columns) or staged(frame))
    assert T.score_documents(spark, str(tmp_path)).count() == 40
    assert written == [["doc_id", "grade"]]


def test_odd_rows(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert T.learn(T.sample(odd, none)) is None
    rows = T.severity(odd.select("doc_id", "text"), None, ["doc_id"]).collect()
    assert len(rows) == odd.count() and {r["expected_severity"] for r in rows} == {0.0}
    labels = spark.createDataFrame([(5, 1, 1), (5, None, 0), (99, 0, 0), (None, 1, 1), (1, 1, None)], none.schema)
    assert T.sample(odd, labels).count() == 4                # two rows of document 5, two labels
    assert T.severity(nothing.select("doc_id", "text"), None, ["doc_id"]).count() == 0


def test_fit_against_numeric_gradients():
    """At the fitted parameters, the gradient of the objective by differences is near zero, and steps along it gain nothing."""
    rng = np.random.default_rng(5)
    grades = np.arange(600) % 3
    rows = [np.unique(np.concatenate([rng.integers(0, 12, 3), np.flatnonzero(rng.random(3) < 0.1 + 0.3 * g) + 12])) for g in grades]
    model = T.fit(rows, grades, buckets=20)
    used = np.flatnonzero(model.weights)
    assert len(used) >= 2
    weight = 1 / np.bincount(grades)[grades]
    weight /= weight.sum()
    given = np.array([[b in r for b in used] for r in rows], float)

    def objective(p):
        cuts = p[len(used)] + np.concatenate(([0], np.cumsum(np.exp(p[len(used) + 1:]))))
        up = 1 / (1 + np.exp(-((given @ p[:len(used)])[:, None] - cuts)))
        edge = np.concatenate([np.ones((len(rows), 1)), up, np.zeros((len(rows), 1))], 1)
        here = np.arange(len(rows))
        return -(weight * np.log(edge[here, grades] - edge[here, grades + 1])).sum() + 0.5 * T.PENALTY * (p[:len(used)] ** 2).sum()

    def slope(p):
        return np.array([(objective(p + h) - objective(p - h)) / 2e-5 for h in 1e-5 * np.eye(len(p))])

    p = np.concatenate([model.weights[used], [model.cuts[0]], np.log(np.diff(model.cuts))])
    start = np.zeros_like(p)
    assert np.abs(slope(p)).max() < 0.1 * np.abs(slope(start)).max()
    better = p.copy()
    for _ in range(300):
        better -= 0.5 * slope(better)
    assert objective(p) < objective(start) and objective(p) - objective(better) < 0.002 * objective(start)
