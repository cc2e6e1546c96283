import random

import numpy as np

from turnstone.llm import ordinal as Q


def test_gradients_lead_to_the_likelihood_optimum():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 3))
    eta = x @ [1.5, -1.0, 0.0] + rng.logistic(size=4000)
    grade = np.digitize(eta, [-1.0, 0.5, 2.0]) * 2.0
    m = Q.fit_ordinal(x, grade, ridge=0, steps=1500)
    assert np.allclose(m.weights, [1.5, -1.0, 0.0], atol=0.15)
    assert np.allclose(m.thresholds, [-1.0, 0.5, 2.0], atol=0.2) and list(m.thresholds) == sorted(m.thresholds)
    assert m.grades == (0.0, 2.0, 4.0, 6.0)
    assert (np.diff(m.tails(x), axis=1) <= 0).all()


def text(rng, grade):
    good = "calm river stone morning letter garden window silver".split()
    bad = ["CLICK!!", "$$$", "WIN!!", "buy buy buy", "|||"]
    return " ".join(rng.choice(good) if rng.random() < 0.4 + 0.2 * grade else rng.choice(bad) for _ in range(rng.randint(20, 80)))


def test_graded_ratings(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, i % 4), 1.0) for i in range(800)] + [(9000, None, 1.0), (9001, "", 1.0), (None, "calm", 1.0), (3, "calm " * 50000, 1.0), (5, "x", 1.0), (5, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade double")
    ratings = spark.createDataFrame([(i, i % 4) for i in range(800)] + [(9000, None)], "doc_id long, quality int")
    model = Q.fit_quality(docs, ratings)
    got = Q.quality_scores(docs, model, least_grade=2).collect()
    assert len(got) == len(rows)
    unseen = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 800]
    truth = np.array([r.doc_id % 4 for r in unseen])
    assert np.corrcoef(truth, [r.expected_grade for r in unseen])[0, 1] > 0.85
    assert np.mean([r.selected == (r.doc_id % 4 >= 2) for r in unseen]) > 0.85
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 3 for r in got)
    assert Q.quality_scores(docs.limit(0), model).count() == 0
    none = Q.fit_quality(docs, ratings.limit(0))
    assert not any(r.selected for r in Q.quality_scores(docs, none).collect())
