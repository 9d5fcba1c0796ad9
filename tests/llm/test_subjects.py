import random

import numpy as np

from evidlake.llm.subjects import LEAST_POSTERIOR, _calibrated, composition, document_subjects

VOC = {s: [f"{s}{k}" for k in "abcdefghijklmnopqrstuvwxyz"] for s in ("sport", "law", "food")}
FILL = ["the", "view", "keeps", "rows", "of", "and", "each", "old", "table", "for"]


def corpus(rng, n):
    docs, truth = [], {}
    for k in range(n):
        mix = rng.sample(sorted(VOC), rng.choice([1, 1, 2]))
        s = []
        for i in range(rng.randrange(6, 20)):
            topic = VOC[mix[i % len(mix)]] if rng.random() < 0.9 else FILL
            s.append(" ".join(rng.sample(FILL, 4) + rng.sample(topic, 2)))
        docs.append((k, ". ".join(s) + "."))
        truth[k] = set(mix)
    return docs, truth


def test_held_out_accuracy(spark):
    rng = random.Random(12)
    docs, truth = corpus(rng, 400)
    labels = [(k, s, 1) for k in range(80) for s in (rng.sample(sorted(VOC), 1) if rng.random() < 0.1 else truth[k])]
    labels += labels[:5] + [(None, "law", 1), (3, None, 1), (4, "unknown", 1), (99_999, "law", 1)]
    docs += [(1000, None), (1001, " \n"), (1002, "..."), (None, "lawa lawb")]
    d = spark.createDataFrame([(*x, 0.5) for x in docs], "doc_id bigint, text string, share double")
    subjects = spark.createDataFrame([(s, "") for s in [*VOC, "nobody"]] + [(None, "")], "subject string, covers string")
    out = document_subjects(d, subjects, spark.createDataFrame(labels, "doc_id bigint, subject string, k int")).collect()
    got = {}
    for r in out:
        assert 0 < r.share <= 1 and 0 < r.posterior < 1
        if r.posterior >= LEAST_POSTERIOR:
            got.setdefault(r.doc_id, set()).add(r.subject)
    held = range(80, 400)
    assert sum(got.get(k) == truth[k] for k in held) / len(held) > 0.95
    assert not {1000, 1001, 1002, None} & set(got)


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "some text. more text.")], "doc_id bigint, text string")
    s, none = spark.createDataFrame([("law",)], "subject string"), spark.createDataFrame([], "doc_id bigint, subject string")
    assert document_subjects(d, s, none).count() == 0
    assert document_subjects(d, s.limit(0), none).count() == 0
    assert document_subjects(d.limit(0), s, none).count() == 0
    assert composition(document_subjects(d, s, none)).count() == 0


def test_calibration_sees_through_noisy_labels():
    rng = np.random.default_rng(3)
    treats = rng.random(5000) < 0.2
    share = np.where(treats, rng.uniform(0.25, 1, 5000), rng.uniform(0, 0.1, 5000)).round(2)
    label = np.where(treats, rng.random(5000) < 0.8, rng.random(5000) < 0.03)  # a fifth is missing, some are wrong
    x = np.unique(share)
    a, b = _calibrated(x, np.array([label[share == v].sum() for v in x], float), np.array([(~label)[share == v].sum() for v in x], float))
    p = 1 / (1 + np.exp(-(a + b * np.log((share + 0.01) / (1.01 - share)))))
    assert ((p >= 0.5) == treats).all()
    a, b = _calibrated(np.zeros(0), np.zeros(0), np.zeros(0))
    assert a + b * np.log(0.09 / 0.91) < 0 < a + b * np.log(0.26 / 0.76)
