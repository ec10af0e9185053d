import zlib

import numpy as np

from gazetide.llm import toxicity
from gazetide.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op3_toxicity"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    right = wrong = missed = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        if r.held_out and r.doc_id in labels:
            right += labels[r.doc_id] == r.predicted == 1
            wrong += labels[r.doc_id] < r.predicted
            missed += labels[r.doc_id] > r.predicted
    # About a seventh of the toxic labels of this table are on texts without any toxic word.
    assert right / max(1, right + missed) > 0.7 and right / max(1, right + wrong) > 0.85


def test_negative_risk_is_held_back():
    rng = np.random.default_rng(0)
    positive = [np.unique(np.append(rng.integers(10, 500, 20), [1] * (rng.random() < 0.9) + [2])) for _ in range(60)]
    clean = [np.unique(rng.integers(10, 500, 20)) for _ in range(300)]
    hidden = [np.unique(np.append(rng.integers(10, 500, 20), [2])) for _ in range(30)]
    features, w, b, scale, shift = toxicity.train(positive, clean + hidden, clean[:100], positive[:15], 30 / 330)
    score = lambda d: scale * (w[np.isin(features, d)].sum() + b) + shift
    assert min(score(d) for d in hidden) > max(np.quantile([score(d) for d in clean], 0.99), 0)


def test_odd_tables(spark):
    docs = spark.createDataFrame(
        [(i, t, 0.5) for i, t in enumerate([None, "", "idiot " * 20_000, "a b"] + ["nice words here"] * 60 + ["you idiot you"] * 20)] + [(None, "you idiot you", 0.1)],
        "doc_id long, text string, score double",
    )
    labels = spark.createDataFrame([(i, int(i >= 64)) for i in range(4, 84)] * 2 + [(None, 1), (5, None)], "doc_id long, toxic int")
    rows = toxicity.scored(docs, toxicity.learn(docs, labels)).collect()
    assert len(rows) == 85
    toxic = {r.doc_id for r in rows if r.predicted}
    assert set(range(64, 84)) <= toxic and not toxic & set(range(4, 64)) and not toxic & {0, 1}
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {0, 1, 3} <= {r.doc_id for r in kept.collect()}
    assert toxicity.learn(docs, labels.where("toxic = 0")) == []
    assert {r.score for r in toxicity.scored(docs, []).collect()} == {0.0}
    assert toxicity.scored(docs.where("false"), []).collect() == []
