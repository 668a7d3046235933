import random
from math import exp, log

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tessera.llm import toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(6)
    bad = {"en": ["nasty", "vile", "foul"], "de": ["mies", "fies", "wüst"]}
    docs, labels = [], []
    for i in range(1200):
        lang = r.choice(["en", "de"])
        words = [f"{lang}{r.randrange(300)}" for _ in range(r.randrange(5, 120))]
        toxic = int(r.random() < 0.25)
        for _ in range(r.randrange(2, 5) * toxic):
            words[r.randrange(len(words))] = r.choice(bad[lang]).upper() + "!"
        docs.append((i, " ".join(words), lang))
        labels.append((i, toxic))
    labels += [(None, 1), (3, None), (99999, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).collect()
    right = [(r.toxicity >= toxicity.THRESHOLD) == bool(r.toxic) for r in out]
    assert sum(right) / len(right) > 0.93
    assert all(0 <= r.toxicity <= 1 for r in out)


def test_labels_of_held_out_rows_are_not_used(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert (a.tables == b.tables).all() and a.offset == b.offset and a.thresholds == b.thresholds


def test_odd_rows(docs, labelled):
    model = toxicity.train(*labelled)
    out = toxicity.score(docs, model)
    assert out.columns == [*docs.columns, "toxicity"]
    assert out.count() == docs.count() and out.filter("toxicity is null").count() == 0
    assert out.filter("text is null or text = ''").select("toxicity").distinct().count() == 1


def test_empty(none, labelled):
    docs, labels = labelled
    assert toxicity.score(none, toxicity.train(docs, labels.limit(0))).collect() == []
    model = toxicity.train(docs, labels.filter("toxic = 1"))
    assert {round(r.toxicity, 6) for r in toxicity.score(docs, model).collect()} == {1.0}


def plain_score(model, text):
    """The forward pass, word by word."""
    packed, _ = toxicity._buckets(pa.array([text], pa.string()))
    x = [np.concatenate([model.tables[0][int(p) & 0xFFFF], model.tables[1][int(p) >> 16]]).astype(float) for p in packed]
    zero = np.zeros(2 * toxicity.DIM)
    logit, k = model.offset, 0
    for w, f in zip(toxicity.WIDTHS, model.filters):
        for c in range(toxicity.FILTERS):
            best = max(sum(float((x[i + j] if i + j < len(x) else zero) @ f[2 * toxicity.DIM * j : 2 * toxicity.DIM * (j + 1), c]) for j in range(w)) for i in range(max(1, len(x))) ) if x else 0.0
            logit += max(best + float(model.bias[k]), 0.0) * float(model.out[k])
            k += 1
    return 1 / (1 + exp(-logit))


def test_scores_are_those_of_a_plain_forward_pass(labelled, spark):
    model = toxicity.train(*labelled)
    texts = [r.text for r in labelled[0].limit(25).collect()] + ["", "nasty", None, "unseen words only", "vile vile"]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert [r.toxicity for r in sorted(got, key=lambda r: r.doc_id)] == pytest.approx([plain_score(model, t) for t in texts], abs=1e-4)


def test_the_query_agrees_with_a_plain_forward_pass(spark, sf_dir):
    from tessera.llm.common import read
    from tessera.llm.queries import op6_toxicity

    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = op6_toxicity(spark, sf_dir).collect()
    assert len(got) == len(texts) and all(r.predicted == (r.score >= 0.3) for r in got)
    short = sorted(texts, key=lambda i: len(texts[i] or ""))[:60]
    score = {r.doc_id: r.score for r in got}
    assert [score[i] for i in short] == pytest.approx([plain_score(model, texts[i]) for i in short], abs=1e-4)


def test_gradients():
    """Beside differences of the loss."""
    rng = np.random.default_rng(0)
    model = toxicity.Model()
    model.tables[:] = rng.standard_normal(model.tables.shape).astype(np.float32) * 0.3
    model.out = model.out * 5
    model.bias[:] = 0.02  # off the kink, where an empty text would stand
    packed, counts = toxicity._buckets(pa.array(["a b c d e", "b", "x y z a q r", ""]))
    labels = np.array([1, 0, 1, 0], np.float32)

    def loss():
        p = 1 / (1 + np.exp(-model.logits(packed, counts).astype(float)))
        return -float(np.mean([log(q) if y else log(1 - q) for q, y in zip(p, labels)]))

    tables, filters, bias, out, offset = model.gradients(packed, counts, labels)
    eps = 1e-3
    checked = 0
    cases = [(model.filters[k], filters[k], [tuple(i) for i in np.argwhere(abs(filters[k]) > 0.01)[:6]]) for k in range(3)]
    cases += [(model.bias, bias, [(i,) for i in range(0, 36, 7)]), (model.out, out, [(i,) for i in range(0, 36, 7)])]
    for t, (rows, g) in enumerate(tables):
        whole = np.zeros_like(model.tables[t])
        whole[rows] = g
        cases.append((model.tables[t], whole, [(int(r), c) for r in rows[:4] for c in (0, 3)]))
    for value, gradient, places in cases:
        for at in places:
            held = value[at]
            value[at] = held + eps
            up = loss()
            value[at] = held - eps
            down = loss()
            value[at] = held
            assert gradient[at] == pytest.approx((up - down) / (2 * eps), abs=4e-3)
            checked += 1
    assert checked > 30
    model.offset += eps
    up = loss()
    model.offset -= 2 * eps
    assert offset == pytest.approx((up - loss()) / (2 * eps), abs=1e-3)


def test_the_driver_gets_the_model_only(labelled, monkeypatch):
    """Training runs in a task: nothing is fitted here, and the columns of the sample don't come back."""
    def here(*_):
        raise AssertionError("fitted on the driver")

    got, collect = [], DataFrame.toArrow
    monkeypatch.setattr(toxicity.Model, "fit", here)
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: got.append(collect(self)) or got[-1])
    model = toxicity.train(*labelled)
    assert [(t.column_names, t.num_rows) for t in got] == [(["model"], 1)]
    assert model.tables.any() and model.offset
