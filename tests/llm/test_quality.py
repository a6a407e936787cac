import random
import zlib

import numpy as np
import pytest

from strandloom.llm import gbt as G
from strandloom.llm import quality as Q


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def walk(model, row):
    out = model.base
    for at in model.roots:
        while model.left[at] != at:
            at = model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at]
        out += model.value[at]
    return out


def test_trees_learn_and_flat_walk_is_the_plain_walk():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(1500, 5))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rnd.random(1500) < 0.05)).astype(float)
    model = G.fit(x[:1000], y[:1000])
    p = model.margin(x[1000:])
    assert auc(y[1000:], p) > 0.9
    assert p == pytest.approx([walk(model, r) for r in x[1000:]])
    assert (G.fit(x, np.ones(1500)).probability(x) > 0.99).all() and G.fit(x[:0], y[:0]).probability(x).tolist() == [0.5] * 1500


def test_classifier_on_planted_junk(spark):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        good = rnd.random() < 0.8
        w = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(20, 80))]
        rows.append((i, " ".join(x + ("" if good else "$$$") for x in w) + ".", "en", "s", 0.5))
        labels.append((i, int(good), 0))
    rows += [(9001, None, None, None, 0.1), (9002, "", "x", "x", 0.1), (None, "abc def", "x", "x", 0.1), (0, rows[0][1], "en", "s", 0.5), (9003, "a " * 100_000, "x", "x", 0.1)]
    labels += [(5, None, 0), (77777, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").repartition(4)
    labs = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = Q.train(docs, labs)
    got = Q.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    good = dict((i, y) for i, y, _ in labels[:600])
    held = [r for r in got if r.held_out and r.doc_id in good]
    assert len(held) > 50 and auc(np.array([good[r.doc_id] for r in held]), np.array([r.score for r in held])) > 0.99
    flipped = labs.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 5 = 0, 1 - quality, quality) AS quality")
    assert Q.train(docs, flipped).margin(np.ones((1, len(Q.NAMES)))) == pytest.approx(model.margin(np.ones((1, len(Q.NAMES)))))
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id < 600").count() == sum(r.predicted for r in got if r.doc_id is not None and r.doc_id < 600)


def test_empty_tables(spark):
    docs, labs = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert Q.score(docs, Q.train(docs, labs)).count() == 0
    one = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert Q.score(one, Q.train(one, labs)).first().score == 0.5
