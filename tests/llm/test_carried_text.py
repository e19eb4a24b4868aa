"""A text that is carried goes to the Python worker once."""

import numpy as np

from wakeline.llm import language_id, toxicity

ROWS = [(1, "you are an idiot"), (2, None), (3, "a calm day"), (4, "")]


def sent(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_toxicity(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    grammar = toxicity.Grammar(set(), set())
    carried, bare = toxicity.scored(docs, grammar, ("doc_id", "text")), toxicity.scored(docs, grammar)
    assert "_text" not in sent(carried)
    want = sorted((r.doc_id, r.score, r.predicted) for r in bare.collect())
    assert sorted((r.doc_id, r.score, r.predicted) for r in carried.collect()) == want
    assert sorted((r.doc_id, r.text) for r in carried.collect()) == ROWS


def test_language(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    model = language_id.Model(["en"], np.ones(language_id.FEATURES), np.zeros((language_id.FEATURES, 1)), np.zeros(1), 1.0)
    carried, bare = language_id.predict(docs, model, ("doc_id", "text")), language_id.predict(docs, model)
    assert "_text" not in sent(carried)
    want = sorted((r.doc_id, r.lang_pred, r.score) for r in bare.collect())
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in carried.collect()) == want
