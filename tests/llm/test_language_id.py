import zlib

import numpy as np

from matchloom.llm import language_id as L
from matchloom.llm.queries import QUERIES


def test_held_out_accuracy_on_whole_table(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = QUERIES["op6_subword_language_id"](spark, d).collect()
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id][0] is not None and r.lang_pred != "und"]
    right = sum(r.lang_pred == truth[r.doc_id][0] for r in held) / len(held)
    assert right >= 0.98, right
    accepted = [r for r in held if r.accepted]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in accepted) >= 0.99 * len(accepted)


def test_scores_equal_a_plain_computation():
    rng = np.random.default_rng(0)
    model = L.LanguageModel(["a", "b"], rng.normal(size=(1 << L.BUCKET_BITS, 2)), rng.normal(size=2))
    texts = ["one two one", "É x", "", None, "a" * 3000]
    got = model.logits(texts)
    for t, z in zip(texts, got):
        words = L.split_words(t)
        want = np.zeros(2)
        for w in words:
            buckets, n = L.gram_hashes([w])
            assert n.tolist() == [len(buckets)] == [sum(max(0, len(w) + 3 - k) for k in L.GRAMS)]
            want += model.scores[buckets].mean(axis=0) / len(words)
        assert np.allclose(z, want + model.bias)
        kinds, weights = L.text_grams(t)
        assert np.allclose(z, weights @ model.scores[kinds] + model.bias if len(kinds) else model.bias)


def test_edges(spark):
    rows = [(i, "the and of " * 5 if i % 2 else "le la une " * 5, "en" if i % 2 else "fr", 0.5) for i in range(60)] + [(100, None, "en", 1.0), (101, "", "en", 1.0), (102, "123 !!", "en", 1.0), (103, "the and of", None, 1.0), (None, "the of", "en", 0.0), (5, "the and", "en", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = L.fit_languages(docs)
    got = L.predict(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and by[103].lang_pred == "en" and by[0].lang_pred == "fr"
    assert L.fit_languages(docs.limit(0)) is None
    assert {r.lang_pred for r in L.predict(docs, None).collect()} == {"und"}
    assert L.predict(docs.limit(0), model).count() == 0


def test_very_long_and_equal_texts(spark):
    rows = [(i, "the and of " * 5 if i % 2 else "le la une " * 5, "en" if i % 2 else "fr") for i in range(60)]
    model = L.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(k, "the and of " * 30_000) for k in range(3)] + [(9, "the and of " * 5)], "doc_id long, text string")
    got = L.predict(docs, model).collect()
    assert {r.lang_pred for r in got} == {"en"} and len({r.score for r in got if r.doc_id < 3}) == 1
    tie = L.LanguageModel(["a", "b"], np.zeros((1 << L.BUCKET_BITS, 2)), np.zeros(2))
    assert {r.lang_pred for r in L.predict(docs, tie).collect()} == {"a"}
