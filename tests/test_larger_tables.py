"""What larger tables need: texts are looked at once, and terms stay where their documents lie."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from moodweave import plans
from moodweave.functions import text as T
from moodweave.functions.domains import fallback_lexicon
from moodweave.operators import emotions, models, separators, service, tfidf


class Stop(Exception):
    pass


def test_fits_over_features_read_no_texts(spark, sf, monkeypatch):
    seen = []

    def fit(train, test, estimator, names):
        seen.append((train.inputFiles(), test.inputFiles()))
        raise Stop

    monkeypatch.setattr("moodweave.plans.model_queries._fit_predict", fit)
    with pytest.raises(Stop):
        plans.QUERIES["train_lexicon_lr"](spark, sf)
    assert all(files and not any("documents" in f for f in files) for files in seen[0])


def test_blocks_hold_what_the_rows_hold():
    places = pa.array([None, [0, 3], [], None], pa.list_(pa.int32()))
    values = pa.array([[1.0, 2.0, 3.0, 4.0], [5.0, 6.0], [], [7.0, 8.0, 9.0, 0.0]], pa.list_(pa.float64()))
    whole = np.array([[1, 2, 3, 4], [5, 0, 0, 6], [0, 0, 0, 0], [7, 8, 9, 0]], float)
    w = np.arange(10.0).reshape(5, 2)
    for p, v, x in ((places, values, whole), (places.slice(1), values.slice(1), whole[1:])):
        for most in (1, 5, 100):
            separators_entries, separators.ENTRIES = separators.ENTRIES, most
            try:
                parts = list(separators._rows(p, v))
            finally:
                separators.ENTRIES = separators_entries
            got = [separators._scores(w, *e, f(4, *e)) for _, *e in parts for f in (separators._filled, lambda *_: None)]
            assert np.allclose(np.vstack(got[::2]), x @ w[:-1] + w[-1]) and np.allclose(np.vstack(got[1::2]), x @ w[:-1] + w[-1])


@pytest.mark.parametrize("kind", ["word", "char"])
def test_only_texts_are_shuffled_by_document(spark, kind):
    docs = spark.createDataFrame([(1, "one two one"), (1, "two"), (2, "an \U0001f600 é"), (3, ""), (None, "two two")], "doc_id long, text string")
    counts = tfidf.term_counts(docs, kind)
    vocabulary = spark.createDataFrame([("two", 1.5), ("one", 2.0)], "term string, idf double")
    plan = tfidf.weights(counts, vocabulary)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1
    # Rows of one id are one document; character sequences are those of the array form.
    terms = T.ngrams(T.tokens(F.lower(T.plain(F.col("text")))), 1, 2) if kind == "word" else T.char_ngrams(F.col("text"), 3, 5)
    want = Counter((r["doc_id"], t) for r in docs.select("doc_id", terms.alias("t")).collect() for t in r["t"])
    assert {(r["doc_id"], r["term"]): r["tf"] for r in counts.collect()} == want


MANY = "".join(chr(0x4E00 + i) for i in range(1500))


@pytest.mark.parametrize("kind", ["word", "char"])
@pytest.mark.parametrize("settings", [tfidf.Settings(), tfidf.IMPROVED, tfidf.Settings(max_words=7, max_chars=40)])
def test_terms_are_no_rows_before_they_are_weighed(spark, kind, settings, monkeypatch):
    texts = [(1, "one two one"), (1, "two"), (2, "an \U0001f600 é  \t x"), (3, ""), (None, "two two"), (4, None), (5, MANY + MANY[:90]), (6, "a\0b \0\0 a\0b"), (7, "one two two")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr("moodweave.operators.grams.UNITS", 20)  # several parts; the text of many characters fits no number
    found = tfidf.tfidf(docs, kind, settings)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    counts, most = tfidf.term_counts(docs, kind, settings), settings.max_words if kind == "word" else settings.max_chars
    want = tfidf.weights(counts, tfidf.vocabulary(counts, len(texts), most, settings), settings)
    of = lambda df: {(r["doc_id"], r["term"]): pytest.approx(r["weight"]) for r in df.collect()}
    got = of(found)
    assert got.keys() == of(want).keys() and all(r["weight"] == got[r["doc_id"], r["term"]] for r in want.collect())


@pytest.mark.parametrize("settings", [tfidf.Settings(), tfidf.IMPROVED])
def test_vectors_from_texts_are_those_of_their_terms(spark, settings):
    docs = spark.createDataFrame([(1, "one two one"), (2, "an \U0001f600 é  \t x one two"), (3, ""), (4, None), (5, MANY), (6, "a\0b two one")], "doc_id long, text string")
    stages = models.learnt_tfidf(docs, settings=settings)
    terms = models.with_terms(docs, words=settings.words, chars=settings.chars)
    want = {r["doc_id"]: r["tfidf"].toArray() for r in PipelineModel(stages=stages).transform(terms).collect()}
    got = {r["doc_id"]: r["tfidf"] for r in models.with_tfidf(docs, stages, settings).collect()}
    assert got.keys() == want.keys() and all(v.size == len(want[k]) and np.allclose(v.toArray(), want[k]) for k, v in got.items())
    fitted = Pipeline(stages=models.tfidf_stages(settings=settings)).fit(terms)
    assert [set(s.vocabulary) for s in stages if hasattr(s, "vocabulary")] == [set(s.vocabulary) for s in fitted.stages if hasattr(s, "vocabulary")]


@pytest.mark.parametrize("name", ["train_tfidf_lr", "improved_training", "embedding_hybrid"])
def test_no_arrays_of_terms_are_made(spark, sf, monkeypatch, name):
    def never(*_, **__):
        raise AssertionError("terms")

    class Fit:
        def fit(self, train):
            raise Stop

    monkeypatch.setattr(models, "with_terms", never)
    monkeypatch.setattr(models, "logistic", lambda *a, **k: Fit())
    with pytest.raises(Stop):
        plans.QUERIES[name](spark, sf)


def test_terms_become_vectors_before_the_fit(spark, sf, monkeypatch):
    seen = []

    def fit(train, test, estimator, names):
        seen.append((train.inputFiles(), train.columns))
        raise Stop

    stages = models.tfidf_stages
    monkeypatch.setattr(models, "tfidf_stages", lambda *a, **k: stages(10, 10))
    monkeypatch.setattr("moodweave.plans.model_queries._fit_predict", fit)
    with pytest.raises(Stop):
        plans.QUERIES["train_tfidf_lr"](spark, sf)
    files, columns = seen[0]
    assert files and not any("conversations" in f for f in files) and "tfidf" in columns and not {"text", "word_terms", "char_terms"} & set(columns)


def test_a_saved_model_is_evaluated_over_the_features_it_was_trained_on(spark, sf, monkeypatch):
    made, read, features, serve = [], [], emotions.lexicon_features, service.serve

    def served(registry, docs, *rest, **more):
        out = serve(registry, docs, *rest, **more)
        read.append(out.inputFiles())
        return out

    monkeypatch.setattr(emotions, "lexicon_features", lambda *a, **k: made.append(1) or features(*a, **k))
    monkeypatch.setattr(service, "serve", served)
    assert plans.QUERIES["saved_evaluation"](spark, sf).count() > 0
    assert len(made) == 1
    assert len(read) == 1 and read[0] and not any("documents" in f for f in read[0])


CUES = ("not", "by")
ODD = [
    (1, "not sad by not happy x not", "en"), (2, None, "en"), (3, "", "ro"), (4, "not", "en"), (5, "by " * 9 + "happy " * 9, None), (6, "happy HAPPY OK", "ro"),
    (6, "NOT angry!!! ok?? #sad@me www.happy", "en"), (7, "a\U0001f600happy #\u20e3 ht\ufe0ftp www. @ #", "en"), (None, "not happy", "en"), (8, "nu trist sad fără happy \u0130\u0130 AB", "ro"),
]


@pytest.mark.parametrize("cues", [CUES, None, {"en": ("not",), "ro": ("nu", "by")}, ()])
def test_features_from_the_marked_tokens_are_those_of_all_tokens(spark, cues, monkeypatch):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    rows = lambda: sorted(map(repr, emotions.lexicon_features(docs, fallback_lexicon(spark), cues).collect()))
    few = rows()
    monkeypatch.setattr(emotions, "LOOKED_UP", 0)  # the way of lexicons that are too large to look words up
    assert few == rows()


def test_tokens_are_the_runs_of_word_characters(spark):
    docs = spark.createDataFrame([(t,) for t in ("", None, "  ", "a", " a,b_1  \u00e9\U0001f600\u0130 ", "\U00010400x!y", "...")], "text string")
    for row in docs.select(T.tokens(F.col("text")).alias("t"), F.regexp_extract_all("text", F.lit(rf"{T.WORD}+"), F.lit(0)).alias("want")).collect():
        assert row["t"] == row["want"]
