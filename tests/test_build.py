"""Lexicon construction, sources, labels, ranks and sinks on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from moodweave.functions.domains import FLAGS
from moodweave.operators import labels, lexbuild, ranks, scaling
from moodweave.sources import corpora, lexicons, sinks

LONG = "word string, emotion string, association int"


def test_build(spark):
    rows = [("Iubire", "joy", 1), ("iubire ", "trust", 1), ("iubire", "anticipation", 1), ("gol", "joy", 0), ("", "joy", 1)]
    out = lexbuild.build(spark.createDataFrame(rows, LONG))
    assert out.columns == list(lexbuild.FINAL_FIELDS)
    row = out.collect()
    assert len(row) == 1
    assert (row[0]["word"], row[0]["love"], row[0]["optimism"], row[0]["awe"]) == ("iubire", 1, 1, 0)


def test_keep_first_is_idempotent(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "k string, o int")
    once = lexbuild.keep_first(rows, F.col("k"), "o")
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 5)]
    assert sorted(map(tuple, lexbuild.keep_first(once, F.col("k"), "o").collect())) == [("a", 1), ("b", 5)]


def test_validation(spark):
    out = lexbuild.build(spark.createDataFrame([("x", "joy", 1), ("y", "negative", 1)], LONG))
    stats = lexbuild.validation(out)
    assert stats["schema"]["schema_valid"] and stats["rows_with_emotions"] == 2
    assert stats["emotion_distribution"]["joy"] == 1 and set(stats["emotion_distribution"]) == set(FLAGS)
    assert "| joy | 1 |" in sinks.lexicon_card(stats)


def test_lexicon_files(spark, tmp_path):
    english = tmp_path / "en.txt"
    english.write_text("Happy\tjoy\t1\nhappy\tfear\t0\nsad\tpositive\t1\n")
    found = lexicons.read_english(spark, [str(tmp_path / "none"), str(english)])
    assert [tuple(r) for r in found.collect()] == [("happy", "joy", 1.0)]
    assert lexicons.read_english(spark, [str(tmp_path / "none")]).count() == 35
    bad = tmp_path / "bad.txt"
    bad.write_text("Happy\tjoy\t1\n" * 50 + "sad\tfear\n")  # a bad line far down
    assert lexicons.read_english(spark, [str(bad)]).count() == 35
    wide = tmp_path / "ro.csv"
    wide.write_text("Word,joy,fear\nfaţă,1,0\nrău,0,True\n")
    assert sorted(tuple(r)[:2] for r in lexicons.read_romanian(spark, [str(wide)]).collect()) == [("față", "joy"), ("rău", "fear")]
    long = tmp_path / "ro.tsv"
    long.write_text("word\temotion\tscore\nx\tfurie\t0.2\nx\tanger\t0.7\ny\tjoy\t0\nz\tother\t1\n")
    assert [tuple(r) for r in lexicons.read_romanian(spark, [str(long)]).collect()] == [("x", "anger", 0.7)]
    assert lexicons.read_romanian(spark, [str(long)], keep_zero=True).count() == 2
    with pytest.raises(FileNotFoundError):
        lexicons.read_romanian(spark, [str(tmp_path / "none")])


def test_raw_layouts(spark, tmp_path):
    old = tmp_path / "old.txt"
    old.write_text("word\temotion\tassociation\nx\tjoy\t1\nbad line\n\n")
    assert [tuple(r) for r in lexicons.read_raw(spark, str(old)).collect()] == [("x", "joy", 1)]
    new = tmp_path / "new.txt"
    new.write_text("English Word\tanger\tjoy\tRomanian Word\nhappy\t0\t1\tfericit\nnone\t1\t1\t\n")
    merged = lexbuild.merged(lexbuild.one_hot(lexicons.read_raw(spark, str(new))))
    assert [(r["word"], r["joy"], r["anger"]) for r in merged.collect()] == [("fericit", 1, 0)]


def test_corpora(spark, tmp_path):
    raw = spark.createDataFrame([("a", [27]), ("b", [40, 0]), ("c", [])], "text string, labels array<int>")
    assert sorted(map(tuple, corpora.fine_corpus(raw).collect())) == [("a", "neutral")]
    assert sorted(map(tuple, corpora.fine_corpus(raw, False).collect())) == [("a", "neutral"), ("b", "trust")]
    rows = [("t", False, True, [0, 1], None), ("u", False, False, [0, 1, 0], None), ("v", False, False, [], "bucurie"), (" ", True, True, [], None)]
    red = spark.createDataFrame(rows, "text string, Sadness boolean, Joy boolean, agreed_labels array<int>, label string")
    assert sorted(map(tuple, corpora.priority_corpus(red).collect())) == [("t", "joy"), ("u", "surprise"), ("v", "joy")]
    assert corpora.priority_corpus(red, single=False).count() == 2
    (tmp_path / "a.csv").write_text("Tweet,Emotion\nhi,furie\n,joy\n")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    found = corpora.read_csvs(spark, [str(tmp_path / "none.csv"), str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert [tuple(r) for r in found.collect()] == [("hi", "anger")]
    assert corpora.cached(spark, str(tmp_path / "c"), lambda: found).count() == 1
    assert corpora.cached(spark, str(tmp_path / "c"), lambda: 1 / 0).count() == 1


def test_split_and_batches(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(300)], "doc_id long, label string")
    out = ranks.stratified_split(rows, "label", "doc_id").groupBy("label", "split").count().collect()
    assert {(r["label"], r["split"]): r["count"] for r in out} == {
        ("a", "test"): 40, ("a", "val"): 20, ("a", "train"): 140, ("b", "test"): 20, ("b", "val"): 10, ("b", "train"): 70,
    }
    numbered = ranks.batches(rows, "doc_id", 32, width=50).orderBy("doc_id").collect()
    assert [r["batch"] for r in numbered] == [i // 32 + 1 for i in range(300)]


def test_labels_and_scaling(spark):
    rows = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("a", 1.0)], "label string, x double")
    assert [tuple(r) for r in labels.label_index(rows).orderBy("code").collect()] == [("a", 0), ("b", 1)]
    weights = {r["label"]: r["weight"] for r in labels.class_weights(rows).collect()}
    assert weights == {"a": 0.75, "b": 1.5}
    fitted = scaling.fit(rows, ["x"])
    assert [r["x"] for r in scaling.scaled(rows, fitted).collect()] == [1.0] * 3
    assert [r["x"] for r in scaling.scaled(rows, fitted, True, 10.0, 1e-10).collect()] == [0.0] * 3


def test_sinks(spark, tmp_path):
    found = {"accuracy": 0.5, "macro_f1": 0.4, "weighted_f1": 0.3, "per_class": {"joy": {"precision": 1.0, "recall": 1.0, "f1": 1.0, "support": 2}}}
    sinks.write_metrics(spark, found, f"{tmp_path}/m/en_ml")
    assert sinks.read_metrics(spark, f"{tmp_path}/m", ["en"], ["ml", "hybrid"]) == {("en", "ml"): found}
    sinks.write_metrics(spark, found, f"{tmp_path}/csv", "csv")
    assert "per_class_joy" in spark.read.option("header", True).csv(f"{tmp_path}/csv").columns
    with pytest.raises(ValueError):
        sinks.write_metrics(spark, found, f"{tmp_path}/x", "xml")
    assert "| en | ml | 0.5000 |" in sinks.evaluation_report({("en", "ml"): found})
    lex = spark.createDataFrame([("ă", 1)], "word string, joy int")
    sinks.write_lexicon(lex, f"{tmp_path}/l.csv", f"{tmp_path}/l.json")
    assert json.loads(spark.read.text(f"{tmp_path}/l.json").first()[0]) == {"word": "ă", "joy": 1}
    source = f"{tmp_path}/l.csv"
    assert sinks.step(spark, f"{tmp_path}/s", source, lambda: lex).count() == 1
    assert sinks.step(spark, f"{tmp_path}/s", source, lambda: 1 / 0).count() == 1
    assert sinks.fingerprint(spark, f"{tmp_path}/none") == ""
