"""Construction in restartable steps, checks of files, and acquisition of a raw lexicon."""

import random

import pytest

from moodweave.operators import lexbuild
from moodweave.sources import checks, lexicons, sinks, steps, store

RAW = "word\temotion\tassociation\nIubire\tjoy\t1\niubire\ttrust\t1\nfrică\tfear\t1\ngol\tjoy\t0\n"


def tables(spark, tmp_path):
    (tmp_path / "raw.txt").write_text(RAW)
    made = {
        "synsets": spark.createDataFrame([("iubire", "s1", "Love")], "word string, synset string, sumo string"),
        "synonyms": spark.createDataFrame([("s1", "Dragoste")], "synset string, lemma string"),
        "affect": spark.createDataFrame([("s1", "surprise")], "synset string, emotion string"),
    }
    for name, df in made.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
    return str(tmp_path / "raw.txt"), {name: f"{tmp_path}/{name}" for name in made}


def rows(df):
    return sorted(map(repr, df.collect()))


def test_steps_give_the_construction_and_resume(spark, tmp_path):
    raw, paths = tables(spark, tmp_path)
    root, plan = f"{tmp_path}/run", lexbuild.construction(raw, **paths)
    names = [s.name for s in plan]
    assert steps.run(spark, root, plan) == dict.fromkeys(names, "made")
    want = lexbuild.build(lexicons.read_raw(spark, raw), *[spark.read.parquet(p) for p in paths.values()])
    assert rows(spark.read.parquet(f"{root}/derived/data")) == rows(want) and want.count() == 3
    assert steps.run(spark, root, plan) == dict.fromkeys(names, "kept")
    # A table that was changed is made anew; its rows are those of before, so those after it stay.
    spark.read.parquet(f"{root}/mapped/data").limit(1).write.parquet(f"{tmp_path}/less")
    store.delete(spark, f"{root}/mapped/data")
    spark.read.parquet(f"{tmp_path}/less").write.parquet(f"{root}/mapped/data")
    assert steps.run(spark, root, plan) == dict.fromkeys(names, "kept") | {"mapped": "made"}
    # Another input reaches the steps that it changes.
    spark.createDataFrame([("s1", "anger")], "synset string, emotion string").write.mode("overwrite").parquet(paths["affect"])
    assert [n for n, x in steps.run(spark, root, plan).items() if x == "made"] == ["affected", "derived"]
    assert steps.run(spark, root, plan, resume=False) == dict.fromkeys(names, "made")


def test_a_failed_run_goes_on_where_it_ended(spark, tmp_path):
    calls, broken = [], [True]

    def make(name, fails=False):
        def of(**given):
            calls.append(name)
            if fails and broken[0]:
                raise RuntimeError("lost")
            return spark.range(3) if not given else next(iter(given.values()))

        return of

    plan = [steps.Step("c", make("c"), ("b",)), steps.Step("a", make("a")), steps.Step("b", make("b", True), ("a",))]
    with pytest.raises(steps.StepFailed) as error:
        steps.run(spark, str(tmp_path), plan)
    assert error.value.step == "b" and error.value.record == {"a": "made"} and calls == ["a", "b"]
    with pytest.raises(steps.StepFailed, match="needs b"):
        steps.run(spark, str(tmp_path), plan, only="c")
    broken[0] = False
    assert steps.run(spark, str(tmp_path), plan) == {"a": "kept", "b": "made", "c": "made"}
    # A run killed between table and manifest makes the table again.
    store.delete(spark, f"{tmp_path}/b/manifest")
    assert steps.run(spark, str(tmp_path), plan) == {"a": "kept", "b": "made", "c": "kept"}
    assert steps.run(spark, str(tmp_path), plan, resume=False, only="a") == {"a": "made"}
    for bad in ([steps.Step("a", make("a"), ("x",))], [steps.Step("a", make("a"), ("a",))], [steps.Step("a", make("a"))] * 2):
        with pytest.raises(ValueError):
            steps.ordered(bad)


def test_digest_knows_rows_not_their_order(spark):
    some = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "i int, s string")
    assert steps.digest(some) == steps.digest(some.repartition(3, "i").orderBy("i"))
    assert steps.digest(some) != steps.digest(some.distinct()) and steps.digest(some.where("false"))["rows"] == 0


def test_bad_bytes_against_a_plain_search(spark, tmp_path):
    draw, want = random.Random(3), {}
    pieces = [b"abc", "ăé".encode(), "�".encode(), "😀".encode(), b"\n", b"\r\n", b"\xff", b"\xc3", b"\xef\xbf", b"\xed\xa0\x80"]
    for i in range(60):
        odd = draw.choice((0.0, 0.02, 0.3))  # how often a piece may be a bad one
        body = b"x" + b"".join(draw.choice(pieces[: 10 if draw.random() < odd else 6]) for _ in range(40))
        (tmp_path / f"f{i}").write_bytes(body)
        try:
            body.decode()
        except UnicodeDecodeError as error:
            want[f"f{i}"] = error.start
    assert 5 < len(want) < 55
    for size in (None, "64"):  # splits within files as well
        if size:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = {r["file"].rsplit("/", 1)[1]: r["offset"] for r in checks.bad_bytes(spark, str(tmp_path)).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == want


def test_lexicon_file(spark, tmp_path):
    lexbuild.build(spark.createDataFrame([("frică", "fear", 1)], "word string, emotion string, association int")).write.option("header", True).csv(f"{tmp_path}/ok")
    stats = checks.lexicon_file(spark, f"{tmp_path}/ok")
    assert stats["utf8_valid"] and stats["schema"]["schema_valid"] and stats["file"]["row_count"] == 1 and stats["file"]["size_bytes"] > 20
    (tmp_path / "odd.csv").write_text("word,anger\nx,1\nx,1\n")
    odd = checks.lexicon_file(spark, f"{tmp_path}/odd.csv")  # only bytes abort
    assert not odd["schema"]["schema_valid"] and odd["duplicates"]["duplicates"] == 1 and odd["emotion_distribution"]["anger"] == 2
    (tmp_path / "bad.csv").write_bytes(b"word,anger\nx\xff,1\n")
    with pytest.raises(checks.NotUtf8, match=r"bad.csv: no UTF-8 at byte 12"):
        checks.lexicon_file(spark, f"{tmp_path}/bad.csv")


def test_acquisition(spark, tmp_path):
    (tmp_path / "en.txt").write_text("fear\tfear\t1\n" * 5)
    (tmp_path / "bad.txt").write_bytes(b"fric\xff\n")
    (tmp_path / "ro.txt").write_text(RAW)
    (tmp_path / "late.txt").write_text("a" * 1000 + "ă")
    paths = [str(tmp_path / f"{n}.txt") for n in ("none", "en", "bad", "late", "ro")]
    how, passed = lexicons.acquire(spark, paths, f"{tmp_path}/got")
    assert how == "copied" and [p.split(":")[0].rsplit("/", 1)[1] for p in passed] == ["en.txt", "bad.txt", "late.txt"]
    assert rows(lexicons.read_raw(spark, f"{tmp_path}/got")) == rows(lexicons.read_raw(spark, paths[-1]))
    assert lexicons.acquire(spark, paths, f"{tmp_path}/got") == ("present", [])
    made = spark.createDataFrame([("frică", "fear", 1, "Romanian"), ("fear", "fear", 1, "English"), ("dor", "sadness", None, "RO")], "word string, emotion string, association int, language string")
    how, passed = lexicons.acquire(spark, paths[:2], f"{tmp_path}/src", {"empty": lambda: made.where("false"), "gone": lambda: spark.read.parquet(f"{tmp_path}/gone"), "rows": lambda: made})
    assert how == "source" and len(passed) == 3
    assert sorted(tuple(r) for r in lexicons.read_raw(spark, f"{tmp_path}/src").collect()) == [("dor", "sadness", 0), ("frică", "fear", 1)]
    assert lexicons.acquire(spark, [], f"{tmp_path}/hold") == ("placeholder", [])
    assert lexicons.read_raw(spark, f"{tmp_path}/hold").count() == 0
    assert issubclass(steps.StepFailed, sinks.AffectError)
