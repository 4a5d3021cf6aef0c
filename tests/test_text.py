"""Hand-derived cases of the text functions, and a comparison with plain Python."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moodweave.functions import text as T
from moodweave.functions.domains import CUES, inverse_of
from moodweave.operators import emotions


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, words, negated",
    [
        ("I'm SOOO happy!!! #blessed", "i m soo happy blessed", []),
        ("I can't wait", "i can t wait", []),
        ("not happy at all today my friend", "not happy at all today my friend", [1, 2, 3, 4, 5]),
        ("no", "no", []),
        ("mail a@b.com cost 1000 see www.x.y", "mail a com cost 100 see", []),
        (None, "", []),
        ("", "", []),
        ("great 😀", "great grinning_face", []),
    ],
)
def test_prepared(spark, raw, words, negated):
    rows = spark.createDataFrame([(raw, "en")], "text string, lang string")
    row = emotions.prepare(rows).first()
    assert " ".join(row["tokens"]) == words
    assert row["negated"] == negated


def test_romanian_cues(spark):
    row = emotions.prepare(spark.createDataFrame([("nu sunt fericit", "ro")], "text string, lang string")).first()
    assert row["negated"] == [1, 2]


def test_style(spark):
    s = T.style(F.col("text"))
    row = spark.createDataFrame([("WOW!! A B ok?? !",)], "text string").select(*[v.alias(k) for k, v in s.items()]).first()
    assert row.asDict() == {
        "exclamation_count": 3, "question_count": 2, "repeated_exclamation": 1, "repeated_question": 1, "uppercase_ratio": 0.25,
    }


@pytest.mark.parametrize("word, tag", [("cântare", "v"), ("bucurie", "n"), ("frumos", "a"), ("casă", "v"), ("om", "")])
def test_pos(spark, word, tag):
    assert one(spark, T.pos_tag(F.col("text")), word) == tag


def test_letters_and_inverse(spark):
    assert one(spark, T.romanian_letters(F.col("text")), "şŞţŢ") == "șȘțȚ"
    assert one(spark, inverse_of(F.col("text")), "disgust") == "trust"
    assert one(spark, inverse_of(F.col("text")), "other") == "other"


def test_softmax_ranked(spark):
    assert one(spark, T.softmax(F.array(F.lit(0.0), F.lit(0.0))), "") == [0.5, 0.5]
    p = F.create_map(F.lit("b"), F.lit(0.2), F.lit("a"), F.lit(0.2), F.lit("c"), F.lit(0.6))
    assert [r["key"] for r in one(spark, T.ranked(p), "")] == ["c", "a", "b"]


def test_ngrams(spark):
    assert one(spark, T.ngrams(T.tokens(F.col("text")), 1, 2), "a b c") == ["a", "b", "c", "a b", "b c"]
    assert one(spark, T.ngrams(T.tokens(F.col("text")), 1, 2), "") == []
    assert one(spark, T.char_ngrams(F.col("text"), 3, 4), "Ab  c") == ["ab ", "b c", "ab c"]
    assert one(spark, T.char_ngrams(F.col("text"), 3, 4), "ab") == []


def python_prepared(text):
    text = re.sub(r"http\S+|www\.\S+", "", text)
    text = re.sub(r"@\w+", "", text)
    text = re.sub(r"#(\w+)", r"\1", text)
    text = re.sub(r"(.)\1{2,}", r"\1\1", text)
    words = re.findall(r"\b\w+\b", text.lower())
    marked = {j for i, w in enumerate(words) if w in CUES["en"] for j in range(i + 1, min(i + 6, len(words)))}
    return words, sorted(marked)


def test_against_python(spark):
    texts = []

    @settings(max_examples=150, database=None)
    @given(st.text(alphabet="ab no not never #@.!\n Éé1_http://w", max_size=60))
    def collect(t):
        texts.append(t)

    collect()
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "i int, text string, lang string")
    for row in emotions.prepare(rows).collect():
        assert (row["tokens"], row["negated"]) == python_prepared(row["text"]), row["text"]


def test_emoji_names(spark):
    texts = ["so \U0001f600\U0001f602!", "\U0001f955 \U0001fa90x", "\u2764\ufe0f", "plain é 漢字", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r[0] for r in rows.select("i", T.name_emoji(F.col("text")).alias("t")).orderBy("i").select("t").collect()]
    assert got[0] == "so  grinning_face  face_with_tears_of_joy !" and got[1] == " carrot   ringed_planet x"
    assert got[3:] == texts[3:] and "\ufe0f" not in got[2]
    own = rows.select(T.name_emoji(F.col("text"), {"\U0001f955": "root", "é": "e"}).alias("t")).collect()
    assert own[1]["t"].startswith(" root ") and own[3]["t"] == "plain  e  漢字"


EMOJI_SEQUENCES = {
    "skin tone": ("\U0001f44d\U0001f3fd", "thumbs_up_medium_skin_tone"),
    "flag": ("\U0001f1f7\U0001f1f4", "romania"),
    "flag of a part": ("\U0001f3f4\U000e0067\U000e0062\U000e0073\U000e0063\U000e0074\U000e007f", "scotland"),
    "keycap": ("1\ufe0f\u20e3", "keycap_1"),
    "keycap without selector": ("#\u20e3", "keycap_#"),
    "role": ("\U0001f469\U0001f3fd\u200d\U0001f680", "woman_astronaut_medium_skin_tone"),
    "hair": ("\U0001f468\U0001f3ff\u200d\U0001f9b0", "man_dark_skin_tone_red_hair"),
    "sex": ("\U0001f937\u200d\u2640\ufe0f", "woman_shrugging"),
    "family": ("\U0001f468\u200d\U0001f469\u200d\U0001f467\u200d\U0001f466", "family_man_woman_girl_boy"),
    "couple": ("\U0001f469\u200d\u2764\ufe0f\u200d\U0001f468", "couple_with_heart_woman_man"),
    "selector inside": ("\u2764\ufe0f\u200d\U0001f525", "heart_on_fire"),
    "selector": ("\u2764\ufe0f", "red_heart"),
}


def test_emoji_sequences(spark):
    for kind, (sign, name) in EMOJI_SEQUENCES.items():
        texts = [sign, f"a{sign}b {sign}{sign}", f"1 # {sign}"]
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
        got = [r[0] for r in rows.select("i", T.name_emoji(F.col("text")).alias("t")).orderBy("i").select("t").collect()]
        assert got == [f" {name} ", f"a {name} b  {name}  {name} ", f"1 #  {name} "], kind


def test_emoji_longest_match_against_a_plain_search(spark):
    import random

    table = {"ab": "1", "abc": "2", "abcde": "3", "b": "4", "bcd": "5", "xa": "6", "cd": "7", "e": "8"}
    draw = random.Random(5)
    texts = ["".join(draw.choice("abcdexy") for _ in range(draw.randint(0, 30))) for _ in range(300)] + [None, "\ufe0f", "a\ufe0fb\ufe0fc"]

    def plainly(text):
        out, i = "", 0
        while i < len(text):
            sign = max((s for s in table if text.startswith(s, i)), key=len, default=None)
            out, i = (out + f" {table[sign]} ", i + len(sign)) if sign else (out + text[i], i + 1)
        return out

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r[0] for r in rows.select("i", T.name_emoji(F.col("text"), table).alias("t")).orderBy("i").select("t").collect()]
    assert got == [*map(plainly, texts[:-3]), None, "\ufe0f", " 2 "]


def test_negated_documents_clean_their_texts_once(spark, sf):
    from moodweave import plans

    plan = plans.QUERIES["negation_positions"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("www") == 1


def test_character_ngrams_take_time_in_proportion(spark):
    import time

    def seconds(n):
        table = spark.createDataFrame([("ab cé" * n,)], "t string")
        began = time.time()
        table.select(F.size(T.char_ngrams(F.col("t"), 3, 5)).alias("n")).collect()
        return time.time() - began

    seconds(10)
    assert seconds(80_000) < 20
