"""Value domains of affect analysis, as literals and as small DataFrames."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Two orders of the eight emotions; they are never interchangeable.
FEATURE_ORDER = ("anger", "fear", "anticipation", "trust", "surprise", "sadness", "joy", "disgust")
LEXICON_ORDER = ("anger", "anticipation", "disgust", "fear", "joy", "sadness", "surprise", "trust")
POLARITY = ("positive", "negative")
NEUTRAL = "neutral"
LABELS = (*FEATURE_ORDER, NEUTRAL)
FLAGS = (*LEXICON_ORDER, *POLARITY)
LANGUAGES = ("en", "ro")
MODEL_KINDS = ("lexicon", "ml", "hybrid")
MAX_WORD_TERMS, MAX_CHAR_TERMS = 50_000, 25_000

# Negation cues. Cues with an apostrophe never match, as tokens hold none.
CUES = {
    "en": ("not", "never", "no", "n't", "cannot", "can't", "won't", "don't", "didn't"),
    "ro": ("nu", "niciodată", "fără", "nici", "niciun", "niciuna"),
}
#: Tokens after a cue that it negates, and the weights of an inverted and of the original emotion.
NEGATION_WINDOW, INVERTED_WEIGHT, KEPT_WEIGHT = 5, 0.5, 0.1

# The emotion that a negation turns each one into. Not its own inverse for all.
INVERSE = {
    "joy": "sadness",
    "sadness": "joy",
    "anger": "trust",
    "trust": "anger",
    "fear": "anticipation",
    "anticipation": "fear",
    "surprise": "anticipation",
    "disgust": "trust",
    "neutral": "neutral",
}

# Compound emotions and their two parents.
DYADS = {
    "love": ("joy", "trust"),
    "submission": ("trust", "fear"),
    "awe": ("fear", "surprise"),
    "disapproval": ("surprise", "sadness"),
    "remorse": ("sadness", "disgust"),
    "contempt": ("anger", "disgust"),
    "aggressiveness": ("anger", "anticipation"),
    "optimism": ("anticipation", "joy"),
}

# 28 fine labels in the order of their ids, with the label each maps to.
FINE_LABELS = {
    "admiration": "trust",
    "amusement": "joy",
    "anger": "anger",
    "annoyance": "anger",
    "approval": "trust",
    "caring": "trust",
    "confusion": "surprise",
    "curiosity": "anticipation",
    "desire": "anticipation",
    "disappointment": "sadness",
    "disapproval": "anger",
    "disgust": "disgust",
    "embarrassment": "fear",
    "excitement": "joy",
    "fear": "fear",
    "gratitude": "trust",
    "grief": "sadness",
    "joy": "joy",
    "love": "joy",
    "nervousness": "fear",
    "optimism": "anticipation",
    "pride": "joy",
    "realization": "surprise",
    "relief": "joy",
    "remorse": "sadness",
    "sadness": "sadness",
    "surprise": "surprise",
    "neutral": "neutral",
}

# Romanian names of the labels, and the priority of the boolean label columns.
ROMANIAN_LABELS = {
    "furie": "anger",
    "frică": "fear",
    "bucurie": "joy",
    "tristețe": "sadness",
    "surpriză": "surprise",
    "încredere": "trust",
    "dezgust": "disgust",
    "anticipare": "anticipation",
    "neutru": "neutral",
}
PRIORITY_LABELS = ("Sadness", "Surprise", "Fear", "Anger", "Neutral", "Trust", "Joy")

# Emotion words (score 1) that serve where no lexicon file is found.
FALLBACK_WORDS = {
    "anger": ("angry", "mad", "furious", "rage", "hate"),
    "fear": ("afraid", "scared", "terrified", "worried", "anxious"),
    "joy": ("happy", "glad", "joyful", "excited", "pleased"),
    "sadness": ("sad", "depressed", "unhappy", "sorrow", "grief"),
    "surprise": ("surprised", "shocked", "amazed", "astonished"),
    "disgust": ("disgusted", "revolted", "sickened"),
    "trust": ("trust", "confident", "sure", "reliable"),
    "anticipation": ("anticipate", "expect", "hope", "wait"),
}

# Words of the error categories, found anywhere in a text, inside other words too.
ERROR_NEGATIONS = ("not", "never", "no", "nu", "niciodată", "fără")
SARCASM_MARKS = ("yeah right", "sure", "lol", "haha", "right", "sigur", "bine")
# Code-point ranges that count as emoji there.
EMOJI_RANGES = ((0x1F600, 0x1F64F), (0x1F300, 0x1F5FF), (0x1F680, 0x1F6FF), (0x1F1E0, 0x1F1FF), (0x2702, 0x27B0), (0x24C2, 0x1F251))

# Emoji whose names are not those of the Unicode database.
EMOJI_NAMES = {
    "😀": "grinning_face",
    "😂": "face_with_tears_of_joy",
    "😊": "smiling_face_with_smiling_eyes",
    "😍": "smiling_face_with_heart-eyes",
    "😢": "crying_face",
    "😭": "loudly_crying_face",
    "😡": "enraged_face",
    "😠": "angry_face",
    "😱": "face_screaming_in_fear",
    "😨": "fearful_face",
    "😮": "face_with_open_mouth",
    "😞": "disappointed_face",
    "🤢": "nauseated_face",
    "👍": "thumbs_up",
    "👎": "thumbs_down",
    "❤️": "red_heart",
    "💔": "broken_heart",
    "🎉": "party_popper",
    "🔥": "fire",
    "🙏": "folded_hands",
}
#: Blocks in which nearly every character is an emoji.
EMOJI_BLOCKS = ((0x1F300, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F900, 0x1F9FF), (0x1FA70, 0x1FAFF))
#: Marks inside sequences: joiner, variation selector, keycap, and the first regional indicator.
JOINER, SELECTOR, KEYCAP, REGION_A = "\u200d", "\ufe0f", "\u20e3", 0x1F1E6

# Skin tones.
SKIN_TONES = {
    "🏻": "light_skin_tone",
    "🏼": "medium-light_skin_tone",
    "🏽": "medium_skin_tone",
    "🏾": "medium-dark_skin_tone",
    "🏿": "dark_skin_tone",
}
# Code points that take a skin tone (Unicode's modifier bases), as ranges.
TONED = (
    (0x261D, 0x261D), (0x26F9, 0x26F9), (0x270A, 0x270D), (0x1F385, 0x1F385), (0x1F3C2, 0x1F3C4), (0x1F3C7, 0x1F3C7), (0x1F3CA, 0x1F3CC),
    (0x1F442, 0x1F443), (0x1F446, 0x1F450), (0x1F466, 0x1F478), (0x1F47C, 0x1F47C), (0x1F481, 0x1F483), (0x1F485, 0x1F487), (0x1F48F, 0x1F48F),
    (0x1F491, 0x1F491), (0x1F4AA, 0x1F4AA), (0x1F574, 0x1F575), (0x1F57A, 0x1F57A), (0x1F590, 0x1F590), (0x1F595, 0x1F596), (0x1F645, 0x1F647),
    (0x1F64B, 0x1F64F), (0x1F6A3, 0x1F6A3), (0x1F6B4, 0x1F6B6), (0x1F6C0, 0x1F6C0), (0x1F6CC, 0x1F6CC), (0x1F90C, 0x1F90C), (0x1F90F, 0x1F90F),
    (0x1F918, 0x1F91F), (0x1F926, 0x1F926), (0x1F930, 0x1F939), (0x1F93C, 0x1F93E), (0x1F977, 0x1F977), (0x1F9B5, 0x1F9B6), (0x1F9B8, 0x1F9B9),
    (0x1F9BB, 0x1F9BB), (0x1F9CD, 0x1F9CF), (0x1F9D1, 0x1F9DD), (0x1FAC3, 0x1FAC5), (0x1FAF0, 0x1FAF8),
)
# Persons, and what a joined sign makes of one; hair is named after the skin tone, the others before it.
PERSONS = {"👨": "man", "👩": "woman", "🧑": "person"}
ROLES = {
    "⚕": "health_worker", "🎓": "student", "🏫": "teacher", "⚖": "judge", "🌾": "farmer", "🍳": "cook", "🔧": "mechanic", "🏭": "factory_worker",
    "💼": "office_worker", "🔬": "scientist", "💻": "technologist", "🎤": "singer", "🎨": "artist", "✈": "pilot", "🚀": "astronaut",
    "🚒": "firefighter", "🍼": "feeding_baby", "🦯": "with_white_cane", "🦼": "in_motorized_wheelchair", "🦽": "in_manual_wheelchair",
}
HAIR = {"🦰": "red_hair", "🦱": "curly_hair", "🦳": "white_hair", "🦲": "bald"}
# What persons do, named after "person", "man" or "woman"; and persons whose name stands alone where no sex is joined.
DOING = {
    "🏃": "running", "🚶": "walking", "🏄": "surfing", "🏊": "swimming", "🚣": "rowing_boat", "🚴": "biking", "🚵": "mountain_biking",
    "🤸": "cartwheeling", "🤹": "juggling", "🤽": "playing_water_polo", "🤾": "playing_handball", "🏌": "golfing", "🏋": "lifting_weights",
    "⛹": "bouncing_ball", "🙅": "gesturing_no", "🙆": "gesturing_ok", "🙇": "bowing", "🙋": "raising_hand", "🙍": "frowning", "🙎": "pouting",
    "🤦": "facepalming", "🤷": "shrugging", "💁": "tipping_hand", "💆": "getting_massage", "💇": "getting_haircut", "🧍": "standing",
    "🧎": "kneeling", "🧖": "in_steamy_room", "🧗": "climbing", "🧘": "in_lotus_position", "👳": "wearing_turban", "🤵": "in_tuxedo", "👰": "with_veil",
}
BEING = {
    "👮": "police_officer", "👷": "construction_worker", "💂": "guard", "🕵": "detective", "🦸": "superhero", "🦹": "supervillain", "🧙": "mage",
    "🧚": "fairy", "🧛": "vampire", "🧝": "elf", "🧞": "genie", "🧟": "zombie",
}
SEXES = {"♂": "man", "♀": "woman"}
# Other joined signs, and the flags of parts of a country.
JOINED = {
    "🏳🌈": "rainbow_flag", "🏳⚧": "transgender_flag", "🏴☠": "pirate_flag", "❤🔥": "heart_on_fire", "❤🩹": "mending_heart",
    "👁🗨": "eye_in_speech_bubble", "🐕🦺": "service_dog", "🐻❄": "polar_bear", "🐈⬛": "black_cat", "🐦⬛": "black_bird",
    "😶🌫": "face_in_clouds", "😮💨": "face_exhaling", "😵💫": "face_with_spiral_eyes",
}
PART_FLAGS = {"gbeng": "england", "gbsct": "scotland", "gbwls": "wales"}


def _named(sign: str) -> str:
    return unicodedata.name(sign, "").lower().replace(" ", "_")


def emoji_names(regions: dict[str, str] | None = None) -> dict[str, str]:
    """Emoji and the names that take their place in texts; sequences are made by rule from their parts.

    Single signs have the names of the Unicode database, but for ``EMOJI_NAMES`` and persons; flags those of ``regions``
    (by ISO code; without them only parts of countries have flags). Keys of sequences hold no variation selectors.
    """
    table = {sign: name for a, b in EMOJI_BLOCKS for sign in map(chr, range(a, b + 1)) if (name := _named(sign))}
    table |= {chr(c): _named(chr(c)) for a, b in TONED for c in range(a, b + 1)}
    table |= {sign.replace(SELECTOR, ""): name for sign, name in EMOJI_NAMES.items()} | PERSONS | SKIN_TONES
    table |= {sign: f"person_{what}" for sign, what in DOING.items()} | BEING
    tones = {"": "", **{t: f"_{n}" for t, n in SKIN_TONES.items()}}
    toned = {chr(c) for a, b in TONED for c in range(a, b + 1)}
    for sign in sorted(toned):
        table |= {sign + t: table[sign] + n for t, n in tones.items()}
    for sign, what in (DOING | BEING).items():
        marks = tones if sign in toned else {"": ""}
        table |= {sign + t + JOINER + sex: f"{who}_{what}{n}" for t, n in marks.items() for sex, who in SEXES.items()}
    for sign, who in PERSONS.items():
        for t, n in tones.items():
            table |= {sign + t + JOINER + x: f"{who if who != 'person' else ''}_{role}{n}".strip("_") for x, role in ROLES.items()}
            table |= {sign + t + JOINER + x: f"{who}{n}_{hair}" for x, hair in HAIR.items()}
    adults, young = {"👨": "man", "👩": "woman"}, {"👧": "girl", "👦": "boy"}
    grown = [(a,) for a in adults] + [(a, b) for a in adults for b in adults]
    small = [(a,) for a in young] + [(a, b) for a in young for b in young]
    whole = adults | young
    table |= {JOINER.join(x): "family_" + "_".join(whole[c] for c in x) for x in (g + s for g in grown for s in small)}
    for a, b in (x for x in grown if len(x) == 2):
        table[JOINER.join((a, "❤", b))] = f"couple_with_heart_{adults[a]}_{adults[b]}"
        table[JOINER.join((a, "❤", "💋", b))] = f"kiss_{adults[a]}_{adults[b]}"
    table |= {JOINER.join(pair): name for pair, name in JOINED.items()}
    table |= {key + KEYCAP: f"keycap_{key}" for key in "0123456789#*"}
    table |= {"".join(chr(REGION_A + ord(c) - ord("A")) for c in code): name.lower().replace(" ", "_") for code, name in (regions or {}).items()}
    return table | {"🏴" + "".join(chr(0xE0000 + ord(c)) for c in code) + chr(0xE007F): name for code, name in PART_FLAGS.items()}


# Part-of-speech suffixes, tried in this order.
POS_SUFFIXES = (("v", "(are|ere|ire|ă|ează)$"), ("n", "(ie|ție|are)$"), ("a", "(ic|esc|os)$"))


def lookup(table: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """The entry of a literal table, or null, or a default."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def inverse_of(emotion: Column) -> Column:
    """The emotion that negation turns ``emotion`` into; an unknown one stays."""
    return lookup(INVERSE, emotion, emotion)


def frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A literal table as a local relation, which needs no job of its own."""
    return spark.createDataFrame(list(rows), schema)


def fallback_lexicon(spark: SparkSession) -> DataFrame:
    rows = [(w, e, 1.0) for e, words in FALLBACK_WORDS.items() for w in words]
    return frame(spark, rows, "word string, emotion string, score double")


def label_map(spark: SparkSession, table: dict[str, str]) -> DataFrame:
    return frame(spark, table.items(), "label string, target string")
