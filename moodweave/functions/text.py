"""Text functions, Column to Column: cleaning, tokens, negation windows, style. All stay in the JVM."""

from __future__ import annotations

import json
from functools import lru_cache, reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .domains import CUES, NEGATION_WINDOW, POS_SUFFIXES, SELECTOR, emoji_names

#: A word character is a letter, a number or an underscore of any script.
WORD = r"[\p{L}\p{N}_]"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``."""
    return F.transform(F.array(value), body)[0]


def plain(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def name_emoji(text: Column, names: dict[str, str] | None = None) -> Column:
    """Put the names of emoji, between spaces, in their place; of several that begin at one place the longest counts.

    Variation selectors may stand after any character of a sign; those left over go. Texts without an emoji are only looked at once.
    """
    table, pattern, needed, foreign = _emoji_table() if names is None else _looked_up(names)
    if not table:
        return text
    # By first character, so that a sign is compared with the few that begin like it.
    lookup = F.from_json(F.lit(table), "map<string,map<string,string>>")
    bare = lambda c: F.replace(c, F.lit(SELECTOR), F.lit(""))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), bare)
    name = lambda sign: F.try_element_at(F.try_element_at(lookup, F.substring(sign, 1, 1)), sign)
    put = F.zip_with(F.split(text, pattern, -1), found, lambda rest, sign: F.concat(rest, F.coalesce(F.concat(F.lit(" "), name(sign), F.lit(" ")), F.lit(""))))
    seen = text.rlike(needed)
    if foreign:  # texts of ASCII alone take as many bytes as characters
        seen = (F.octet_length(text) > F.length(text)) & seen
    return F.when(seen, bare(F.array_join(put, ""))).otherwise(text)


@lru_cache(maxsize=1)
def _emoji_table() -> tuple[str, str, str, bool]:
    return _looked_up(emoji_names(region_names()))


def region_names() -> dict[str, str]:
    """The English names of countries and regions by ISO code, as the JVM's locale data gives them."""
    locale = SparkSession.active().sparkContext._jvm.java.util.Locale
    return {code: locale("", code).getDisplayCountry(locale.ENGLISH) for code in locale.getISOCountries()}


def _looked_up(names: dict[str, str]) -> tuple[str, str, str, bool]:
    """Names as JSON, by first character and sign, the pattern of all signs, one of characters of which each text with a sign holds one, and whether none of these is ASCII.

    Signs are without variation selectors. Of those that begin with an ASCII character, as keycaps do, the last character is looked for.
    """
    table: dict[str, dict[str, str]] = {}
    for sign, name in names.items():
        if sign := sign.replace(SELECTOR, ""):
            table.setdefault(sign[0], {})[sign] = name
    signs = [s for x in table.values() for s in x]
    needed = {s[-1 if s[0].isascii() else 0] for s in signs}
    return json.dumps(table) if table else "", trie_pattern(signs), char_class(needed, 256), not any(c.isascii() for c in needed)


def char_class(chars, gap: int = 1) -> str:
    """A class of ``chars`` as ranges; those above ASCII that are less than ``gap`` apart share one."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if ranges and (c == ranges[-1][1] + 1 or (ranges[-1][0] > 127 and c - ranges[-1][1] <= gap)):
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in ranges) + "]"


def trie_pattern(signs: list[str]) -> str:
    """A regular expression of the longest of ``signs`` at a place: their trie, in which characters with equal subtrees share one class.

    Characters that differ lead to different branches, so a match never goes back to try another one.
    """
    trie: dict = {}
    for sign in signs:
        node = trie
        for c in sign:
            node = node.setdefault(c, {})
        node[""] = {}

    def of(node: dict) -> str:
        alike: dict[str, list[str]] = {}
        for c in sorted(k for k in node if k):
            alike.setdefault(of(node[c]), []).append(c)
        branches = [f"{char_class(cs)}{SELECTOR}?{rest}" for rest, cs in alike.items()]
        if not branches:
            return ""
        return "(?:" + "|".join(branches) + ")" + ("?" if "" in node else "")

    # Most characters begin no sign, and are told by a few ranges.
    return f"(?={char_class(set(trie), 256)}){of(trie)}"


def _holding(text: Column, marks: tuple[str, ...], change) -> Column:
    """``change`` of the texts that hold one of ``marks``; no pattern looks at the others, which are the most."""
    return let(text, lambda c: F.when(reduce(lambda a, b: a | b, [c.contains(m) for m in marks]), change(c)).otherwise(c))


def drop_urls(text: Column) -> Column:
    # Plans are searched for the pattern's www to tell how often a text is cleaned, so the mark is a part of it.
    return _holding(text, ("http", "ww."), lambda c: F.regexp_replace(c, r"(?U)http\S+|www\.\S+", ""))


def drop_mentions(text: Column) -> Column:
    return _holding(text, ("@",), lambda c: F.regexp_replace(c, rf"@{WORD}+", ""))


def unwrap_hashtags(text: Column) -> Column:
    return _holding(text, ("#",), lambda c: F.regexp_replace(c, rf"#({WORD}+)", "$1"))


def shorten_runs(text: Column) -> Column:
    """Three or more of one character, line feeds excepted, become two."""
    return F.regexp_replace(text, r"([^\n])\1{2,}", "$1$1")


def cleaned(text: Column, emoji: dict[str, str] | None = None) -> Column:
    """Emoji named, URLs and mentions dropped, hashtags unwrapped, runs shortened, lower case; in this order."""
    return F.lower(shorten_runs(unwrap_hashtags(drop_mentions(drop_urls(name_emoji(plain(text), emoji))))))


def tokens(text: Column) -> Column:
    """The runs of word characters. What stands between them is cut out, which takes less time than to pick each of them."""
    return F.array_remove(F.split(text, r"[^\p{L}\p{N}_]+"), "")


def prepared(text: Column, emoji: dict[str, str] | None = None) -> Column:
    """The tokens of the cleaned text; none for null or empty texts."""
    return tokens(cleaned(text, emoji))


def romanian_letters(text: Column) -> Column:
    """Cedilla letters become the comma letters of the standard."""
    return F.translate(text, "şŞţŢ", "șȘțȚ")


def cue_array(lang: Column, cues: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The cues of a language; any but English takes the Romanian ones."""
    cues = CUES if cues is None else cues
    return F.when(lang == "en", F.array(*map(F.lit, cues["en"]))).otherwise(F.array(*map(F.lit, cues["ro"])))


def negated_positions(words: Column, cues: Column | tuple[str, ...], window: int = NEGATION_WINDOW) -> Column:
    """Sorted positions (from 0) of the tokens in the window after a cue.

    Cues are rare, so only their positions are expanded.
    """
    is_cue = (lambda w: w.isin(*cues)) if isinstance(cues, tuple) else (lambda w: F.array_contains(cues, w))

    def marked(w: Column) -> Column:
        at = F.filter(F.transform(w, lambda t, i: F.when(is_cue(t), i)), lambda i: i.isNotNull() & (i < F.size(w) - 1))
        spans = F.transform(at, lambda i: F.sequence(i + 1, F.least(i + window, F.size(w) - 1)))
        return F.array_sort(F.array_distinct(F.flatten(spans)))

    return let(words, marked)


def negated_flags(words: Column, cues: Column | tuple[str, ...], window: int = NEGATION_WINDOW) -> Column:
    """Whether each token is in the window after a cue; one look at so many tokens before it, whatever their number."""
    is_cue = (lambda w: w.isin(*cues)) if isinstance(cues, tuple) else (lambda w: F.array_contains(cues, w))

    def marked(c: Column) -> Column:
        before = lambda i: [F.coalesce(F.get(c, i - d), F.lit(False)) for d in range(1, window + 1)]
        after = F.transform(c, lambda _, i: reduce(lambda a, b: a | b, before(i)))
        return F.when(F.exists(c, lambda x: x), after).otherwise(F.array_repeat(F.lit(False), F.size(c)))

    return let(F.transform(words, is_cue), marked)


def near_cues(marks: Column, n_tokens: Column, window: int = NEGATION_WINDOW) -> tuple[Column, Column]:
    """Whether each of ``marks`` is in the window after a cue, and how many of the ``n_tokens`` tokens are: as ``negated_flags``, from few tokens.

    ``marks`` has pos and is_cue of all cues, and of other tokens, in their order.
    """

    def after(m: Column, j: Column) -> Column:
        # No two have one position: those of the window are among as many entries.
        before = lambda d: F.get(marks, j - d)
        near = [F.coalesce(before(d)["is_cue"] & (m["pos"] - before(d)["pos"] <= window), F.lit(False)) for d in range(1, window + 1)]
        return reduce(lambda a, b: a | b, near)

    def covered(at: Column) -> Column:
        # A cue's window ends where the next one's begins, or with the text.
        ends = F.concat(F.slice(at, 2, F.size(at)), F.array(n_tokens - 1))
        spans = F.zip_with(at, ends, lambda a, b: F.least(b - a, F.lit(window)))
        return F.when(F.size(at) == 0, 0).otherwise(F.aggregate(spans, F.lit(0), lambda s, x: s + x))

    return F.transform(marks, after), let(F.transform(F.filter(marks, lambda m: m["is_cue"]), lambda m: m["pos"]), covered)


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def style(text: Column) -> dict[str, Column]:
    """Punctuation counts and the share of upper-case tokens, of the raw text."""
    text = plain(text)
    shouted = lambda t: (t == F.upper(t)) & (t != F.lower(t)) & (F.length(t) > 1)
    share = let(
        tokens(text),
        lambda w: F.when(F.size(w) == 0, F.lit(0.0)).otherwise(F.size(F.filter(w, shouted)).cast("double") / F.size(w)),
    )
    return {
        "exclamation_count": count_char(text, "!"),
        "question_count": count_char(text, "?"),
        "repeated_exclamation": F.when(text.contains("!!"), F.regexp_count(text, F.lit("!{2,}"))).otherwise(0),
        "repeated_question": F.when(text.contains("??"), F.regexp_count(text, F.lit(r"\?{2,}"))).otherwise(0),
        "uppercase_ratio": share,
    }


def negation_features(n_negated: Column, n_tokens: Column) -> dict[str, Column]:
    size = n_negated.cast("double")
    return {
        "has_negation": F.when(n_negated > 0, 1.0).otherwise(0.0),
        "negation_window_size": size,
        "negation_ratio": size / F.greatest(n_tokens, F.lit(1)),
        "negated_tokens": size,
    }


def pos_tag(word: Column) -> Column:
    """A part of speech guessed from the suffix; the first rule that fits, or an empty string."""
    out, low = None, F.lower(word)
    for tag, suffix in POS_SUFFIXES:
        out = F.when(low.rlike(suffix), tag) if out is None else out.when(low.rlike(suffix), tag)
    return out.otherwise("")


def guessed_language(words: Column) -> Column:
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, CUES["ro"]))), "ro").otherwise("en")


def ngrams(words: Column, low: int, high: int) -> Column:
    """All word n-grams of the orders ``low`` to ``high``, joined by a space, with repeats."""

    def of(w: Column, n: int) -> Column:
        if n == 1:
            return w
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

    return let(words, lambda w: F.concat(*[of(w, n) for n in range(low, high + 1)]))


def squeezed(text: Column) -> Column:
    """The lower-case text with runs of white space taken as one space."""
    return F.regexp_replace(F.lower(plain(text)), r"(?U)\s\s+", " ")


def char_ngrams(text: Column, low: int, high: int) -> Column:
    """All character n-grams of the lower-case text, runs of white space taken as one space.

    The text becomes an array of characters first: a substring is looked for from the text's start, so that time would grow with its square.
    """

    def of(c: Column, n: int) -> Column:
        starts = F.when(F.size(c) >= n, F.sequence(F.lit(0), F.size(c) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(*[F.get(c, i + k) for k in range(n)]))

    chars = F.when(squeezed(text) == "", F.array().cast("array<string>")).otherwise(F.split(squeezed(text), ""))
    return let(chars, lambda c: F.concat(*[of(c, n) for n in range(low, high + 1)]))


def softmax(scores: Column) -> Column:
    def of(x: Column) -> Column:
        raised = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
        return let(raised, lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, y: s + y)))

    return let(scores, of)


def two_class(decision: Column) -> Column:
    return let(1.0 / (1.0 + F.exp(-decision)), lambda p: F.array(1.0 - p, p))


def ranked(probabilities: Column) -> Column:
    """Entries of a label-to-probability map, largest first, ties by label."""
    order = lambda a, b: (
        F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1)
        .when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    )
    return F.array_sort(F.map_entries(probabilities), order)
