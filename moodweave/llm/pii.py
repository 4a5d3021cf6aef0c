"""Personal data replaced by format-preserving Feistel pseudonyms, in native expressions only.

Card numbers (Luhn), IBANs (mod 97), IPv4 addresses, phone numbers (a country code and as many digits as it
takes), social security numbers (no area 000, 666 or 9xx, no group 00, no serial 0000) and dates
are validated and then permuted within their format by a keyed Feistel network: a card stays a valid
card number, a date a date in the same notation, a social security number one that could be issued; a phone number keeps its country
code and its first digit. Notation is left as it is and plays no part in the permutation, so equal values get equal
pseudonyms in every document, however they are spaced. E-mail addresses and secrets, which have no small format, get keyed digests.
The key is the caller's: whoever has it can undo the permutations.

Defined results: a null text stays null; text without a match is returned as it is, byte for byte;
numbers that fail their check and dates outside 1700-03-01 to 2100-02-28 stay; in a run of digits that
is longer than a card, or fails its check, cards that start and end at a separator are found, the first
and longest first, and counted one by one; repeated rows change alike; an empty table gives no rows; further columns are
kept, but for one named as the count. Patterns take time in proportion to the text, however long a run of one kind it holds.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import let

#: The setting that names the key of the registered query; without it a session draws its own.
KEY_SETTING = "spark.moodweave.pii.key"
ROUNDS = 10
#: 400 Gregorian years have 146,097 = 189 * 773 days: the two halves of the date network.
FIRST_DAY, DAY_HALVES = "1700-03-01", (189, 773)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

#: What a run of digits doesn't go on with: the other kinds that start with a digit. A local part has 64 characters at most.
_OTHER = (
    r"\d{4}-\d{2}-\d{2}(?![\w/-])|\d{2}\.\d{2}\.\d{4}(?![\w/-])|\d{2}/\d{2}/\d{4}(?![\w/-])"
    r"|\d{3}-\d{2}-\d{4}(?![\w-])|\d{1,3}(?:\.\d{1,3}){3}(?![\w])(?!\.\d)|[A-Za-z0-9._%+-]{1,64}+@"
)
#: Kinds in the order in which they are tried at a place of the text.
PATTERNS = {
    # A run of local characters is looked at from its start only, and never given back; groups without a bound
    # are possessive, as only those are matched in a loop and not by recursion.
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": r"(?i:\b(?:token|password|passwd|secret|api[_-]?key))\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+.-]{8,}+",
    "access_key": r"\bAKIA[A-Z0-9]{16}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": rf"(?<!\w)\+(?:1[ .-]?\(?\d{{3}}\)?[ .-]?\d{{3}}[ .-]?\d{{4}}|[2-9]\d{{0,2}}[ .-]?\(?\d{{1,4}}\)?(?:[ .-]?(?!{_OTHER})\d{{2,4}}){{1,4}})(?!\w)",
    "ssn": r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w/-])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w])(?!\.\d)",
    # A run of digits may hold several cards, or a card and other numbers.
    "card": rf"(?<!\w)(?=\d(?:[ -]?\d){{12}})\d++(?:[ -](?!{_OTHER})\d++(?!\w))*+(?!\w)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Country codes of two digits; 1 and 7 have one, all others three. Fixed by the numbering plan (ITU E.164).
TWO_DIGIT_CODES = (
    20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 51, 52, 53, 54, 55, 56, 57, 58,
    60, 61, 62, 63, 64, 65, 66, 81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98,
)
#: Parts of a run of digits that are put together at once.
BLOCK = 64
#: What every match holds; texts without it are not searched further.
HINT = r"[0-9@=:]"


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(key), *[p.cast("string") for p in parts]), 256)


def feistel(a: Column, b: Column, first: Column, second: Column, tag: Column, key: str) -> Column:
    """Permute pairs (a, b) with 0 <= a < first, 0 <= b < second: a struct with fields a and b.

    Rounds add a keyed digest of one half to the other, modulo its range, so every range works
    and each round can be undone.
    """

    def round_(s: Column, r: Column) -> Column:
        left = r % 2 == 0
        other = F.when(left, s["b"]).otherwise(s["a"])
        f = F.conv(F.substring(_digest(key, tag, r, other), 1, 15), 16, 10).cast("long")
        new_a = F.when(left, (s["a"] + f) % first).otherwise(s["a"])
        new_b = F.when(left, s["b"]).otherwise((s["b"] + f) % second)
        return F.struct(new_a.alias("a"), new_b.alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_)


def _ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permuted_digits(digits: Column, kind: str | Column, key: str) -> Column:
    """A digit string of 2 to 36 digits, permuted among the strings of its length."""
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def of(d: Column) -> Column:
        u = F.floor(F.length(d) / 2).cast("int")
        v = F.length(d) - u
        tag = F.concat(kind, F.length(d).cast("string"))
        halves = feistel(d.substr(F.lit(1), u), d.substr(u + 1, v), _ten_to(u), _ten_to(v), tag, key)
        return let(halves, lambda s: F.concat(F.lpad(s["a"].cast("string"), u, "0"), F.lpad(s["b"].cast("string"), v, "0")))

    return let(digits, of)


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(
            F.concat(s["o"], F.when(digit, digits.substr(s["i"], F.lit(1))).otherwise(c)).alias("o"),
            (s["i"] + F.when(digit, 1).otherwise(0)).alias("i"),
        )

    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("i"))
    return F.aggregate(F.split(shape, ""), start, step)["o"]


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _card(m: Column, key: str) -> Column:
    """``m``, a card number, with its pseudonym."""

    def of(d: Column) -> Column:
        body = permuted_digits(d.substr(F.lit(1), F.length(d) - 1), "card", key)
        tens = F.array(*[F.lit(str(i)) for i in range(10)])
        valid = let(body, lambda b: F.concat(b, F.filter(tens, lambda c: luhn(F.concat(b, c)))[0]))
        return refilled(m, valid)

    return let(only_digits(m), of)


def _cards(m: Column, key: str) -> Column:
    """A run of digits: a struct of the run with its cards replaced (o) and their number (n)."""

    def of(parts: Column) -> Column:
        window = lambda i, k: F.array_join(F.slice(parts, i + 1, k), "")
        holds = lambda d: F.length(d).between(13, 19) & luhn(d)

        def step(s: Column, i: Column) -> Column:
            """Replace the longest card that starts with part ``i``, unless an earlier one reaches beyond it."""
            sizes = F.sequence(F.least(F.size(parts) - i, F.lit(19)), F.lit(1), F.lit(-1))
            size = F.get(F.filter(sizes, lambda k: let(only_digits(window(i, k)), holds)), F.lit(0))
            start = window(i, F.lit(1))
            # Only a separator can stand before the card's first digit.
            at = lambda k: let(window(i, k), lambda w: F.concat(F.regexp_extract(w, "^[ -]?", 0), _card(F.regexp_replace(w, "^[ -]", ""), key)))
            next_ = lambda o, i, n: F.struct(o.alias("o"), i.cast("int").alias("i"), n.cast("int").alias("n"))
            here = let(size, lambda k: F.when(k.isNull(), next_(F.concat(s["o"], start), i + 1, s["n"])).otherwise(next_(F.concat(s["o"], at(k)), i + k, s["n"] + 1)))
            return F.when(i < s["i"], s).otherwise(here)

        def block(s: Column, k: Column) -> Column:
            """The state after the parts from ``k`` on; only here the long text of all parts so far is copied."""
            start = F.struct(F.lit("").alias("o"), s["i"].alias("i"), s["n"].alias("n"))
            done = F.aggregate(F.sequence(k, F.least(k + BLOCK, F.size(parts)) - 1), start, step)
            return let(done, lambda d: F.struct(F.concat(s["o"], d["o"]).alias("o"), d["i"].alias("i"), d["n"].alias("n")))

        first = F.struct(F.lit("").alias("o"), F.lit(0).alias("i"), F.lit(0).alias("n"))
        return F.aggregate(F.sequence(F.lit(0), F.size(parts) - 1, F.lit(BLOCK)), first, block)

    return let(F.regexp_extract_all(m, F.lit(r"[ -]?\d+"), F.lit(0)), lambda p: let(of(p), lambda s: F.struct(s["o"].alias("o"), s["n"].alias("n"))))


def _mod97(text: Column) -> Column:
    """The remainder by 97 of letters and digits read as numbers (A is 10)."""
    number = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    return F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""),
        F.lit(0),
        lambda s, c: (s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + number(c)) % 97,
    )


def _iban(m: Column, key: str) -> Column:
    def of(c: Column) -> Column:
        land, rest = c.substr(F.lit(1), F.lit(2)), c.substr(F.lit(5), F.length(c))
        new = let(rest, lambda r: F.when(F.length(only_digits(r)) >= 2, refilled(r, permuted_digits(only_digits(r), "iban", key))).otherwise(r))
        both = let(new, lambda n: F.concat(F.lpad((98 - _mod97(F.concat(n, land, F.lit("00")))).cast("string"), 2, "0"), n))
        valid = _mod97(F.concat(rest, c.substr(F.lit(1), F.lit(4)))) == 1
        return F.when(valid, let(both, lambda b: refilled(m, only_digits(b)))).otherwise(m)

    return let(F.regexp_replace(m, " ", ""), of)


def _phone(m: Column, key: str) -> Column:
    """The country code and the first digit after it stay; a number with too few or too many digits stays whole."""

    def of(d: Column) -> Column:
        two = F.substring(d, 1, 2).cast("int").isin(*TWO_DIGIT_CODES)
        short = d.substr(F.lit(1), F.lit(1)).isin("1", "7")
        code = F.when(short, 1).when(two, 2).otherwise(3)

        def changed(c: Column) -> Column:
            kept, rest = d.substr(F.lit(1), c + 1), d.substr(c + 2, F.length(d))
            tag = F.concat(F.lit("phone"), d.substr(F.lit(1), c))
            fits = F.when(c == 1, F.length(d) == 11).otherwise(F.length(d).between(8, 15))
            return F.when(fits, refilled(m, F.concat(kept, permuted_digits(rest, tag, key)))).otherwise(m)

        return let(code, changed)

    return let(only_digits(m), of)


def _ssn(m: Column, key: str) -> Column:
    """Area, group and serial are numbered among those that can be issued (898, 99 and 9,999), permuted and written back."""
    part = lambda i, n: F.substring(m, i, n).cast("long")
    area = let(part(1, 3), lambda a: F.when(a > 666, a - 2).otherwise(a - 1))
    serials = F.lit(9999).cast("long")
    halves = feistel(area * 99 + part(5, 2) - 1, part(8, 4) - 1, F.lit(898 * 99).cast("long"), serials, F.lit("ssn"), key)
    two = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")

    def shown(s: Column) -> Column:
        a = F.floor(s["a"] / 99)
        return F.concat_ws("-", two(F.when(a >= 665, a + 2).otherwise(a + 1), 3), two(s["a"] % 99 + 1, 2), two(s["b"] + 1, 4))

    return let(halves, shown)


def _ip(m: Column, key: str) -> Column:
    def of(p: Column) -> Column:
        octet = lambda i: p[i].cast("long")
        size = F.lit(65536).cast("long")
        halves = feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), size, size, F.lit("ip"), key)
        parts = lambda s: [F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256]
        return let(halves, lambda s: F.concat_ws(".", *[x.cast("long").cast("string") for x in parts(s)]))

    return let(F.split(m, r"\."), of)


def _date(m: Column, key: str) -> Column:
    """A slash date is read day first, or month first if it cannot be."""
    forms = ["yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy"]
    parsed = [(f, F.try_to_timestamp(m, F.lit(f)).cast("date")) for f in forms]
    found = F.coalesce(*[F.when(d.isNotNull(), F.struct(F.lit(f).alias("f"), d.alias("d"))) for f, d in parsed])
    x, y = (F.lit(n).cast("long") for n in DAY_HALVES)

    def of(s: Column) -> Column:
        day = F.datediff(s["d"], F.lit(FIRST_DAY).cast("date")).cast("long")
        new = feistel(F.floor(day / DAY_HALVES[1]), day % DAY_HALVES[1], x, y, F.lit("date"), key)
        moved = let(new, lambda h: F.date_add(F.lit(FIRST_DAY).cast("date"), (h["a"] * DAY_HALVES[1] + h["b"]).cast("int")))
        shown = let(moved, lambda d: F.coalesce(*[F.when(s["f"] == f, F.date_format(d, f)) for f in forms]))
        return F.when((day >= 0) & (day < DAY_HALVES[0] * DAY_HALVES[1]), shown).otherwise(m)

    return let(found, lambda s: F.when(s.isNull(), m).otherwise(of(s)))


def _secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(?i:[a-z_-]+)\s*[=:]\s*[\"']?", 0)
    value = lambda h: m.substr(F.length(h) + 1, F.length(m))
    return let(head, lambda h: F.concat(h, F.substring(_digest(key, F.lit("secret"), value(h)), 1, 32)))


def pseudonym(m: Column, key: str) -> Column:
    """A struct of the pseudonym (o) of one match of ``ANY`` and the number of values that changed in it (n)."""
    whole = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
    email = F.concat(F.lit("u"), F.substring(_digest(key, F.lit("email"), F.lower(m)), 1, 12), F.lit("@mail.invalid"))
    access = F.concat(F.lit("AKIA"), F.upper(F.substring(_digest(key, F.lit("access"), m), 1, 16)))
    one = lambda new: let(new, lambda t: F.struct(t.alias("o"), (t != m).cast("int").alias("n")))
    other = (
        F.when(whole("email"), email)
        .when(whole("secret"), _secret(m, key))
        .when(whole("access_key"), access)
        .when(whole("iban"), _iban(m, key))
        .when(whole("phone"), _phone(m, key))
        .when(whole("ssn"), _ssn(m, key))
        .when(whole("date"), _date(m, key))
        .when(whole("ip"), _ip(m, key))
    )
    return let(other, lambda t: F.when(t.isNull(), _cards(m, key)).otherwise(one(t)))


def replaced(text: Column, key: str) -> Column:
    """A struct of the text with pseudonyms and the number of matches that changed."""

    def of(found: Column) -> Column:
        new = F.transform(found, lambda m: pseudonym(m, key))

        def merged(n: Column) -> Column:
            rest = F.split(text, ANY, -1)
            put = F.transform(n, lambda x: x["o"])
            whole = F.array_join(F.zip_with(rest, F.concat(put, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
            changed = F.aggregate(n, F.lit(0), lambda s, x: s + x["n"])
            return F.struct(whole.alias("text"), changed.cast("long").alias("n"))

        none = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
        return F.when(F.size(found) == 0, none).otherwise(let(new, merged))

    some = let(F.regexp_extract_all(text, F.lit(ANY), 0), of)
    return F.when(text.rlike(HINT), some).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n")))


def pseudonymize(docs: DataFrame, key: str, column: str = "text", counted: str = "n_replaced") -> DataFrame:
    """``docs`` with the texts of ``column`` replaced and the number of values that changed (in place of a column of that name)."""
    # The whole row travels as one column, so that its names clash with none of ours.
    both = docs.select(F.struct(*docs.columns).alias("row"), replaced(F.col(column), key).alias("pii"))
    kept = [F.col("pii.text").alias(c) if c == column else F.col("row")[c].alias(c) for c in docs.columns if c != counted]
    return both.select(*kept, F.coalesce(F.col("pii.n"), F.lit(0)).cast("long").alias(counted))


def session_key(spark: SparkSession) -> str:
    """The key that the session names in ``KEY_SETTING``; else one drawn for it, the same for all its queries."""
    if not (key := spark.conf.get(KEY_SETTING, None)):
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def digest(docs: DataFrame) -> DataFrame:
    return pseudonymize(docs.select("doc_id", "text"), session_key(docs.sparkSession))
