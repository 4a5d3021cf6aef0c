"""Line deduplication by a segment-partition edit join.

Lines are grouped by equal text, at any length. Two texts are near if their edit distance is at most the
threshold of the shorter one: two edits from 24 characters on, one from 12, none below (``STEPS``).
A line is split into threshold-plus-one segments, posted under (length, segment number,
content); it probes, for its own and the next smaller lengths, the substrings that multi-match-aware position
windows allow. Two near lines share such a key at least once, and what stands before and after the shared segment
differs by as many edits together. So where a key is crowded, its lines are split and joined once more by what is left of them
beside the segment, as long as that helps (``DEPTH`` times); lines that still crowd a key are compared as pairs of parts. Candidates are verified by a
banded bit-parallel edit distance. An occurrence of a line goes if it isn't the first of its text, or
if a near line stands first at an earlier place; places are ordered by doc_id,
a hash of the whole text and line number, so that a removal only reaches the text it was found in.

Defined results: lines without a word (empty ones, white space) always stay; a null text stays null, and a text whose lines all
go is left empty; of rows that repeat a doc_id (or its absence) with the same text one stands for all, and the others keep only
lines without a word, and with different texts they have places of their own; a null doc_id
orders before all others; an empty table gives no rows; further columns are kept.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, gapless, id_key, plain, release, row_key, stage
from .quality_rules import let

#: (least length, edits): what the shorter line of a pair allows, the longest first.
STEPS = ((24, 2), (12, 1))
TAU = STEPS[0][1]
_WORD = r"[^\x20\x09-\x0D]"
#: Lines that share a key without crowding it, and times that lines of crowded keys are split again.
CROWD, DEPTH = 1000, 2


def allowed(length: int) -> int:
    """Edits by which another line may differ from a line of this length that isn't longer."""
    return next((tau for least, tau in STEPS if length >= least), 0)


def _shared(a: str, b: str) -> int:
    """Length of the common prefix, by bisection."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def within(a: str, b: str, tau: int = TAU) -> bool:
    """Whether the edit distance is ``tau`` or less: bit-parallel columns of a band of 2 tau + 1 rows.

    Bit k of the window stands for row ``column - tau + k``; the window moves down by one row a column, so
    that the vertical differences are shifted before they meet the next character. For each character a table
    holds the rows of the window in which it stands; a column shifts the entry of its own character only.
    """
    if abs(len(a) - len(b)) > tau:
        return False
    head = _shared(a, b)
    tail = _shared(a[head:][::-1], b[head:][::-1])
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    m, n = len(a), len(b)
    if min(m, n) <= tau:
        return max(m, n) <= tau or _distance(a, b) <= tau
    width = 2 * tau + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    vp, vn, score = full & ~((1 << tau) - 1), 0, tau  # above the first row there are no steps
    last = m - tau  # from this column on the window's lowest row is beyond the pattern
    cell = tau
    rows: dict[str, tuple[int, int]] = {}  # character -> its rows, as bits of the window of a column
    for i in range(min(tau, m)):
        rows[a[i]] = (rows.get(a[i], (0, 0))[0] | 1 << (i + tau), 0)
    for j in range(n):
        if j + tau < m:
            c = a[j + tau]
            bits, at = rows.get(c, (0, j))
            rows[c] = (bits >> (j - at) | top, j)
        bits, at = rows.get(b[j], (0, j))
        eq = bits >> (j - at)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        shifted = d0 >> 1
        vp = (hn | ~(shifted | hp)) & full
        vn = hp & shifted
        if j < last:
            score += 0 if d0 & top else 1
            cell = width - 1
        else:
            cell -= 1
            bit = 1 << cell
            score += bool(hp & bit) - bool(hn & bit)
        if score > 2 * tau + abs(m - n) + tau:
            return False
    return score <= tau


def _distance(a: str, b: str) -> int:
    """Edit distance in rows, for a remainder of at most a few characters on one side."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near(a: str, b: str) -> bool:
    """Whether two lines are near."""
    tau = allowed(min(len(a), len(b)))
    return a == b if not tau else within(a, b, tau)


def _segment(length: Column, i: int, tau: int) -> tuple[Column, Column]:
    """First position (from 1) and size of segment ``i`` of a line of this length; the last are longer."""
    base, short = F.floor(length / (tau + 1)).cast("int"), F.lit(tau + 1) - length % (tau + 1)
    return F.lit(1) + base * i + F.greatest(F.lit(i) - short, F.lit(0)), base + (F.lit(i) >= short).cast("int")


def keys(line: Column) -> Column:
    """Hashes of the line's own segments, threshold-plus-one of them, and then of the substrings that it looks up."""
    size = F.length(line)

    def key(length: Column, i: int, at: Column, n: Column) -> Column:
        return F.xxhash64(length, F.lit(i), F.substring(line, at, n))

    def posts(tau: int) -> Column:
        return F.array(*[key(size, i, *_segment(size, i, tau)) for i in range(tau + 1)])

    def probes(gap: int, tau: int) -> Column:
        """What meets the segments of a line that is ``gap`` characters shorter and allows ``tau`` edits."""
        length, out = size - gap, []
        for i in range(tau + 1):
            # Errors left of the segment, and right of it, bound how far it can have moved.
            low, high = max(-i, gap - (tau - i)), min(i, gap + (tau - i))
            at, n = _segment(length, i, tau)
            out += [key(length, i, at + off, n) for off in range(low, high + 1) if gap or off]
        return F.array(*out)

    def by_length(length: Column, of, gap: int = 0) -> Column:
        out = F.array().cast("array<bigint>")
        for least, tau in reversed(STEPS):
            if gap <= tau:
                out = F.when(length >= least, of(tau)).otherwise(out)
        return out

    looked_up = [by_length(size - gap, lambda tau, gap=gap: probes(gap, tau), gap) for gap in range(TAU + 1)]
    return F.concat(by_length(size, posts), *looked_up)


def occurrences(docs: DataFrame) -> DataFrame:
    """A row per line: doc_id, did, tid, line_no; for lines that hold a word, also h1, h2 (a 128-bit hash) and keys."""
    split = F.posexplode(F.split(plain(F.col("text")), "\n")).alias("line_no", "line")
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), split)
    held = lambda c: F.when(F.col("line").rlike(_WORD), c)
    hashes = [held(F.xxhash64("line")).alias("h1"), held(F.xxhash64(F.lit(11), F.col("line"))).alias("h2")]
    return lines.select("doc_id", "did", "tid", "line_no", *hashes, held(keys(F.col("line"))).alias("keys"), F.length("line").alias("n_chars"))


def texts(lines: DataFrame) -> DataFrame:
    """A row per distinct line: h1, h2, the least did among its places and its number of places."""
    return lines.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("did").alias("d"), F.count("*").alias("n"))


def crowd(lines: DataFrame) -> DataFrame:
    """The posts and probes (key, own, h1) of distinct lines whose key another line posts; staged."""
    posts = F.lit(0)
    for least, tau in reversed(STEPS):
        posts = F.when(F.col("n_chars") >= least, F.lit(tau + 1)).otherwise(posts)
    dealt = lines.where("h1 IS NOT NULL").select("h1", posts.alias("posts"), F.posexplode("keys").alias("at", "key"))
    dealt = dealt.select("key", (F.col("at") < F.col("posts")).alias("own"), "h1")
    # Most keys belong to one line. They are told from the others by plain aggregates, which are combined before they move.
    met = dealt.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.max("own").alias("posted"))
    met = stage(met.where("a <> b AND posted").select("key"))
    out = stage(dealt.join(checked(met), "key", "left_semi").distinct())
    release(met)
    return out


def _parity(items: Column) -> Column:
    """64 bits: whether an odd number of items falls to each."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    return F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(bit(x)))


def signatures(line: Column) -> Column:
    """Parities of a line's characters and of its pairs of characters.

    An edit flips at most two bits of the first and four of the second.
    """
    twos = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.concat(a, b))
    return let(F.split(line, ""), lambda c: F.struct(_parity(c).alias("ones"), _parity(twos(c)).alias("twos")))


def first_places(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """h1, h2, n and the first place (did, tid, line_no) of wanted lines (h1, h2, d, n; staged); staged."""
    at = lines.select("did", "tid", "line_no", "h1", "h2").join(checked(wanted), ["h1", "h2"]).where("did = d")
    place = F.min(F.struct("did", "tid", "line_no")).alias("first")
    return stage(at.groupBy("h1", "h2").agg(place, F.max("n").alias("n")))


def lines_of(docs: DataFrame, places: DataFrame) -> DataFrame:
    """h1, h2, first, line and signatures of lines at known first places, from their documents; staged."""
    spot = F.struct(F.col("first.line_no").alias("line_no"), "h1", "h2")
    by_doc = stage(places.groupBy("first.did", "first.tid").agg(F.collect_list(spot).alias("spots")))
    here = docs.select(*row_key(), F.col("text").alias("text")).join(checked(by_doc), ["did", "tid"])
    split = F.split(plain(F.col("text")), "\n")
    found = let(split, lambda s: F.transform("spots", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["line_no"].alias("line_no"), F.get(s, x["line_no"]).alias("line"))))
    rows = here.select("did", "tid", F.explode(found).alias("x")).select("x.h1", "x.h2", F.struct("did", "tid", "x.line_no").alias("first"), "x.line")
    # Repeated rows give their lines once.
    rows = rows.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.max("line").alias("line"))
    out = stage(rows.select("h1", "h2", "first", "line", F.length("line").alias("size"), signatures(F.col("line")).alias("sig")))
    release(by_doc)
    return out


def _parts(text: Column, length: Column, gap: int, tau: int, own: bool, *prior: Column) -> Column:
    """What a text posts (if ``own``) and looks up among texts of ``length``, which is ``gap`` less than its own: structs of
    key, own, at, n (the substring), length, gap and tau."""
    out = []
    for i in range(tau + 1):
        # Errors left of the segment, and right of it, bound how far it can have moved.
        low, high = max(-i, gap - (tau - i)), min(i, gap + (tau - i))
        at, n = _segment(length, i, tau)
        for off in range(low, high + 1):
            key = F.xxhash64(*prior, length, F.lit(i), F.substring(text, at + off, n))
            out.append(F.struct(key.alias("key"), F.lit(own and not off).alias("own"), (at + off).alias("at"), n.alias("n"), length.alias("length"), F.lit(gap).alias("gap"), F.lit(tau).alias("tau")))
    return F.array(*out)


def _first_parts(line: Column) -> Column:
    """The keys of a whole line (those of ``keys``) with their places."""
    size = F.length(line)
    made = []
    for gap in range(TAU + 1):
        some = F.array().cast("array<struct<key: bigint, own: boolean, at: int, n: int, length: int, gap: int, tau: int>>")
        for least, tau in reversed(STEPS):
            if gap <= tau:
                some = F.when(size - gap >= least, _parts(line, size - gap, gap, tau, gap == 0)).otherwise(some)
        made.append(some)
    return F.concat(*made)


def _rest_parts() -> Column:
    """The keys of what is left of a line (columns text, length, gap, tau, own) that came by a crowded key."""
    out = None
    for tau in sorted({tau for _, tau in STEPS}):
        for gap in range(tau + 1):
            for own in (True, False) if not gap else (False,):
                fits = (F.col("tau") == tau) & (F.col("gap") == gap) & (F.col("own") == own)
                made = _parts(F.col("text"), F.col("length"), gap, tau, own, F.col("key"))
                out = F.when(fits, made) if out is None else out.when(fits, made)
    return out


def _without(part: str) -> list[Column]:
    """key, own, text, length, gap, tau: a text without the substring of one of its parts."""
    p = F.col(part)
    rest = F.concat(F.substring(F.col("text"), F.lit(1), p["at"] - 1), F.substring(F.col("text"), p["at"] + p["n"], F.length("text")))
    return [p["key"].alias("key"), p["own"].alias("own"), rest.alias("text"), (p["length"] - p["n"]).alias("length"), p["gap"].alias("gap"), p["tau"].alias("tau")]


def _crowded(rows: DataFrame) -> DataFrame:
    """key and number of parts of the keys of ``rows`` (key, own, h1) at which more pairs meet than ``CROWD`` lines have; staged."""
    sizes = rows.groupBy("key").agg(F.count_if("own").alias("posts"), F.count("*").alias("n"))
    return stage(sizes.where(F.col("posts") * F.col("n") > CROWD * CROWD).select("key", F.ceil(F.col("n") / CROWD).cast("int").alias("parts")))


def narrowed(known: DataFrame, near_keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``near_keys`` with crowded keys replaced by those of the rests of their lines, staged; and the rows (with parts) that no split helps."""
    crowded = _crowded(near_keys)
    if crowded.isEmpty():
        return near_keys, None
    fine = [near_keys.join(checked(crowded), "key", "left_anti")]
    theirs = stage(near_keys.join(checked(crowded), "key", "left_semi").select("h1").distinct())
    lines = known.join(checked(theirs), "h1", "left_semi").select("h1", F.col("line").alias("text"))
    part = lines.select("h1", "text", F.explode(_first_parts(F.col("text"))).alias("p"))
    rows = stage(part.select("h1", *_without("p")).join(checked(crowded), "key"))
    for _ in range(DEPTH):
        part = rows.select("h1", "text", F.explode(_rest_parts()).alias("p"))
        keyed = part.select("h1", "p.key", "p.own")
        met = keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.max("own").alias("posted"))
        met, again = stage(met.where("a <> b AND posted").select("key")), _crowded(keyed)
        fine.append(keyed.join(checked(met), "key", "left_semi").join(checked(again), "key", "left_anti").distinct())
        rows = stage(part.select("h1", *_without("p")).join(checked(again), "key"))
        if rows.isEmpty():
            break
    out = fine[0].select("key", "own", "h1")
    for more in fine[1:]:
        out = out.unionByName(more.select("key", "own", "h1"))
    return stage(out), None if rows.isEmpty() else rows.select("key", "own", "h1", "parts").distinct()


def links(known: DataFrame, near_keys: DataFrame) -> DataFrame:
    """Pairs (x earlier, y later; each first, h1, h2) of distinct near lines. ``known``: ``lines_of``; ``near_keys``: ``crowd``."""
    fine, crowded = narrowed(known, near_keys)
    signs = known.select("h1", "sig", "size")
    # Two posted lines meet once; a probing line meets every posted one.
    apart = (F.col("a.h1") < F.col("b.h1")) | (~F.col("b.own") & (F.col("a.h1") != F.col("b.h1")))
    flips = lambda c: F.bit_count(F.col(f"a.sig.{c}").bitwiseXOR(F.col(f"b.sig.{c}")))
    alike = (flips("ones") <= 2 * TAU) & (flips("twos") <= 4 * TAU) & (F.abs(F.col("a.size") - F.col("b.size")) <= TAU)
    signed = fine.join(signs, "h1")
    a, b = signed.where("own").alias("a"), signed.alias("b")
    met = a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & apart & alike)
    met = met.select(F.least("a.h1", "b.h1").alias("ah"), F.greatest("a.h1", "b.h1").alias("bh"))
    if crowded is not None:
        # Every part of the posting lines meets every part of all lines, each pair of parts as a key of its own.
        dealt = crowded.join(signs, "h1").withColumn("mine", F.pmod("h1", "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        a, b = dealt.where("own").alias("a"), dealt.alias("b")
        same = (F.col("a.key") == F.col("b.key")) & (F.col("a.mine") == F.col("b.other")) & (F.col("a.other") == F.col("b.mine"))
        more = a.join(b.hint("merge"), same & apart & alike)
        met = met.unionByName(more.select(F.least("a.h1", "b.h1").alias("ah"), F.greatest("a.h1", "b.h1").alias("bh")))
    pairs = stage(met.distinct())
    side = lambda t: known.select(F.col("h1").alias(f"{t}h"), F.struct("first", "h1", "h2").alias(f"{t}at"), F.col("line").alias(t))
    both = pairs.join(side("a"), "ah").join(side("b"), "bh")

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([near(s, t) for s, t in zip(a, b, strict=True)], dtype=bool)

    return both.where(verified("a", "b")).select(F.least("aat", "bat").alias("x"), F.greatest("aat", "bat").alias("y"))


def judged(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """The distinct lines that repeat or have links: h1, h2, first, n_links, near (an earlier line is linked); staged."""
    whole = stage(texts(lines))
    near_keys = crowd(lines)
    met = stage(near_keys.select("h1").distinct())
    marked = whole.join(checked(met), "h1", "left_semi").withColumn("met", F.lit(True))
    repeated = whole.where("n > 1").withColumn("met", F.lit(False))
    both = marked.unionByName(repeated).groupBy("h1", "h2").agg(F.max("d").alias("d"), F.max("n").alias("n"), F.max("met").alias("met"))
    both = stage(both)
    places = first_places(lines, both)
    candidates = stage(places.join(checked(stage(both.where("met").select("h1", "h2"))), ["h1", "h2"], "left_semi"))
    known = lines_of(docs, candidates)
    pairs = links(known, near_keys)
    ends = pairs.select("x.h1", "x.h2", F.lit(False).alias("later")).unionByName(pairs.select("y.h1", "y.h2", F.lit(True).alias("later")))
    linked = stage(ends.groupBy("h1", "h2").agg(F.count("*").alias("n_links"), F.max("later").alias("near")))
    found = places.join(checked(linked), ["h1", "h2"], "left").where("n > 1 OR n_links > 0")
    filled = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("near", F.lit(False)).alias("near")]
    out = stage(found.select("h1", "h2", "first", *filled))
    release(whole, near_keys, met, both, places, candidates, known, linked)
    return out


def twins(lines: DataFrame) -> DataFrame:
    """did and tid of the texts that several equal rows hold; staged."""
    rows = lines.where("line_no = 0").groupBy("did", "tid").agg(F.count("*").alias("n"))
    return stage(rows.where("n > 1").select("did", "tid"))


def numbered(rows: DataFrame, equal: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with ``copy``, their number among the rows of ``keys`` for texts of ``equal`` rows; 0 for all others.

    As such rows are alike, it doesn't matter which is which.
    """
    if equal.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    several = gapless(rows.join(checked(equal), ["did", "tid"], "left_semi"), list(keys), "copy").select(*rows.columns, "copy")
    return rows.join(checked(equal), ["did", "tid"], "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(several)


def removals(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """did, tid and the numbers of the text's lines that go; staged."""
    marked = judged(docs, lines)
    rows = lines.select("did", "tid", "line_no", "h1", "h2").join(checked(marked), ["h1", "h2"])
    gone = rows.where(F.col("near") | (F.struct("did", "tid", "line_no") != F.col("first")))
    out = stage(gone.groupBy("did", "tid").agg(F.collect_set("line_no").alias("gone")))
    release(marked)
    return out


def dedup(docs: DataFrame, counted: str = "n_removed") -> DataFrame:
    """``docs`` without the lines that go, and the number of them (in place of a column of that name)."""
    lines = stage(occurrences(docs))
    gone, equal = removals(docs, lines), twins(lines)
    release(lines)
    # The whole row travels as one column, so that its names clash with none of ours.
    rows = numbered(docs.select(*row_key(), F.struct(*docs.columns).alias("row")), equal, "did", "tid")
    rows = rows.join(checked(gone), ["did", "tid"], "left")
    text, again = F.col("row.text"), F.col("copy") > 0

    def left(s: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(s) - 1), F.coalesce("gone", F.array().cast("array<int>")))
        return F.when(again, F.filter(s, lambda x: ~x.rlike(_WORD))).otherwise(F.transform(stay, lambda i: F.get(s, i)))

    cut = let(F.split(text, "\n"), lambda s: let(left(s), lambda kept: F.struct(F.array_join(kept, "\n").alias("text"), (F.size(s) - F.size(kept)).alias("n"))))
    changed = text.isNotNull() & (again | F.col("gone").isNotNull())
    rows = rows.select("row", F.when(changed, cut).alias("cut"))
    names = [c for c in docs.columns if c != counted]
    new = F.coalesce("cut.text", "row.text").alias("text")
    return rows.select(*[new if c == "text" else F.col("row")[c].alias(c) for c in names], F.coalesce("cut.n", F.lit(0)).cast("long").alias(counted))


def digest(docs: DataFrame) -> DataFrame:
    """A row per line of each document: its class (the first place of its text), links and verdict.

    ``n_links`` counts the other texts that are near; the class of a line without a word is null.
    """
    lines = stage(occurrences(docs))
    marked = checked(judged(docs, lines))
    place = F.struct("did", "tid", "line_no")
    each = numbered(lines.select("doc_id", "did", "tid", "line_no", "h1", "h2"), twins(lines), "did", "tid", "line_no")
    known = each.join(marked, ["h1", "h2"], "left")
    known = known.withColumn("at", F.when(F.col("h1").isNotNull(), F.coalesce("first", place)))
    named = F.when(F.col("at.did") != id_key(F.lit(None)), F.col("at.did"))
    gone = F.col("near") | (place != F.col("at")) | ((F.col("copy") > 0) & F.col("h1").isNotNull())
    return known.select(
        "doc_id", "line_no", named.alias("class_doc_id"), F.col("at.line_no").alias("class_line_no"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(gone, F.lit(False)).alias("removed"),
    )
