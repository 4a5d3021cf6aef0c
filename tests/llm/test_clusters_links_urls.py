"""Centroid clustering, token alignment and URL filters against brute force, and on odd rows."""

import hashlib
import random
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from moodweave.llm import lloyd, tokenlink, urlfilter

MOST = 2**63 - 1


# ---- centroid clustering ----
def brute_clusters(rows, k, rounds, scale, width):
    """Lloyd's rounds over all rows, in Python integers."""
    most = lloyd.bound(width)
    kept = [(i, [int(np.floor(np.clip(np.float64(x) * scale, -most, most))) for x in e]) for i, e in rows if e is not None and len(e) == width and all(x is not None and np.isfinite(x) for x in e)]
    first = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[0] or 0, r[1])
    centroids = [q for _, q in sorted(kept, key=first)[:k]]
    square = lambda q, c: sum((x - y) ** 2 for x, y in zip(q, c, strict=True))

    def assign():
        return [min((square(q, c), j) for j, c in enumerate(centroids)) for _, q in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            own = [q for (_, q), (_, n) in zip(kept, at, strict=True) if n == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign()
    per = Counter()
    for d, j in at:
        per[j] += d
    whole = min(sum(per.values()), MOST)
    name = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return Counter((i, j, d, min(per[j], MOST), whole, name(centroids[j])) for (i, _), (d, j) in zip(kept, at, strict=True))


@pytest.fixture(scope="module")
def vectors():
    """Ties, repeats, rows and ids that are shared or missing, and vectors that take no part."""
    rng = random.Random(3)
    some = [[rng.choice([-1.5, -0.5, 0.0, 0.25, 0.7]) for _ in range(4)] for _ in range(60)]
    rows = [(i, e) for i, e in enumerate(some)] + [(i, some[0]) for i in range(100, 180)] + [(7, some[8]), (7, some[7]), (None, some[9]), (None, some[9])]
    odd = [None, [], [1.0, 2.0], [1.0, None, 1.0, 1.0], [1.0, float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0], [1.0] * 5]
    return rows + [(200 + i, e) for i, e in enumerate(odd)] + [(300, [-0.0, 0.0, 1e-9, -1e-9])]


def table(spark, rows):
    return spark.createDataFrame([(i, e, "x", 1, 2) for i, e in rows], "vec_id long, embedding array<float>, q string, n long, cluster long")


@pytest.mark.parametrize(("k", "rounds"), [(5, 3), (1, 1), (16, 0), (200, 2)])
def test_clusters(spark, vectors, k, rounds):
    expected = brute_clusters([(i, None if e is None else [None if x is None else np.float32(x) for x in e]) for i, e in vectors], k, rounds, 64, 4)
    for parts in (1, 7):
        assert Counter(map(tuple, lloyd.cluster(table(spark, vectors).repartition(parts), k, rounds, width=4).collect())) == expected


def test_clusters_of_large_components(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * 2.0 ** rng.randint(0, 90) for _ in range(4)]) for i in range(40)] + [(99, [1e30, -1e30, 0.0, 1.0])] * 3
    expected = brute_clusters(rows, 4, 3, 64, 4)
    assert Counter(map(tuple, lloyd.cluster(table(spark, rows), 4, width=4).collect())) == expected


def test_empty_clusters_stay(spark):
    rows = [(i, [0.0, 0.0]) for i in range(30)] + [(50, [5.0, 5.0])]
    out = lloyd.cluster(table(spark, rows), 16, width=2).collect()
    assert Counter(map(tuple, out)) == brute_clusters(rows, 16, 3, 64, 2)
    kept = lloyd.quantised(table(spark, rows), width=2)
    assert len(lloyd.fit(kept, 16)[1]) == 16


def test_hot_vectors_are_joined_by_broadcast_and_others_by_shuffle(spark, vectors, monkeypatch):
    expected = brute_clusters([(i, None if e is None else [None if x is None else np.float32(x) for x in e]) for i, e in vectors], 5, 3, 64, 4)
    for share in (0.02, 2.0, 0.0):
        monkeypatch.setattr(lloyd, "HOT", share)
        assert Counter(map(tuple, lloyd.cluster(table(spark, vectors), 5, width=4).collect())) == expected


def test_distances_are_exact():
    rng = np.random.default_rng(1)
    for most in (5, 1 << 12, lloyd.bound(64)):
        x, c = rng.integers(-most, most + 1, (50, 64)), rng.integers(-most, most + 1, (6, 64))
        expected = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, q, strict=True)), j) for j, q in enumerate(c)) for r in x]
        at, d = lloyd.nearest(x, c)
        assert list(zip(d.tolist(), at.tolist(), strict=True)) == expected


# ---- token alignment ----
def bytes_of(token):
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    return bytes(back[c] for c in token)


def brute_links(texts):
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    each = []
    for text in texts:
        whole = " " + (text or "")
        ids = (a.encode(whole, add_special_tokens=False).ids, b.encode(text or ""))
        spelled = [[bytes_of(a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
        if not text or any(b"".join(s) != whole.encode() for s in spelled):
            each.append(None)
            continue
        groups, i, j, at_a, at_b, own = [], 0, 0, 0, 0, ([], [])
        while i < len(ids[0]) or j < len(ids[1]):  # two pointers, one token at a time
            if at_a <= at_b:
                own[0].append(ids[0][i])
                at_a, i = at_a + len(spelled[0][i]), i + 1
            else:
                own[1].append(ids[1][j])
                at_b, j = at_b + len(spelled[1][j]), j + 1
            if at_a == at_b:
                groups.append(own)
                own = ([], [])
        each.append((len(ids[0]), len(ids[1]), groups))
    links = [None if e is None else Counter(p for x, y in e[2] for p in product(x, y)) for e in each]
    counts = Counter(p for c in links if c for p in c)
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for e, c in zip(each, links, strict=True):
        if e is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in e[2])
        out.append((e[0], e[1], len(e[2]), sum(c.values()), sum(m for p, m in c.items() if counts[p] == best[p[0]]), sum(m * counts[p] for p, m in c.items()), hashlib.sha256(shown.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts(spark, sf):
    rng = random.Random(9)
    odd = ["", None, " ", "  two  spaces ", "\n\n\t x", "▁ looks like a space", "<|endoftext|> <s> </s> <unk> <0x41>", "漢字 テスト 🙂🙂 ﬁ ½ e\u0301", "a" * 400, "aaa\u00a0b \x1c c \x00", "don't WE'LL 12345 1,000.50", "\u200b\ufeff", "ß" * 300]
    mixed = ["".join(rng.choice(["word ", "Unter", "é", " ", "  ", "\n", "9", "漢", "🙂", "-", "the ", "'s"]) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    real = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    return [*odd, *mixed, *real, real[0], real[0]]


def linked(spark, texts):
    return spark.createDataFrame([(None if i == 3 else i // 2, t, 1, "g", 2) for i, t in enumerate(texts)], "doc_id long, text string, row long, pairs string, n_a int")


@pytest.mark.parametrize("most", [400_000, 60, 0])
def test_links(spark, texts, most):
    """However few of the pairs may be broadcast."""
    expected = Counter((None if i == 3 else i // 2, *r) for i, r in enumerate(brute_links(texts)))
    out = tokenlink.figures(linked(spark, texts), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), most)
    assert Counter(map(tuple, out.collect())) == expected


def test_groups_and_pairs_of_a_text(spark):
    rows = tokenlink.align(linked(spark, ["hello hello", None]), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), whole=True).collect()
    assert rows[0]["groups"] and hashlib.sha256(rows[0]["groups"].encode()).hexdigest() == rows[0]["groups_sha256"] and sum(rows[0]["times"]) == rows[0]["n_links"]
    assert rows[1]["groups"] is None and rows[1]["groups_sha256"] == "" and rows[1]["pairs"] == []


def test_links_are_made_in_parts(texts, monkeypatch):
    both = tokenlink.aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    known = [t or "" for t in texts]
    whole = both.aligned(known, False)
    monkeypatch.setattr(tokenlink, "LINKS", 7)
    parts = both.aligned(known, False)
    assert all(list(x) == list(y) for c in ("pairs", "times") for x, y in zip(whole[c], parts[c], strict=True))


# ---- URL filters ----
def brute_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3], max(fit)[4]) if fit else (host, path, None, default)


URLS = [
    None, "", "no scheme", "http://", "http://com/", "HTTP://WWW.Example.COM/en/a?x=1#y", "https://example.com/en", "https://example.com/en/", "http://a.b.example.com/en/x://y", "http://example.com?en/",
    "http://xexample.com/en/", "http://example.com./en/", "http://net/es/", "ftp://x.net/es/q", "ftp://x.NET/fr/", "ftp://x.net/ES/", "http://.com/", "http://a..com/", "http://İ.com/", "http://user@www.example.com:80/en/", "http://u/net/fr/", "x://a.net#/es/", "://com/", "http://www.example.com/en/", "http://sub.www.example.com/en/z", "http://a\nb.net/fr/\n",
]


def test_verdicts(spark):
    rows = [(i, u, "h", "p", "r", "k", 1) for i, u in enumerate(URLS)] + [(None, URLS[5], None, None, None, None, None)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, keys string, at int")
    out = urlfilter.digest(pages)
    assert Counter(map(tuple, out.collect())) == Counter((r[0], *brute_verdict(r[1], urlfilter.RULES)) for r in rows)
    import duckdb

    pages = pages.select("page_id", "url").toArrow()  # noqa: F841
    theirs = duckdb.sql(urlfilter.SQL).fetchall()
    assert Counter(theirs) == Counter((r[0], *brute_verdict(r[1], urlfilter.RULES)) for r in rows)


@pytest.mark.parametrize("most", [10**6, 40])
def test_long_lists_of_rules(spark, most):
    """Hundreds of rules of many shapes, in one cascade or in parts; a hot host; paths that no rule has."""
    rng = random.Random(8)
    hosts = [".".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(80)]
    paths = ["", "/", "/a", "/a/b", "/漢", "/b/"]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((rng.choice(hosts), rng.choice(paths)) for _ in range(250))}.values())
    urls = [f"http://{rng.choice(['', 'x.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'z', '/q?a'])}" for _ in range(1500)] + ["http://x.hot.a/a/b"] * 800
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(5)
    out = urlfilter.judge(pages, urlfilter.rule_table(spark, rules), "block", most)
    assert Counter(map(tuple, out.collect())) == Counter((i, *brute_verdict(u, rules, "block")) for i, u in enumerate(urls))
    assert urlfilter.judge(pages, urlfilter.rule_table(spark, rules).limit(0)).where("rule IS NOT NULL OR verdict <> 'allow'").isEmpty()


def test_a_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("a"), F.xxhash64(F.lit("second"), "id").alias("b"), "id")
    listed = keys.where("id % 7 = 0")
    cascade = urlfilter.Cascade.fit(listed, keys)
    rows = keys.toPandas()
    assert (cascade.holds(rows["a"].to_numpy(), rows["b"].to_numpy()) == (rows["id"] % 7 == 0)).all()
    assert 3 <= len(cascade.levels) < 40 and sum(x.size for x in cascade.levels) < 12 * listed.count()
    assert not urlfilter.Cascade.fit(listed.limit(0), keys).holds(rows["a"].to_numpy(), rows["b"].to_numpy()).any()
