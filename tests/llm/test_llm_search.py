"""Decontamination, URL filter, top-k search."""

import hashlib
import math
import re
from collections import Counter

import pytest
from cases import frame, plain, rows, same
from pyspark.sql import functions as F

from storyloom.llm import decontaminate as deco
from storyloom.llm import top_k, url_filter

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def contaminated(docs, items, window=10):
    phrases = {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - window + 1)) if w else []:
            phrases.setdefault(tuple(w[a : a + window]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(p) for p in phrases}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in phrases:
                    hit |= set(range(a, a + n))
                    found |= phrases[tuple(w[a : a + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_equals_brute_force(spark):
    data = rows()
    long = data[34][1]
    items = [(1, " ".join(words(data[0][1])[2:17])), (2, "ALPHA beta"), (10, "alpha BETA"), (3, None), (4, "..."), (5, " ".join(words(long)[4000:4012])), (6, "neverseen word"), (2, "x")]
    bench = spark.createDataFrame([(i, t, "w", 3) for i, t in items], "item_id long, text string, word string, pos int")
    got = deco.decontaminate(frame(spark), bench).drop("text_hash").collect()
    same([tuple(r) for r in got], contaminated([r[:2] for r in data], items))
    kept = deco.clean(frame(spark), bench)
    assert kept.columns == frame(spark).columns
    assert kept.count() == sum(not r[5] for r in contaminated([r[:2] for r in data], items))


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in deco.decontaminate(plain(spark, [(1, "a b"), (2, None)]), none).collect()} == {0}
    assert deco.decontaminate(plain(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_proximity_finds_a_phrase_with_a_word_put_in(spark):
    item = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = plain(spark, [(1, "one two three four five six seven eight nine ten"), (2, "one two x three four five six seven eight nine ten"), (3, "ten nine eight")])
    found = deco.matches(docs, item, slack=2)
    assert {r.doc_id for r in found["exact"].collect()} == {1}
    assert {r.doc_id for r in found["near"].collect()} == {1, 2}


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
URLS = [
    (1, "http://A.Example.NET/en/x?y"), (2, "http://example.net/de/"), (3, "ftp://notexample.net"), (4, "http://x.example.com/de/1#a"), (5, "http://y.org/fr/1"),
    (6, None), (7, "no scheme"), (8, "http://y.org/FR/1"), (9, "http://net/"), (9, "http://net/"), (None, "x://net?/"), (11, "a://b://c/d"), (12, "http://ÄX.org/fr/é?q"),
]


def test_url_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in URLS], "page_id long, url string, host string, rule string")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in url_filter.url_filter(pages, RULES).collect()}
    assert got[1, "a.example.net", "/en/x"] == ("example.net/en/", "allow")
    assert got[2, "example.net", "/de/"] == ("net/", "block")
    assert got[3, "notexample.net", ""][0] is None
    assert got[4, "x.example.com", "/de/1"] == ("example.com/de/", "block")
    assert got[5, "y.org", "/fr/1"] == ("org/fr/", "allow")
    assert got[6, "", ""][0] is None and got[7, "", ""][0] is None and got[8, "y.org", "/FR/1"][0] is None
    assert got[9, "net", "/"] == ("net/", "block") and got[None, "net", ""][0] is None
    assert (11, "b:", "//c/d") in got and got[12, "Äx.org", "/fr/é"] == ("org/fr/", "allow")
    assert url_filter.url_filter(pages, RULES).count() == len(URLS)


def test_url_filter_without_training_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [r.verdict for r in url_filter.url_filter(pages, RULES).collect()] == ["allow"]
    assert url_filter.url_filter(pages.limit(0), RULES).count() == 0


def test_gram_ratios_equal_witten_bell_by_hand(spark):
    train = [("allow", "ab.x", "/a"), ("allow", "abb.x", "/"), ("block", "ba.y", "/b"), ("block", "bab.y", "/bb")]
    order = 2
    counts = {"allow": Counter(), "block": Counter()}
    for v, h, p in train:
        s = url_filter.START * order + h + p + url_filter.END
        for k in range(order, len(s)):
            for j in range(order + 1):
                counts[v][s[k - j : k], s[k]] += 1

    def prob(v, gram):
        p = 1 / url_filter.ALPHABET
        for j in range(order + 1):
            h, c = gram[order - j : order], gram[order]
            seen = {x: n for (g, x), n in counts[v].items() if g == h}
            if seen:
                p = (seen.get(c, 0) + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p

    asked = ["ab.", "ba.", "zzz", "bb/"]
    got = url_filter.gram_ratios(spark.createDataFrame(train, "verdict string, host string, path string"), spark.createDataFrame([(g,) for g in asked], "gram string"), order)
    for r in got.collect():
        assert abs(r.ratio - 1e6 * (math.log(prob("allow", r.gram)) - math.log(prob("block", r.gram)))) <= 1


def test_model_tells_the_kinds_apart(spark):
    data = [(i, f"http://site{i}.org/fr/article{i}") for i in range(60)] + [(100 + i, f"http://spam{i}.net/zzqq{i}") for i in range(60)]
    data += [(500, "http://other.info/article77"), (501, "http://other.info/zzqqzzqq77")]
    got = {r.page_id: r.verdict for r in url_filter.url_filter(spark.createDataFrame(data, "page_id long, url string"), RULES).collect()}
    assert (got[500], got[501]) == ("allow", "block")


def test_top_k_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    data = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(260)]
    data += [(300, data[0][1]), (301, data[0][1]), (302, None), (303, [None] * 5), (304, [float("nan")] * 5), (305, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, data[1][1])]
    data += [data[4], (5, [0.0] * 5), (100, data[7][1]), (100, data[100][1]), (200, [0.5] * 5), (400, [1.0, 2.0]), (401, [3.0, 4.0]), (402, [])]
    frame = spark.createDataFrame([(i, v, 1, "d") for i, v in data], "vec_id long, embedding array<float>, dim int, near string")
    import struct

    single = [(i, v and [x if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in v]) for i, v in data]
    got = [tuple(r) for r in top_k.top_k(frame, F.col("vec_id") % 100 == 0, 10, pivots=4, block=16).collect()]
    same(got, top_k.brute_force(single, 10))
    assert top_k.top_k(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_rows_of_one_id_are_candidates_of_their_own(spark):
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [5.0, 0.0]), (2, [2.0, 0.0]), (0, [3.0, 0.0])]
    got = sorted(tuple(r) for r in top_k.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, 10).collect())
    assert got == top_k.brute_force(data, 10) and (0, 1, 1, 5 * 1024 * 1024) in got and len(got) == 8


@pytest.mark.parametrize("k", [1, 3])
def test_all_equal_vectors_go_by_id(spark, k):
    frame = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(12)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in top_k.top_k(frame, F.col("vec_id") % 100 == 0, k).collect())
    assert got == [(0, r, r, 1024 * 1024) for r in range(1, k + 1)]
