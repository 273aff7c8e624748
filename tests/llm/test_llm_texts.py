"""Quality, language-model scores, sentence spans, personal data."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from cases import WORDS, frame, plain, rows, same, sentence
from pyspark.sql import functions as F

from storyloom.llm import brown, pii, quality, sentence_spans

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def junk(rng, k):
    w = sentence(rng, 40).split()
    return [" | ".join(w), " ".join(x + "%%%" for x in w), " ".join(x.upper() + "!!" for x in w), " ".join(x for x in w for _ in range(6))][k % 4]


def test_quality_rejects_junk_and_keeps_the_rest(spark):
    rng = random.Random(5)
    good = [" ".join(sentence(rng) for _ in range(6)) for _ in range(120)]
    bad = [junk(rng, k) for k in range(24)]
    got = {r.doc_id: r.keep for r in quality.classify(plain(spark, list(enumerate(good + bad)))).collect()}
    assert all(got[i] for i in range(120)) and not any(got[i] for i in range(120, 144))


def test_quality_rejects_symbols_beyond_ascii(spark):
    rng = random.Random(6)
    good = [" ".join(sentence(rng) for _ in range(6)) for _ in range(120)]
    bad = [" ".join(w + mark for w in sentence(rng, 40).split()) for mark in ("★★★", "→→", "■□■", "😀😀", "©®", "%%%", "$$$") for _ in range(4)]
    other = ["".join(c + "\u0301" if c in "aeiou" else c for c in g) for g in good[:10]] + [g.translate(str.maketrans("abgdezhiklmnoprstufx", "абгдезхиклмнопрстуфч")) for g in good[:10]]
    scored = quality.classify(plain(spark, list(enumerate(good + bad + other)))).collect()
    got = {r.doc_id: r.keep for r in scored}
    assert not any(got[i] for i in range(120, 148)) and all(got[i] for i in [*range(120), *range(148, 168)])
    [r] = quality.shaped(plain(spark, [(1, "Été été e\u0301 Ж ж 中文 ªº ★a →→ 😀x 12\u00a0!")])).collect()
    assert r.shapes == ["Aa", "a", "a", "A", "a", "a", "a", "★a", "→", "😀a", "0", "!"]


def test_quality_rejects_loops_and_abuse_at_any_length(spark):
    rng = random.Random(7)
    good = [" ".join(sentence(rng) for _ in range(6)) for _ in range(100)] + [" ".join(sentence(rng) for _ in range(k)) for k in (200, 900)]
    good += [g + " The trash is out, and the trash is in." for g in good[:3]]
    bad = [" ".join(sentence(rng, 6).split() * k) for k in (10, 60, 1_000)]
    bad += [" ".join(w + (" Idiot," if i % 40 == 5 else " you moron!" if i % 40 == 25 else "") for i, w in enumerate(g.split())) for g in (good[0], good[101])]
    got = {r.doc_id: r.keep for r in quality.classify(plain(spark, list(enumerate(good + bad)))).collect()}
    assert [i for i in range(105) if not got[i]] == [] and [i for i in range(105, 110) if got[i]] == []
    poor = spark.createDataFrame([(k, " ".join(rng.choice("abcdefghij") for _ in range(k))) for k in (500, 5_000)], "doc_id long, text string")
    assert {r.votes[quality.NAMES.index("variety")] for r in quality.with_votes(quality.shaped(poor)).collect()} == {"2"}


def test_quality_of_odd_rows(spark):
    got = quality.classify(frame(spark)).collect()
    assert len(got) == len(rows()) and all(r.keep is not None for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(r.text, set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert quality.classify(plain(spark, [])).count() == 0
    assert quality.good(frame(spark)).columns == frame(spark).columns
    assert quality.good(plain(spark, [(1, None), (2, "")])).count() == 2


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.2
    votes = np.stack([np.where(rng.random(len(truth)) < np.where(truth, hit, miss), 2, 1) for hit, miss in ((0.9, 0.05), (0.7, 0.1), (0.8, 0.02))], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, table, share = quality.expectation_maximisation(patterns, counts.astype(float), 200)
    assert abs(share - 0.2) < 0.03 and abs(table[0, 1, 2] - 0.9) < 0.05 and abs(table[1, 0, 2] - 0.1) < 0.03


def test_base_score_equals_the_formula(spark):
    data = [r[:2] for r in rows()]
    got = [tuple(r) for r in brown.score_texts(frame(spark)).drop("score", "perplexity").collect()]
    token = lambda t: re.findall("[^\x20\x09-\x0d]+", (t or "").translate(AZ)) + [" "]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, t in data if not held(i) for w in token(t))
    n, v = sum(c.values()), len(c)
    want = [(i, held(i), len(token(t)), sum(c[w] > 0 for w in token(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in token(t)), 6)) for i, t in data]
    same([(*r[:5], round(r[5], 6)) for r in got], want)
    assert brown.score_texts(plain(spark, [])).count() == 0


def test_exchange_gain_is_the_change_of_the_objective():
    rng = np.random.default_rng(1)
    size, count = 12, 4
    pairs, classes = rng.integers(0, 6, (size, size)).astype(float), rng.integers(0, count, size)

    def table(c):
        t = np.zeros((count, count))
        np.add.at(t, (c[:, None].repeat(size, 1), c[None].repeat(size, 0)), pairs)
        return t

    for u in range(size):
        left, right = np.zeros(count), np.zeros(count)
        for x in range(size):
            if x != u:
                left[classes[x]] += pairs[x, u]
                right[classes[x]] += pairs[u, x]
        _, gain = brown.best_class(table(classes), classes[u], left, right, pairs[u, u])
        tried = [brown.objective(table(np.where(np.arange(size) == u, k, classes))) for k in range(count)]
        assert abs(max(tried) - tried[classes[u]] - gain) < 1e-6


def test_many_words_move_as_one_does():
    rng = np.random.default_rng(3)
    count, k = 5, 40
    left, right = (rng.integers(0, 4, (k, count)) * (rng.random((k, count)) < 0.5).astype(float) for _ in range(2))
    own, now = rng.integers(0, 3, k).astype(float), rng.integers(0, count, k)
    table = rng.integers(0, 9, (count, count)).astype(float)
    for u in range(k):  # the table holds every unit in its class
        table[:, now[u]] += left[u]
        table[now[u]] += right[u]
        table[now[u], now[u]] += own[u]
    best, gain = brown.best_classes(table, now, left, right, own)
    for u in range(k):
        _, one = brown.best_class(table, int(now[u]), left[u], right[u], own[u])
        assert abs(one - gain[u]) < 1e-6


def test_rare_words_are_exchanged_each_by_itself(spark):
    # Words of one ending, each under the share of the rounds, in the places of two kinds of common words.
    rng = random.Random(5)
    rare, data = [[f"{c}{i}xyz" for i in range(1_500)] for c in "pq"], []
    for i in range(1_000):
        own = ["aa", "ab", "ac"] if i % 2 else ["ba", "bb", "bc"]
        data.append((i, " ".join(rng.choice(rare[i % 2]) if rng.random() < 0.4 else rng.choice(own) for _ in range(40))))
    got = brown.score_texts(plain(spark, data), classes=6).collect()
    assert len(got) == len(data)
    for held in (False, True):
        some = [r for r in got if r.held_out == held]
        assert sum(r.score - r.base_score for r in some) > 10.5 * len(some)


def test_classes_help_on_texts_that_did_not_train(spark):
    rng = random.Random(2)
    sets = [[a + b for a in "bcdfg" for b in "aeiou"], [a + b for a in "xyzwv" for b in "aeiou"]]
    data = [(i, " ".join(rng.choice(sets[i % 2]) for _ in range(60))) for i in range(300)]
    got = [r for r in brown.score_texts(plain(spark, data), classes=6).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 5 * len(got)


def spans_by_hand(data):
    rows_, first, gone = [], {}, {}
    for k, (d, t) in sorted(enumerate(data), key=lambda r: (r[1][0] is not None, r[1][0] or 0)):
        parts = []
        for s in re.split(r"(?<=[.!?\n])(?![.!?])", t or ""):
            parts += re.split(r"(?<=[,;:])", s) if len(s.encode().split()) > 12 else [s]
        at = [i for i, p in enumerate(parts) if p.encode().split()]
        for a in range(len(at)):
            for b in range(a + 2, len(at) + 1):
                run = tuple(" ".join(w.decode() for w in parts[i].lower().encode().split()) for i in at[a:b])
                if sum(len(x.split(" ")) for x in run) >= 20:
                    if first.setdefault(run, (k, a)) != (k, a):
                        gone.setdefault(k, set()).update(range(at[a], at[b - 1] + 1))
                    break
        rows_.append((d, t if t is None else "".join(p for i, p in enumerate(parts) if i not in gone.get(k, ())), len(at), len(gone.get(k, set()) & set(at))))
    return rows_


def test_sentence_spans_equal_brute_force(spark):
    rng = random.Random(11)
    data = [r[:2] for r in rows() if r[0] != 7]
    two = ", ".join(sentence(rng, 9)[:-1] for _ in range(4)) + ". " + "; ".join(sentence(rng, 9)[:-1] for _ in range(5)) + "."  # two sentences of 81 words
    data += [(800 + k, f"{sentence(rng)} {two} {sentence(rng)}") for k in range(6)]
    data += [(900, two[30:]), (901, "Yes. No. " * 3), (902, "yes. No. " * 30), (903, "yes. no.\n" * 30), (904, "no marks at all " * 40), (905, "no marks at all " * 40), (906, two), (906, two), (906, two)]
    docs = spark.createDataFrame([(*d, 7, "x") for d in data], "doc_id long, text string, n_removed int, pos string")
    got = sentence_spans.remove_repeats(docs)
    found = [(r.doc_id, r.text, r.n_sentences, r.n_removed) for r in got.collect()]
    same(found, spans_by_hand(data))
    assert [n for d, _, _, n in found if d is not None and 800 < d < 806] == [9] * 5  # the passage goes from all but the first
    assert got.columns == ["doc_id", "text", "pos", "n_sentences", "n_removed"]
    assert sentence_spans.remove_repeats(plain(spark, [])).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(int(c) for c in reversed(s))) % 10 == 0


def base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            v, digits = m.group(), re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits or "1"), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


ODD = [
    "a@b.c@d.e.f x.y_z@q.r_w@t.u", "😀 é me@x.org😀you@y.org", "1.2.3.4.5.6.7.8 256.1.1.1 007.000.1.1", "4111-1111-1111-1111 4111 1111 1111 1112 41111111111111111111",
    "+1 234 5678 +12 +1() 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +49.30-123456", "a" * 3000 + "@" + "b." * 500 + "c", "1" * 5000, "+" * 500 + "1 2", "....@....", "@a.b", "1.1.1.1@a.b-c.d-",
]


def test_base_spans_equal_the_plain_patterns(spark):
    data = [r[:2] for r in rows()] + [(1000 + k, t) for k, t in enumerate(ODD)]
    got = pii.personal_data(plain(spark, data))
    same([tuple(r) for r in got.select("doc_id", pii.listed(pii.KINDS)).collect()], [(i, base(t)) for i, t in data])
    assert pii.personal_data(plain(spark, [])).count() == 0


def test_terms_that_disclose_are_found_and_replaced(spark):
    rng = random.Random(4)
    data = [(i, sentence(rng) + " " + sentence(rng)) for i in range(200)]
    for i in (3, 50, 90):
        data[i] = (i, f"{sentence(rng)} Zorblax number {i} writes to bob@corp.example about {rng.choice(['tau', 'rho'])} things {i}.")
    docs = plain(spark, data)
    spans = {r.doc_id: [docs_text[s.start : s.stop] for s in r.term] for r in pii.personal_data(docs).collect() for docs_text in [data[r.doc_id][1]]}
    assert "Zorblax" in spans[3] and "Zorblax" in spans[90] and not spans[0]
    text = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "[EMAIL]" in text[3] and "[TERM]" in text[3] and "Zorblax" not in text[3] and text[0] == data[0][1]
    bare = {r.doc_id: r.text for r in pii.sanitise(docs, generalise=False).collect()}
    assert "[" not in bare[3] and "bob@" not in bare[3]


def test_sanitise_keeps_rows_and_columns(spark):
    got = pii.sanitise(frame(spark))
    assert got.columns == frame(spark).columns and got.count() == len(rows())
    assert got.filter("text is null").count() == sum(r[1] is None for r in rows())
    assert hashlib.sha256(b"").hexdigest() == pii.personal_data(plain(spark, [(1, None)])).select(F.sha2(pii.listed(pii.KINDS), 256)).first()[0]


def test_terms_disclose_wherever_they_stand(spark):
    """A name far before the address, in every text that has both, goes at all its places; two letters are enough."""
    rng = random.Random(14)
    data = [(i, " ".join(sentence(rng) for _ in range(4)) + " zorblaxes" * (i % 5 == 3)) for i in range(300)]
    for i in (10, 70, 200):
        data[i] = (i, f"Wu Zorblax came. {' '.join(sentence(rng) for _ in range(4))} Write to bob{i % 2}@corp.example now. {sentence(rng)} ZORBLAX and wu left, zorblaxes stay.")
    copy = data[40][1] + f" Quimby said so. Mail ann@corp.example today. {data[41][1]}"
    data[40], data[41] = (40, copy), (41, copy + " Again.")  # one surrounding only: copies are no evidence
    got = {r.doc_id: r for r in pii.personal_data(plain(spark, data)).collect()}
    said = lambda i: [data[i][1][s.start : s.stop] for s in got[i].term]
    for i in (10, 70, 200):
        assert [w for w in said(i) if w.lower() in ("wu", "zorblax")] == ["Wu", "Zorblax", "ZORBLAX", "wu"] and "zorblaxes" not in said(i)
    assert "Quimby" not in said(40) and all(not got[i].term for i in range(300) if i not in (10, 40, 41, 70, 200))
    text = {r.doc_id: r.text for r in pii.sanitise(plain(spark, data)).collect()}
    assert "zorblax " not in text[10].lower() and "[EMAIL]" in text[10] and text[0] == data[0][1]


def test_disclosure_by_hand(spark):
    """PMI of terms and entities over a small corpus, counted in plain Python."""
    rng = random.Random(15)
    names = ["ana", "bo", "cyd", "dov", "el"]
    data = []
    for i in range(400):
        t = " ".join(rng.choice(WORDS) for _ in range(12))
        for k, n in enumerate(names):
            if rng.random() < 0.03:
                t = f"{t} {n if rng.random() < 0.9 else ''} {rng.choice(WORDS)} user{k}@x.org {rng.choice(WORDS)} {rng.choice(WORDS)} {i}"
            elif rng.random() < 0.004:
                t += " " + n
        data.append((i, t))
    docs = plain(spark, data)
    got = {(r.value, r.term): r.disclosure for r in pii.disclosing(docs, pii.found(docs)).collect()}
    words = {i: {w for w in re.split(r"[^a-z]+", t.lower()) if len(w) >= 2} for i, t in data}
    want = {}
    for k in range(len(names)):
        value = f"user{k}@x.org"
        texts = [i for i, t in data if value in t]
        for term in set().union(*(words[i] for i in texts)):
            both, spread = sum(term in words[i] for i in texts), sum(term in w for w in words.values())
            around = {t[max(0, t.index(value) - 60) : t.index(value) + len(value) + 60] for i, t in data if i in texts and term in words[i]}
            d = math.log2(len(data) * both / (spread * len(texts))) / math.log2(len(data) / len(texts))
            if len(around) >= 2 and d >= 0.9:
                want[value, term] = d
    assert got.keys() == want.keys() and want and all(abs(got[k] - want[k]) < 1e-9 for k in want)
