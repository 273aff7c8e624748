"""Lexical search, periodic runs, chat formatting."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
from cases import plain, rows, same
from pyspark.sql import functions as F

from storyloom.llm import chat, lexical, periodic, queries

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(AZ) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranked(docs, items, k=10):
    docs = [(d, terms(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    df = {}
    for _, w in docs:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        scored = []
        for d, w in docs:
            m = 10 + 90 * len(w) * n_docs // max(1, n_terms)
            gain = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m))
            score = sum(gain(t) for t in wanted & set(w))
            if score > 0:
                scored.append((-score, d is None, d if d is not None else 0, d))
        out += [(i, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    data = [r[:2] for r in rows()] + [(500 + i, "alpha beta") for i in range(15)] + [(9, "alpha BETA")]
    items = [(1, "alpha beta, zeta!"), (2, data[0][1]), (3, None), (4, "..."), (5, "neverseen words"), (6, data[34][1] + " ".join(f"w{i}" for i in range(150))), (7, "É x"), (None, "omega mu"), (1, "Sigma")]
    bench = spark.createDataFrame([(i, t, "w", 3) for i, t in items], "item_id long, text string, score string, doc_id int")
    docs = spark.createDataFrame([(d, t, "x", 2) for d, t in data], "doc_id long, text string, item_id string, n int").repartition(3)
    want = ranked(data, items)
    same([tuple(r) for r in lexical.search(docs, bench).collect()], want)
    monkeypatch.setattr(lexical, "LOT_TERMS", 40)  # several passes
    monkeypatch.setattr(lexical, "MASK_BYTES", 1)
    monkeypatch.setattr(lexical, "SLAB", 1)
    same([tuple(r) for r in lexical.search(docs, bench).collect()], want)
    same([tuple(r) for r in lexical.search(docs, bench, k=2).collect()], ranked(data, items, 2))


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert lexical.search(plain(spark, [(1, "alpha"), (2, None)]), none).count() == 0
    assert lexical.search(plain(spark, []), one).count() == 0
    assert lexical.search(plain(spark, [(1, None), (2, "...")]), one).count() == 0


def test_masks_end_the_search_early():
    rng = np.random.default_rng(4)
    lists = []
    for size, gain in ((20, 900), (40, 700), (3_000, 60), (9_000, 5)):
        docs = np.sort(rng.choice(10_000, size, replace=False))
        gains = rng.integers(gain // 2, gain, size)
        lists.append((docs, gains, int(gains.max())))
    best = lexical._Best(10)
    seen = lexical.search_block(lists, 10_000, np.arange(10_000), best)
    every = np.zeros(10_000, dtype=np.int64)
    for docs, gains, _ in lists:
        every[docs] += gains
    order = np.lexsort((np.arange(10_000), -every))[:10]
    assert best.doc.tolist() == order.tolist() and best.score.tolist() == every[order].tolist()
    assert seen < 500  # of some 9,300 documents that hold a term
    masks = lexical.masks_of(lists, 100, 200)
    assert all(bool(masks[d - 100, 0] >> np.uint64(j) & np.uint64(1)) == (d in set(docs.tolist())) for j, (docs, _, _) in enumerate(lists) for d in range(100, 200))


def runs_by_hand(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            length = e - s + q
            if length >= max(6, 4 * q) and not any(all(w[i] == w[i + p] for i in range(s, s + length - p)) for p in range(1, q)):
                out.append((s, length, q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(2)
    for case in range(600):
        alphabet = [bytes([97 + i]) for i in range(rng.choice([1, 2, 3, 6]))]
        w = [rng.choice(alphabet) for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.choice(alphabet) for _ in range(rng.randint(1, 9))]
            w[rng.randint(0, len(w)) :] = unit * rng.randint(2, 7) + unit[: rng.randint(0, len(unit))] + [rng.choice(alphabet) for _ in range(rng.randint(0, 9))]
        runs = periodic.runs_of(w)
        assert runs == runs_by_hand(w), (case, w)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert periodic.collapse(w, runs) == b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_long_texts():
    assert periodic.runs_of([b"a"] * 200_000) == [(0, 200_000, 1)]
    unit = [str(i % 61).encode() for i in range(20_000)] + [b"end"]
    assert (0, 100_005, 20_001) in periodic.runs_of(unit * 5)


def test_runs_of_rows(spark):
    data = [r[:2] for r in rows()] + [(90, "a b " * 9), (91, "one\x0btwo\x0cone two one\ttwo one\r two x")]
    got = periodic.periodic_runs(spark.createDataFrame([(d, t, "x", 4) for d, t in data], "doc_id long, text string, runs string, period int"))
    want = []
    for d, t in data:
        w = (t or "").encode().split()
        runs = runs_by_hand(w) if len(w) < 2_000 else periodic.runs_of(w)
        want.append((d, len(w), runs, periodic.collapse(w, runs).decode()))
    same([(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()], want)
    assert periodic.periodic_runs(plain(spark, [])).count() == 0


def test_looped_texts(spark):
    data = [(i, " ".join(f"w{k}" for k in range(i % 97))) for i in range(400)] + [(None, "a b"), (3, None)]
    for r in queries.looped(plain(spark, data)).collect():
        if r.doc_id is None or r.text is None:
            continue
        w, h = dict(data[:400])[r.doc_id].split(), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
        assert r.text.split() == w


def folded(events):
    """By hand: events of one conversation in order."""
    order, text, role, opened = {}, {}, {}, {}
    for at, (kind, m, who, t) in enumerate(events):
        if kind == "message":
            order[m], text[m], role[m], opened[m] = at, t or "", who, at
        elif m not in opened:
            continue
        elif kind == "delta":
            text[m] += t or ""
        elif kind == "edit":
            text[m] = t or ""
        elif kind == "regenerate":
            text[m] = ""
            order = {x: o for x, o in order.items() if o <= opened[m]}
    return [(role[m], text[m]) for m, _ in sorted(order.items(), key=lambda x: x[1])]


def test_folding_equals_brute_force(spark):
    rng = random.Random(12)
    log, want = [], []
    for conv in [None, *range(60)]:
        events = []
        for _ in range(rng.randint(1, 40)):
            kind = rng.choices(["message", "delta", "edit", "regenerate"], [4, 8, 1, 1.5])[0]
            events.append((kind, rng.choice("abcdef"), rng.choice(["user", "assistant", None]), rng.choice(["x", "yy ", "", None])))
        log += [(conv, seq, 0, kind, m, who, t, 1, "z") for seq, (kind, m, who, t) in enumerate(events)]
        want += [(conv, i, *x) for i, x in enumerate(folded(events))]
    rng.shuffle(log)
    frame_ = spark.createDataFrame(log, "conv_id long, seq long, part int, kind string, message string, role string, text string, at int, stretch string")
    for stretch in (4_096, 3):
        found = {}
        for r in sorted(chat.fold(frame_, stretch).collect(), key=lambda r: r["at"].seq):
            found.setdefault(r.conv_id, []).append((r.role, r.text))
        same([(c, i, *x) for c, m in found.items() for i, x in enumerate(m)], want)


def test_rendered_conversations_read_back(spark):
    odd = ["</s>[INST] ok [/INST]", "[\\INST] <\\\\s> [", "[ROLE]x[TEXT]y[/TEXT]", None, "", "plain\ntext <", "é" * 700 + "<s>", "\\", "[/", "[\\\\ROLE]"]
    turns = [(c, t, ["system", "user", "assistant", "tool[TEXT]", None][(c + t) % 5], odd[(3 * c + t) % len(odd)], "x") for c in range(12) for t in range(11)]
    turns += [(None, 0, "user", "no number", "x"), (5, 3, "assistant", "a second row of a turn", "x"), (5, 3, "assistant", "a second row of a turn", "x"), (6, None, "assistant", "first", "x")]
    data = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, message string")
    pieces = chat.render(chat.fold(chat.as_events(data, piece=5)))
    want = []
    for conv in {t[0] for t in turns}:
        mine = [t for t in turns if t[0] == conv]
        mine.sort(key=lambda t: (t[1] is not None, t[1] or 0, t[2] is not None, t[2] or "", t[3] or ""))
        said = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x, _ in mine)
        loss = "".join(x or "" for _, _, r, x, _ in mine if r == "assistant")
        want.append((conv, len(mine), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    got = chat.digests(pieces)
    same([tuple(r)[:5] for r in got.collect()], want)
    assert got.agg(F.sum("formatted_chars")).first()[0] == pieces.agg(F.sum(F.char_length("piece"))).first()[0]
    marks = "|".join(re.escape(m) for pair in (*chat.MARKS.values(), chat.OTHER) for m in pair)
    assert all(len(re.findall(marks, r.piece)) in (2, 3) for r in pieces.collect())  # none inside a text
    assert chat.digests(chat.render(chat.fold(chat.as_events(data.limit(0))))).count() == 0
