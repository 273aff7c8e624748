import random
import re
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from brute import dedupe as sequential

from storyloom.functions import text
from storyloom.operators import dedupe, simjoin, skew

T0 = datetime(2024, 1, 10)
COLS = "article_id STRING, source_id STRING, canonical_url STRING, title STRING, published_at TIMESTAMP, created_at TIMESTAMP, content_hash STRING, dedupe_status STRING"


def frame(spark, rows):
    return spark.createDataFrame([[r[c.split()[0]] for c in COLS.split(", ")] for r in rows], COLS)


def row(i, source="a", url=None, title="", at=T0, h=None):
    return {
        "article_id": f"art_{i:04d}", "source_id": source, "canonical_url": url, "title": title, "published_at": at,
        "created_at": datetime(2024, 2, 1), "content_hash": h, "dedupe_status": "candidate",
    }


def random_rows(seed, n=90):
    rnd = random.Random(seed)
    vocab = ["alpha", "beta", "gamma", "delta", "omega", "model", "launch", "update"]
    rows = []
    for i in range(n):
        k = rnd.randint(1, 6)
        title = " ".join(rnd.choice(vocab) for _ in range(k)) if rnd.random() < 0.6 else rnd.choice(
            ["alpha beta gamma delta omega", "alpha alpha alpha beta", "alpha", "the of", "model launch update today"]
        )
        at = None if rnd.random() < 0.12 else T0 + timedelta(hours=rnd.choice([0, 1, 24, 48, 71, 72, 73, 100, 144, 200]) + rnd.randint(0, 1) * rnd.randint(0, 200))
        url = rnd.choice([None, None, None, "https://x.com/", "https://X.com/a/1?q=2", "https://x.com/a/1", f"https://y.com/{i}"])
        rows.append(row(i, rnd.choice("abc"), url, title, at, rnd.choice([None, None, "h1", f"u{i}"])))
    return rows


@pytest.mark.parametrize(("seed", "parallel"), [(1, 2), (2, 0), (3, 1), (3, 50)])
def test_same_as_the_sequential_pass(spark, monkeypatch, seed, parallel):
    monkeypatch.setattr(dedupe, "PARALLEL", parallel)
    rows = random_rows(seed)
    dup, cand = sequential(rows)
    got = dedupe.assign_duplicates(frame(spark, rows)).collect()
    assert {r.article_id: r.duplicate_of for r in got if r.duplicate_of} == dup
    assert {r.article_id: r.candidate_of for r in got if r.candidate_of} == cand


def test_salted_groups_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(skew, "MIN_HOT_ROWS", 1)
    rows = random_rows(7, 40)
    dup, cand = sequential(rows)
    got = dedupe.assign_duplicates(frame(spark, rows)).collect()
    assert {r.article_id: r.duplicate_of for r in got if r.duplicate_of} == dup
    assert {r.article_id: r.candidate_of for r in got if r.candidate_of} == cand


def test_a_chain_of_dependent_articles(spark):
    """Each article is like the one before it only, so every decision waits for the one before."""
    vocab = [f"w{i}" for i in range(1_040)]
    rows = [row(i, "ab"[i % 2], None, " ".join(vocab[i : i + 12]), T0 + timedelta(minutes=30 * i)) for i in range(1_000)]
    got = {r.article_id: r.duplicate_of for r in dedupe.assign_duplicates(frame(spark, rows)).collect()}
    # 11 of 12 words are shared with the next article (0.917) and 10 with the one after it (0.833, of the same source).
    dup = {}
    for i, r in enumerate(rows):
        if i and rows[i - 1]["article_id"] not in dup:
            dup[r["article_id"]] = rows[i - 1]["article_id"]
    assert {k: v for k, v in got.items() if v} == dup and len(dup) == 500


def _similar(rows, threshold):
    """All ordered pairs of different titles at or above the threshold, counted in plain Python."""
    titles = {tuple(r["title"].split()) for r in rows if r["title"].split()}
    found = {}
    for a in titles:
        for b in titles:
            sim = 2.0 * sum(w in b for w in a) / (len(a) + len(b))
            if a != b and sim >= threshold:
                found[" ".join(a), " ".join(b)] = sim
    return found


@pytest.mark.parametrize(("first", "second", "cells"), [(25_000, 50_000, 1 << 20), (7, 5, 30)])
def test_titles_meet_in_tiles(spark, monkeypatch, first, second, cells):
    monkeypatch.setattr(simjoin, "FIRST_TITLES", first)
    monkeypatch.setattr(simjoin, "SECOND_TITLES", second)
    monkeypatch.setattr(simjoin, "CELLS", cells)
    monkeypatch.setattr(simjoin, "MEETINGS", cells)
    rows = [r for r in random_rows(5, 120) if r["title"] != "the of"] + [row(900 + i, title=t) for i, t in enumerate(["x x x x", "x", "x y", "模型 x", "模型"])]
    for threshold in (0.5, 0.82):
        got = simjoin.title_similarity_join(frame(spark, rows), threshold).collect()
        assert len(got) == len({(r.first_key, r.second_key) for r in got})
        assert {(r.first_key, r.second_key): r.similarity for r in got} == _similar(rows, threshold)


def test_a_meeting_of_titles_is_no_row(spark):
    """2,000 titles share one word: what the join reads stays with the titles, not with their two million meetings."""
    rows = [row(i, title=f"common a{i} b{i} c{i}") for i in range(2000)] + [row(5000, title="common a7 b7")]
    found = simjoin.title_similarity_join(frame(spark, rows), 0.5)
    assert {(r.first_key, r.second_key) for r in found.collect()} == {("common a7 b7", "common a7 b7 c7"), ("common a7 b7 c7", "common a7 b7")}
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "split(" not in plan  # no row a word either


@pytest.mark.parametrize(("first", "second", "cells"), [(25_000, 50_000, 1 << 20), (7, 5, 30)])
def test_the_earliest_similar_lead_is_a_row_an_ask(spark, monkeypatch, first, second, cells):
    monkeypatch.setattr(simjoin, "FIRST_TITLES", first)
    monkeypatch.setattr(simjoin, "SECOND_TITLES", second)
    monkeypatch.setattr(simjoin, "CELLS", cells)
    monkeypatch.setattr(simjoin, "MEETINGS", cells)
    rnd = random.Random(9)
    titles = [" ".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 5))) for _ in range(60)]
    leads = sorted({(t, rnd.randint(0, 30)) for t in titles for _ in range(3)})
    leads = [("b", t, at, f"{at:03d}|{i:04d}", 1.0) for i, (t, at) in enumerate(leads)]
    asks = sorted({("b", rnd.choice(titles), rnd.randint(0, 35)) for _ in range(80)})
    expected = {}
    for _, title, since in asks:
        words = title.split()
        near = [
            slot for _, t, at, slot, _ in leads
            if t != title and at >= since and 2.0 * sum(w in words for w in t.split()) / (len(t.split()) + len(words)) >= 0.4995
        ]
        if near:
            expected[title, since] = min(near)
    found = simjoin.earliest_similar(
        spark.createDataFrame(leads, "block STRING, title_key STRING, at BIGINT, slot STRING, factor DOUBLE"),
        spark.createDataFrame(asks, "block STRING, title_key STRING, since BIGINT"), 0.5,
    ).collect()
    assert len(found) == len(expected)
    assert {(r.title_key, r.since): r.lead_slot for r in found} == expected


def test_pairs_hold_no_merely_possible_ones(spark):
    rows = [row(1, title="model launch update today"), row(2, "b", title="model launch other words"), row(3, "c", title="model launch update now")]
    pairs = {(r.first_key, r.second_key): r.similarity for r in dedupe.title_pairs(frame(spark, rows)).collect()}
    assert set(pairs.values()) == {0.75} and len(pairs) == 2
    assert {r.article_id: r.candidate_of for r in dedupe.assign_duplicates(frame(spark, rows)).collect() if r.candidate_of} == {"art_0002": "art_0001", "art_0003": "art_0001"}


def test_titles_meet_in_their_rarest_words_only(monkeypatch):
    """500 titles share a word and some of them more: few are looked up, and all that are similar are found once."""
    rnd = random.Random(3)
    titles = sorted({f"common a{i % 200} b{i % 300} c{i}" for i in range(500)} | {" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 12))) for _ in range(60)})
    met, run = [], simjoin._run
    monkeypatch.setattr(simjoin, "_run", lambda start, times: met.append(int(times.sum())) or run(start, times))
    words = [t.split() for t in titles]
    index = simjoin._Index(pa.array(titles))
    for limit in (0.5, 0.82, 1.26):
        met.clear()
        found = [x for parts in index.matches(pa.array(titles), np.full(len(titles), limit)) for x in zip(*(p.tolist() for p in parts), strict=True)]
        sets = [set(w) for w in words]
        similar = {(i, j): 2.0 * sum(w in held for w in one) / (len(one) + len(words[j])) for i, one in enumerate(words) for j, held in enumerate(sets)}
        assert len(found) == len({x[:2] for x in found})
        assert {(i, j): v for i, j, v in found} == {k: v for k, v in similar.items() if v >= limit}
        assert sum(met) < 500 * 500 / 2  # in the common word alone all would meet


def test_title_words_without_stop_words(spark):
    titles = [None, "", "The of AND", "a an a The cat", "Cat  and-the a DOG", "anode the theory of a", "模型 a 发布", "x the", "the x", "of1 a1 in into new"]
    stop = set(text.STOP_WORDS)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i INT, t STRING").select("t", text.title_tokens("t").alias("w"), text.title_key("t").alias("k")).collect()
    for r in rows:
        expected = [w for w in re.sub("[^a-z0-9\u4e00-\u9fff]+", " ", (r.t or "").lower()).split() if w not in stop]
        assert r.w == expected and r.k == " ".join(expected)
    plan = spark.createDataFrame([("x",)], "title STRING").select(text.title_key("title"))._jdf.queryExecution().toString()
    assert "lambdafunction" not in plan  # word lists aren't filtered word by word
