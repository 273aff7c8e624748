"""A whole run against a recomputation in plain Python, its constants written out."""

from datetime import timedelta

import brute
from pyspark.sql import functions as F

from catalog.flows import CLOCK, _inputs
from catalog.registry import Tables
from storyloom.plans import batch

WINDOWS = {"technology_media": 168, "company_announcement": 336, "research": 720, "funding": 720, "policy": 720, "community": 72, "product_launch": 336}
HEAT = dict(freshness=25, source_count=15, source_diversity=12, duplicate_support=14, community_activity=10, source_trust=12, topic_velocity=5, topic_confidence=7)
SIGNAL = dict(source_trust=30, evidence_strength=20, content_quality=20, topic_confidence=15, duplicate_confidence=15)


def round2(x):
    return int(x * 100 + 0.5) / 100


def graded(article, source):
    text = lambda c: (article[c] or "").strip()
    low = (
        len(text("title")) < 6 or not article["canonical_url"] or article["published_at"] is None
        or (len(text("excerpt")) < 20 and len(text("text_for_ai")) < 80) or article["language"] not in ("en", "zh", "zh-CN", "", None)
    )
    window = source["freshness_window_hours"] if (source["freshness_window_hours"] or 0) > 0 else WINDOWS.get(source["family"], 168)
    stale = article["published_at"] is not None and (CLOCK - article["published_at"]) / timedelta(hours=1) > window
    return not low and not stale


def parts(members, sources, relations, topics, near):
    """Unclamped component values of one signal."""
    dims = [sources[m["source_id"]] for m in members]
    dates = [m["published_at"] for m in members if m["published_at"] is not None]
    age = (CLOCK - max(dates)) / timedelta(hours=1) if dates else None
    steps = [(6, 1.0), (24, 0.9), (72, 0.65), (168, 0.4), (336, 0.18)]
    size = lambda m, c: len(m[c] or "")
    worth = lambda m: (
        0.25 * (size(m, "title") >= 18) + 0.2 * (size(m, "excerpt") >= 20) + (0.4 if size(m, "text_for_ai") >= 80 else 0.2 if size(m, "text_for_ai") else 0)
        + 0.15 * (size(m, "canonical_url") > 0)
    )
    ids = {m["article_id"] for m in members}
    about = [r for r in relations if r["article_id"] in ids]
    dups = [r for r in about if r["relation_type"] == "duplicate_confirmed" and r["duplicate_support"]]
    support = [r["cluster_score"] or 0.5 for r in about if r["relation_type"] == "signal_support"]
    n = len({m["source_id"] for m in members})
    mean = lambda xs, empty: sum(xs) / len(xs) if xs else empty
    strength = min(1.0, mean(support, 0.45) * 0.55 + min(n / 4, 1) * 0.35 + 0.2 * bool(dups))
    return {
        "freshness": 0.15 if age is None else next((v for limit, v in steps if age <= limit), 0.05),
        "source_count": min(n / 4, 1), "source_diversity": min(len({d["family"] for d in dims}) / 4, 1),
        "duplicate_support": min(len(dups) / 3, 1), "duplicate_confidence": mean([r["confidence"] or r["credibility_boost"] or 0.7 for r in dups], 0.0),
        "community_activity": min(sum((m["community_score"] or 0) + 2 * (m["community_comments"] or 0) + (m["community_votes"] or 0) for m in members) / 250, 1),
        "source_trust": mean([d["trust_score"] or 0.35 for d in dims], 0.35),
        "topic_velocity": min(near / 3, 1), "topic_confidence": mean([t["confidence"] or 0.25 for t in topics], 0.25),
        "evidence_strength": 0.0 if not n else min(strength, 0.58) if n <= 1 and not dups else strength,
        "content_quality": mean([worth(m) for m in members], 0.0),
    }


def test_a_run_equals_its_recomputation(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    out = batch.run_batch(spark, str(tmp_path), _inputs(t), batch.RunOptions.normalize(), CLOCK, "r1")
    rows = lambda name: [r.asDict() for r in out[name].collect()]
    articles, signals, links, relations, topics = (rows(n) for n in ("articles", "signals", "signal_articles", "relations", "signal_topics"))
    sources = {r.source_id: r.asDict() for r in t.sources.collect()}
    by_id = {a["article_id"]: a for a in articles}
    assert len(articles) > 100

    dup, maybe = brute.dedupe(articles)
    found = lambda kind: {r["article_id"]: r["target_article_id"] for r in relations if r["relation_type"] == kind}
    assert found("duplicate_confirmed") == dup and found("duplicate_candidate") == maybe

    good = [a for a in articles if graded(a, sources[a["source_id"]])]
    assert {a["article_id"] for a in articles if a["visibility_status"] != "hidden_latest" and a["quality_status"] != "low_quality"} == {a["article_id"] for a in good}
    label = brute.cluster(good, dup)
    stories, kept = {}, {}
    for a, first in label.items():
        stories.setdefault(first, set()).add(a)
    for link in links:
        kept.setdefault(link["signal_id"], set()).add(link["article_id"])
    assert sorted(map(sorted, stories.values())) == sorted(map(sorted, kept.values()))
    assert {s["signal_id"] for s in signals} == set(kept)

    mine = {s["signal_id"]: {x["topic_slug"] for x in topics if x["signal_id"] == s["signal_id"]} for s in signals}
    for s in signals:
        at, ident = s["primary_published_at"], s["signal_id"]
        near = sum(
            o["signal_id"] != ident and bool(mine[ident] & mine[o["signal_id"]]) and o["primary_published_at"] is not None
            and abs(o["primary_published_at"] - at) <= timedelta(hours=72)
            for o in signals
        ) if at is not None else 0
        value = parts([by_id[a] for a in kept[ident]], sources, relations, [x for x in topics if x["signal_id"] == ident], near)
        total = lambda weights: round2(brute.round3(sum(brute.round3(min(1, max(0, value[k])) * w) for k, w in weights.items())))  # noqa: B023, E731
        assert (abs(s["heat_score"] - total(HEAT)) < 0.011 and abs(s["signal_score"] - total(SIGNAL)) < 0.011), (s["signal_id"], value)
    assert {s["enrichment_status"] for s in signals} == {"fallback"}
    assert all(s["enrichment_source_count"] == len(kept[s["signal_id"]]) and s["enrichment_generated_at"] == CLOCK for s in signals)
    assert out["run_outcomes"].agg(F.sum("created")).first()[0] == len(articles)
