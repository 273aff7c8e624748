"""Heat and signal scores from weighted components, one row per component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, clamp01, or_else, round2, round3
from ..functions.times import age_hours, millis, ts_lit
from .lineage import cut
from .summaries import count_tables

# Component weights, each list sums to 100.
HEAT_WEIGHTS = {
    "freshness": 25,
    "source_count": 15,
    "source_diversity": 12,
    "duplicate_support": 14,
    "community_activity": 10,
    "source_trust": 12,
    "topic_velocity": 5,
    "topic_confidence": 7,
}
SIGNAL_WEIGHTS = {
    "source_trust": 30,
    "evidence_strength": 20,
    "content_quality": 20,
    "topic_confidence": 15,
    "duplicate_confidence": 15,
}
# Age limit in hours and freshness value.
FRESHNESS_STEPS = [(6, 1.0), (24, 0.9), (72, 0.65), (168, 0.4), (336, 0.18)]
OLDEST, UNDATED = 0.05, 0.15
VELOCITY_HOURS = 72
MISSING_TRUST = 0.35
MISSING_TOPIC = 0.25


def eligible() -> Column:
    """Neither hidden from the latest view nor low quality."""
    return (F.coalesce("visibility_status", F.lit("")) != "hidden_latest") & (
        F.coalesce("quality_status", F.lit("")) != "low_quality"
    )


def score_members(links: DataFrame, articles: DataFrame) -> DataFrame:
    """(signal, eligible article) rows; texts reduced to the lengths scoring needs."""
    size = lambda name: F.coalesce(F.length(name), F.lit(0))
    slim = articles.filter(eligible()).select(
        "article_id",
        "source_id",
        "published_at",
        (
            F.when(size("title") >= 18, 0.25).otherwise(0.0)
            + F.when(size("excerpt") >= 20, 0.2).otherwise(0.0)
            + F.when(size("text_for_ai") >= 80, 0.4).when(size("text_for_ai") > 0, 0.2).otherwise(0.0)
            + F.when(size("canonical_url") > 0, 0.15).otherwise(0.0)
        ).alias("quality"),
        (
            F.coalesce(F.col("community_score"), F.lit(0))
            + F.coalesce(F.col("community_comments"), F.lit(0)) * 2
            + F.coalesce(F.col("community_votes"), F.lit(0))
        ).alias("activity"),
    )
    return links.select("signal_id", "article_id").join(slim, "article_id")


def scope_relations(relations: DataFrame, members: DataFrame) -> DataFrame:
    """(signal, relation) rows: the relation's article is a member, or it names the signal and no article."""
    keys = members.select("signal_id", "article_id")
    rel = relations.select(
        F.col("signal_id").alias("relation_signal"),
        "article_id",
        "relation_type",
        "target_article_id",
        "confidence",
        "cluster_score",
        "duplicate_support",
        "credibility_boost",
    )
    by_article = rel.filter("article_id IS NOT NULL").join(keys, "article_id")
    by_signal = rel.filter("article_id IS NULL AND relation_signal IS NOT NULL").withColumn(
        "signal_id", F.col("relation_signal")
    )
    return by_article.unionByName(by_signal)


def freshness_value(newest: Column, now: Column) -> Column:
    age = age_hours(newest, now)
    value = F.when(newest.isNull(), F.lit(UNDATED))
    for limit, step in FRESHNESS_STEPS:
        value = value.when(age <= limit, F.lit(step))
    return value.otherwise(F.lit(OLDEST))


def member_scores(members: DataFrame, sources: DataFrame, now) -> DataFrame:
    """Freshness, source count and spread, trust, activity, content quality per signal.

    Pre-aggregated per (signal, source) so that the distinct counts run on the
    small result and a hot signal spreads over its sources.
    """
    per_source = members.groupBy("signal_id", "source_id").agg(
        F.max("published_at").alias("newest"),
        F.count("*").alias("n"),
        F.sum("quality").alias("quality"),
        F.sum("activity").alias("activity"),
    )
    dims = sources.select("source_id", "family", "trust_score", F.lit(1).alias("known"))
    joined = per_source.join(dims, "source_id", "left")
    known = F.col("known").isNotNull()
    trust = or_else(F.col("trust_score"), MISSING_TRUST)
    spread = lambda c: F.least(c / F.lit(4.0), F.lit(1.0))
    return joined.groupBy("signal_id").agg(
        freshness_value(F.max("newest"), ts_lit(now)).alias("freshness"),
        spread(F.count_if(known)).alias("source_count"),
        spread(F.count_distinct(F.when(known, F.nullif(F.col("family"), F.lit(""))))).alias("source_diversity"),
        F.count("source_id").alias("n_sources"),
        F.coalesce(
            F.sum(F.when(known, trust * F.col("n"))) / F.sum(F.when(known, F.col("n"))), F.lit(MISSING_TRUST)
        ).alias("source_trust"),
        F.least(F.sum("activity") / F.lit(250.0), F.lit(1.0)).alias("community_activity"),
        (F.sum("quality") / F.sum("n")).alias("content_quality"),
    )


def relation_scores(scoped: DataFrame) -> DataFrame:
    """Duplicate support and confidence, mean support score per signal."""
    dup = (F.col("relation_type") == "duplicate_confirmed") & F.coalesce("duplicate_support", F.lit(False))
    support = F.col("relation_type") == "signal_support"
    confidence = or_else(F.col("confidence"), or_else(F.col("credibility_boost"), 0.7))
    return scoped.groupBy("signal_id").agg(
        F.count_if(dup).alias("n_dup"),
        F.least(F.count_if(dup) / F.lit(3.0), F.lit(1.0)).alias("duplicate_support"),
        F.coalesce(F.avg(F.when(dup, confidence)), F.lit(0.0)).alias("duplicate_confidence"),
        F.avg(F.when(support, or_else(F.col("cluster_score"), 0.5))).alias("mean_support"),
    )


def evidence_strength(n_sources: Column, n_dup: Column, mean_support: Column) -> Column:
    value = F.least(
        F.coalesce(mean_support, F.lit(0.45)) * 0.55
        + F.least(n_sources / F.lit(4.0), F.lit(1.0)) * 0.35
        + F.when(n_dup > 0, 0.2).otherwise(0.0),
        F.lit(1.0),
    )
    return F.when((n_sources <= 1) & (n_dup == 0), F.least(value, F.lit(0.58))).otherwise(value)


def topic_confidence(signal_topics: DataFrame) -> DataFrame:
    return signal_topics.groupBy("signal_id").agg(
        F.avg(or_else(F.col("confidence"), MISSING_TOPIC)).alias("topic_confidence")
    )


def _borders(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(mask, t, border) of the asks among one hour's sorted events and asks: signed number of events so far that share a topic.

    ``inside[c]`` is the number of events whose topics all lie in ``c``.
    """
    every = np.arange(size)
    now, inside = None, np.zeros(size, dtype=np.int64)
    for batch in batches:
        out = []
        columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hour", "edge", "mask", "n", "t"))
        for hour, edge, mask, n, t in zip(*columns, strict=True):
            if hour != now:
                now, inside = hour, np.zeros(size, dtype=np.int64)
            if edge == 0:
                inside[(every & mask) == mask] += n
            else:
                out.append((mask, t, edge * int(inside[size - 1] - inside[(size - 1) ^ mask])))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["mask", "t", "border"])


def topic_velocity(signals: DataFrame, signal_topics: DataFrame, topic_order: list[str] | None = None) -> DataFrame:
    """Share of three other signals within 72 h that have a topic in common.

    Signals are reduced to counts per (topic mask, instant).  Those that share a
    topic with a mask are all less those inside its complement, a subset sum: an
    hour gives one total per mask in use, and ``[t - 72 h, t + 72 h]`` is a range
    sum over hours, corrected by the running subset sums inside the two border
    hours.  No pair of signals or masks is formed, so a busy topic costs no more
    than a quiet one.
    """
    from .topics import TOPICS

    slugs = topic_order or [slug for slug, _, _ in TOPICS]
    bit = F.lit(0).cast("long")
    for i, slug in enumerate(slugs):
        bit = F.when(F.col("topic_slug") == slug, F.lit(1 << i).cast("long")).otherwise(bit)
    masks = signal_topics.groupBy("signal_id").agg(F.bit_or(bit).alias("mask")).filter("mask > 0")
    dated = (
        signals.filter("primary_published_at IS NOT NULL")
        .select("signal_id", millis("primary_published_at").alias("t"))
        .join(masks, "signal_id")
    )
    hour_ms = 3600 * 1000
    span = VELOCITY_HOURS
    points = cut(
        dated.groupBy("mask", "t").agg(F.count("*").alias("n")).withColumn("hour", F.floor(F.col("t") / hour_ms))
    )
    asked = sorted(r["mask"] for r in points.select("mask").distinct().collect())  # at most 2^topics numbers
    counts = points.groupBy("hour", "mask").agg(F.sum("n").alias("n"))
    held = counts.groupBy("hour").agg(F.collect_list(F.struct("mask", "n")).alias("held"))  # at most one entry a mask
    sharing = lambda m: F.aggregate(
        "held", F.lit(0).cast("long"), lambda total, x: total + F.when(x["mask"].bitwiseAND(m) > 0, x["n"]).otherwise(F.lit(0).cast("long"))
    )
    totals = held.select(
        "hour", F.inline(F.transform(F.array(*[F.lit(m).cast("long") for m in asked]) if asked else F.array().cast("array<bigint>"), lambda m: F.struct(m.alias("mask"), sharing(m).alias("n"))))
    )
    around = Window.partitionBy("mask").orderBy("hour").rangeBetween(-span, span - 1)
    full = points.select("mask", "t", "hour").join(totals.withColumn("inside", F.sum("n").over(around)).select("mask", "hour", "inside"), ["mask", "hour"])

    # Border hours: events before t - 72 h leave the sum, events up to t + 72 h join it.
    none = F.lit(None).cast("long")
    lines = points.select("hour", F.col("t").alias("at"), F.lit(0).alias("edge"), "mask", "n", none.alias("t"))
    for sign in (-1, 1):
        lines = lines.unionByName(
            points.select(
                (F.col("hour") + sign * span).alias("hour"), (F.col("t") + sign * span * hour_ms).alias("at"), F.lit(sign).alias("edge"), "mask", none.alias("n"), "t"
            )
        )
    size = 1 << len(slugs)
    ordered = lines.repartition("hour").sortWithinPartitions("hour", "at", "edge")
    border = ordered.mapInArrow(lambda batches: _borders(batches, size), "mask long, t long, border long").groupBy("mask", "t").agg(F.sum("border").alias("border"))
    near = full.join(border, ["mask", "t"]).select("mask", "t", (F.col("inside") + F.col("border") - 1).alias("others"))
    scored = dated.join(near, ["mask", "t"]).select(
        "signal_id", F.least(F.col("others") / F.lit(3.0), F.lit(1.0)).alias("topic_velocity")
    )
    return signals.select("signal_id").join(scored, "signal_id", "left").select(
        "signal_id", F.coalesce("topic_velocity", F.lit(0.0)).alias("topic_velocity")
    )


def score_context(
    signals: DataFrame,
    links: DataFrame,
    articles: DataFrame,
    sources: DataFrame,
    relations: DataFrame,
    signal_topics: DataFrame,
    now,
    velocity: DataFrame | None = None,
) -> DataFrame:
    """One row per signal with every component value, unclamped.

    ``velocity`` gives the topic velocities where ``signals`` are only some of all.
    """
    members = cut(score_members(links, articles))  # texts are read once, for their lengths
    people = member_scores(members, sources, now)
    edges = relation_scores(scope_relations(relations, members))
    merged = (
        signals.select("signal_id")
        .join(people, "signal_id", "left")
        .join(edges, "signal_id", "left")
        .join(topic_confidence(signal_topics), "signal_id", "left")
        .join(topic_velocity(signals, signal_topics) if velocity is None else velocity, "signal_id", "left")
    )
    strength = evidence_strength(
        F.col("n_sources"), F.coalesce("n_dup", F.lit(0)), F.col("mean_support")
    )
    zero = lambda name: F.coalesce(name, F.lit(0.0)).alias(name)
    return merged.select(
        "signal_id",
        F.coalesce("freshness", F.lit(UNDATED)).alias("freshness"),
        zero("source_count"),
        zero("source_diversity"),
        zero("duplicate_support"),
        zero("community_activity"),
        F.coalesce("source_trust", F.lit(MISSING_TRUST)).alias("source_trust"),
        zero("topic_velocity"),
        F.coalesce("topic_confidence", F.lit(MISSING_TOPIC)).alias("topic_confidence"),
        F.when(F.col("n_sources").isNull(), F.lit(0.0)).otherwise(strength).alias("evidence_strength"),
        zero("content_quality"),
        zero("duplicate_confidence"),
    )


def score_components(context: DataFrame) -> DataFrame:
    """Thirteen (component, value, weight, contribution) rows per signal."""
    parts = []
    for prefix, weights in (("heat", HEAT_WEIGHTS), ("signal", SIGNAL_WEIGHTS)):
        for name, weight in weights.items():
            bounded = clamp01(F.col(name))
            parts.append(
                F.struct(
                    F.lit(f"{prefix}_{name}").alias("component"),
                    round3(bounded).alias("value"),
                    F.lit(weight).alias("weight"),
                    round3(bounded * float(weight)).alias("contribution"),
                )
            )
    return context.select("signal_id", F.explode(F.array(*parts)).alias("part")).select("signal_id", "part.*")


def score_signals(components: DataFrame) -> DataFrame:
    """(signal_id, heat_score, signal_score) from the component rows."""
    total = lambda prefix: round2(
        clamp(round3(F.sum(F.when(F.col("component").startswith(prefix), F.col("contribution")).otherwise(0.0))), 0.0, 100.0)
    )
    return components.groupBy("signal_id").agg(
        total("heat_").alias("heat_score"), total("signal_").alias("signal_score")
    )


def apply_scores(signals: DataFrame, scores: DataFrame) -> DataFrame:
    return signals.drop("heat_score", "signal_score").join(scores, "signal_id", "left")


def score_summary(signals: DataFrame, scores: DataFrame) -> DataFrame:
    return count_tables(checked_signals=signals, scored_signals=scores)
