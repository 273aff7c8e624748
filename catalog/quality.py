"""Quality gate, staleness and relevance verdicts."""

from pyspark.sql import functions as F

from storyloom.operators import quality

from .registry import GRADED, NOW, query

BASE = ("articles", "sources")


@query("quality_reasons", BASE, f", {GRADED} SELECT article_id, coalesce(array_to_string(low_reasons, ','), '') AS reasons FROM graded")
def quality_reasons(t):
    return quality.quality_reasons(t.articles).select("article_id", F.array_join("low_reasons", ",").alias("reasons"))


@query("staleness", BASE, f", {GRADED} SELECT article_id, window_hours, is_stale FROM graded")
def staleness(t):
    return quality.staleness(t.articles, t.sources, NOW).select("article_id", "window_hours", "is_stale")


@query(
    "classify_articles",
    BASE,
    f""", {GRADED} SELECT article_id, quality_status, visibility_status,
    coalesce(array_to_string(quality_reasons, ','), '') AS reasons FROM classified""",
)
def classify_articles(t):
    return quality.classify_articles(t.articles, t.sources, NOW).select(
        "article_id", "quality_status", "visibility_status", F.array_join("quality_reasons", ",").alias("reasons")
    )


@query(
    "classify_with_verdicts",
    (*BASE, "verdicts_fx"),
    f""", {GRADED}, refused AS (
      SELECT c.article_id FROM classified c JOIN sources s ON s.source_id = c.source_id JOIN verdicts_fx v ON v.article_id = c.article_id
      WHERE s.filter_keywords IS NOT NULL AND len(s.filter_keywords) > 0 AND c.quality_status <> 'low_quality' AND NOT v.relevant)
    SELECT c.article_id, CASE WHEN r.article_id IS NOT NULL THEN 'low_quality' ELSE quality_status END AS quality_status,
      CASE WHEN r.article_id IS NOT NULL THEN 'hidden_latest' ELSE visibility_status END AS visibility_status,
      coalesce(array_to_string(CASE WHEN r.article_id IS NULL THEN quality_reasons
        WHEN is_stale THEN ['irrelevant_to_topic', 'stale_for_latest'] ELSE ['irrelevant_to_topic'] END, ','), '') AS reasons
    FROM classified c LEFT JOIN refused r ON r.article_id = c.article_id""",
)
def classify_with_verdicts(t):
    return quality.classify_articles(t.articles, t.sources, NOW, t.verdicts_fx).select(
        "article_id", "quality_status", "visibility_status", F.array_join("quality_reasons", ",").alias("reasons")
    )


@query(
    "quality_summary",
    BASE,
    f""", {GRADED} SELECT count(*) AS checked_articles, count(*) FILTER (visibility_status = 'visible_latest') AS visible_latest,
    count(*) FILTER (visibility_status <> 'visible_latest') AS hidden_latest,
    count(*) FILTER (quality_status = 'low_quality') AS low_quality FROM classified""",
)
def quality_summary(t):
    return quality.quality_summary(quality.classify_articles(t.articles, t.sources, NOW))


@query(
    "apply_relevance",
    (*BASE, "verdicts_fx"),
    f""", {GRADED} SELECT c.article_id,
      CASE WHEN hit THEN 'low_quality' ELSE quality_status END AS quality_status,
      CASE WHEN hit THEN 'hidden_latest' ELSE visibility_status END AS visibility_status,
      CASE WHEN hit THEN 'irrelevant_to_topic' ELSE coalesce(array_to_string(quality_reasons, ','), '') END AS reasons
    FROM (SELECT c.*, coalesce(len(s.filter_keywords) > 0 AND quality_status <> 'low_quality' AND NOT v.relevant, false) AS hit
      FROM classified c JOIN sources s ON s.source_id = c.source_id LEFT JOIN verdicts_fx v ON v.article_id = c.article_id) c""",
)
def apply_relevance(t):
    graded = quality.classify_articles(t.articles, t.sources, NOW)
    return quality.apply_relevance(graded, t.sources, t.verdicts_fx).select(
        "article_id", "quality_status", "visibility_status", F.array_join("quality_reasons", ",").alias("reasons")
    )


BATCHES = """, keyed AS (
    SELECT a.article_id, row_number() OVER (ORDER BY coalesce(a.published_at, a.created_at), a.article_id) - 1 AS number
    FROM classified a JOIN sources s ON s.source_id = a.source_id WHERE len(s.filter_keywords) > 0 AND a.quality_status <> 'low_quality'),
  batched AS (SELECT article_id, CAST(floor(number / 15.0) AS BIGINT) AS batch_no, CAST(number % 15 AS INT) AS position FROM keyed)"""


@query("verdict_batches", BASE, f", {GRADED} {BATCHES} SELECT * FROM batched")
def verdict_batches(t):
    graded = quality.classify_articles(t.articles, t.sources, NOW)
    batches = quality.verdict_batches(quality.relevance_candidates(graded, t.sources))
    return batches.select("article_id", "batch_no", "position")


# Answers: even batches a fenced list of flags by position, every third batch unreadable, the rest too short.
@query(
    "parse_verdicts",
    BASE,
    f""", {GRADED} {BATCHES}, sizes AS (SELECT batch_no, count(*) AS n FROM batched GROUP BY batch_no)
    SELECT article_id, CASE WHEN b.batch_no % 3 = 0 OR b.batch_no % 2 = 1 THEN true ELSE position % 4 <> 1 END AS relevant
    FROM batched b JOIN sizes s ON s.batch_no = b.batch_no""",
)
def parse_verdicts(t):
    graded = quality.classify_articles(t.articles, t.sources, NOW)
    batches = quality.verdict_batches(quality.relevance_candidates(graded, t.sources)).select("article_id", "batch_no", "position")
    flags = F.transform(
        F.sequence(F.lit(0), (F.col("n") - 1).cast("int")),
        lambda i: F.when(i % 4 == 1, "false").when(i % 4 == 2, "1").when(i % 4 == 3, '"true"').otherwise("true"),
    )
    listed = F.concat(F.lit("```json\n["), F.array_join(flags, ", "), F.lit("]\n```"))
    answers = batches.groupBy("batch_no").agg(F.count("*").alias("n")).select(
        "batch_no",
        F.when(F.col("batch_no") % 3 == 0, "no list here")
        .when(F.col("batch_no") % 2 == 1, "[true]")
        .otherwise(listed)
        .alias("content"),
    )
    return quality.parse_verdicts(answers, batches)
