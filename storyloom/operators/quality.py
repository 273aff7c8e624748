"""Article quality and freshness gating, and the external relevance verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from ..functions.times import age_hours, order_key, ts_lit

# Hours an article stays fresh, by source family.
FRESH_HOURS = {
    "technology_media": 168.0,
    "company_announcement": 336.0,
    "research": 720.0,
    "funding": 720.0,
    "policy": 720.0,
    "community": 72.0,
    "product_launch": 336.0,
}
DEFAULT_FRESH_HOURS = 168.0
LANGUAGES = ["en", "zh", "zh-CN"]
VERDICT_BATCH = 15


def _text_length(name: str) -> Column:
    return F.length(F.trim(F.coalesce(F.col(name), F.lit(""))))


def reasons_column() -> Column:
    """Low-quality reasons in fixed order."""
    return F.array_compact(
        F.array(
            F.when(_text_length("title") < 6, "missing_title"),
            F.when(F.coalesce(F.col("canonical_url"), F.lit("")) == "", "missing_url"),
            F.when(F.col("published_at").isNull(), "missing_published_at"),
            F.when((_text_length("excerpt") < 20) & (_text_length("text_for_ai") < 80), "missing_content"),
            F.when((F.col("language") != "") & ~F.col("language").isin(*LANGUAGES), "unsupported_language"),
        )
    )


def quality_reasons(articles: DataFrame) -> DataFrame:
    """Articles with ``low_reasons``."""
    return articles.withColumn("low_reasons", reasons_column())


def _fresh_hours() -> Column:
    family = F.lit(None).cast("double")
    for name, hours in FRESH_HOURS.items():
        family = F.when(F.col("s_family") == name, F.lit(hours)).otherwise(family)
    override = F.when(F.col("s_window") > 0, F.col("s_window"))
    return F.coalesce(override, family, F.lit(DEFAULT_FRESH_HOURS))


def staleness(articles: DataFrame, sources: DataFrame, now) -> DataFrame:
    """Articles with ``window_hours`` and ``is_stale``; undated articles are never stale."""
    windows = sources.select(
        "source_id", F.col("family").alias("s_family"), F.col("freshness_window_hours").alias("s_window")
    )
    joined = articles.join(windows, "source_id", "left").withColumn("window_hours", _fresh_hours())
    stale = age_hours("published_at", ts_lit(now)) > F.col("window_hours")
    return joined.withColumn("is_stale", F.coalesce(stale, F.lit(False))).drop("s_family", "s_window")


def classify_articles(articles: DataFrame, sources: DataFrame, now, verdicts: DataFrame | None = None) -> DataFrame:
    """``quality_status``, ``visibility_status`` and ``quality_reasons`` per article.

    ``verdicts`` (article_id, relevant) adds the reason ``irrelevant_to_topic``;
    leave it out for the behaviour where a verdict does not survive this pass.
    """
    base = articles.drop("quality_status", "visibility_status", "quality_reasons", "quality_checked_at")
    graded = quality_reasons(staleness(base, sources, now))
    if verdicts is not None:
        flagged = irrelevant_articles(graded, sources, verdicts).select(
            "article_id", F.lit(True).alias("irrelevant")
        )
        graded = graded.join(flagged, "article_id", "left").withColumn(
            "low_reasons",
            F.when(F.col("irrelevant"), F.array_append("low_reasons", F.lit("irrelevant_to_topic"))).otherwise(
                F.col("low_reasons")
            ),
        ).drop("irrelevant")
    reasons = F.when(F.col("is_stale"), F.array_append("low_reasons", F.lit("stale_for_latest"))).otherwise(
        F.col("low_reasons")
    )
    return (
        graded.withColumn("quality_reasons", reasons)
        .withColumn("quality_status", F.when(F.size("low_reasons") > 0, "low_quality").otherwise("approved"))
        .withColumn(
            "visibility_status", F.when(F.size("quality_reasons") > 0, "hidden_latest").otherwise("visible_latest")
        )
        .withColumn("quality_checked_at", ts_lit(now))
        .drop("low_reasons", "window_hours", "is_stale")
    )


def quality_summary(classified: DataFrame) -> DataFrame:
    visible = F.col("visibility_status") == "visible_latest"
    return classified.agg(
        F.count("*").alias("checked_articles"),
        F.count_if(visible).alias("visible_latest"),
        F.count_if(~visible).alias("hidden_latest"),
        F.count_if(F.col("quality_status") == "low_quality").alias("low_quality"),
    )


def relevance_candidates(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles a relevance judge is asked about: keyword sources, not low quality."""
    keyed = sources.filter(F.size(F.coalesce("filter_keywords", F.array())) > 0).select("source_id")
    status = F.col("quality_status") if "quality_status" in articles.columns else F.when(
        F.size(reasons_column()) > 0, "low_quality"
    ).otherwise("approved")
    return articles.filter(F.coalesce(status, F.lit("")) != "low_quality").join(keyed, "source_id", "left_semi")


def irrelevant_articles(articles: DataFrame, sources: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates whose verdict is false; a missing verdict counts as relevant."""
    refused = verdicts.filter(~F.col("relevant")).select("article_id").distinct()
    return relevance_candidates(articles, sources).join(refused, "article_id", "left_semi")


def apply_relevance(articles: DataFrame, sources: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Mark refused candidates low quality and hidden; all other rows keep their status."""
    refused = irrelevant_articles(articles, sources, verdicts).select("article_id", F.lit(True).alias("refused"))
    hit = F.coalesce(F.col("refused"), F.lit(False))
    return (
        articles.join(refused, "article_id", "left")
        .withColumn("quality_status", F.when(hit, "low_quality").otherwise(F.col("quality_status")))
        .withColumn("visibility_status", F.when(hit, "hidden_latest").otherwise(F.col("visibility_status")))
        .withColumn(
            "quality_reasons", F.when(hit, F.array(F.lit("irrelevant_to_topic"))).otherwise(F.col("quality_reasons"))
        )
        .drop("refused")
    )


def verdict_batches(candidates: DataFrame, size: int = VERDICT_BATCH, buckets: int = 256) -> DataFrame:
    """``batch_no`` and ``position`` (0-based) in article order, ``size`` articles a batch.

    A global row number would sort everything in one task, so rows are numbered
    inside id-range slices and the (few) slice sizes are added as offsets.
    """
    keyed = candidates.withColumn("okey", order_key())
    # The slice of a row is written down, so it stays the same when a task runs again.
    spans = cut(keyed.repartitionByRange(buckets, "okey").withColumn("slice", F.spark_partition_id()))
    sizes = spans.groupBy("slice").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = spans.join(F.broadcast(offsets), "slice")  # at most ``buckets`` rows
    number = F.row_number().over(Window.partitionBy("slice").orderBy("okey")) + F.col("before") - 1
    return (
        placed.withColumn("number", number)
        .withColumn("batch_no", F.floor(F.col("number") / size))
        .withColumn("position", (F.col("number") % size).cast("int"))
        .drop("okey", "slice", "before", "number")
    )


def parse_verdicts(answers: DataFrame, batches: DataFrame) -> DataFrame:
    """Free-text answers (batch_no, content) → (article_id, relevant).

    The answer must hold a JSON list with one flag per article of its batch;
    anything else makes the whole batch relevant.
    """
    sizes = batches.groupBy("batch_no").agg(F.count("*").alias("expected"))
    unfenced = F.trim(F.replace(F.regexp_replace("content", "```json?\\s*", ""), F.lit("```"), F.lit("")))
    listed = F.regexp_extract(unfenced, "(?s)(\\[.*\\])", 1)
    flags = F.from_json(listed, "ARRAY<STRING>")
    parsed = (
        answers.join(sizes, "batch_no")
        .withColumn("flags", F.when(F.size(flags) == F.col("expected"), flags))
        .select("batch_no", "flags")
    )
    flag = F.element_at("flags", F.col("position") + 1)
    return batches.join(parsed, "batch_no", "left").select(
        "article_id",
        F.when(F.col("flags").isNull(), F.lit(True))
        .otherwise(F.coalesce(flag.isin("true", "1"), F.lit(False)))
        .alias("relevant"),
    )
