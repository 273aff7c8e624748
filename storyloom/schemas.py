"""Table shapes shared by readers and operators."""

from __future__ import annotations

from pyspark.sql import types as T

STR, INT, LONG, DBL, BOOL, TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
)
STRS = T.ArrayType(STR)


def shape(*parts: tuple[T.DataType, str]) -> T.StructType:
    """A schema from (type, space-separated column names) groups, in order."""
    return T.StructType([T.StructField(name, kind) for kind, names in parts for name in names.split()])


SOURCES = shape(
    (STR, "source_id name source_type family feed_url api_endpoint query language"),
    (STRS, "filter_keywords"),
    (INT, "fetch_limit fetch_interval_minutes"),
    (DBL, "freshness_window_hours trust_score"),
    (STR, "credential_ref"),
    (BOOL, "allow_full_text allow_summary commercial_use_needs_review attribution_required enabled"),
    (TS, "next_fetch_at"),
)

RECORDS = shape(
    (STR, "source_id source_type external_id title url"),
    (TS, "published_at updated_at"),
    (STR, "author"),
    (STRS, "authors"),
    (STR, "summary"),
    (STRS, "categories"),
    (STR, "payload response_meta"),
    (TS, "fetched_at"),
)

RAW_ITEMS = shape(
    (STR, "source_id external_id content_hash payload response_meta"),
    (TS, "first_fetched_at last_fetched_at"),
    (LONG, "duplicate_fetch_count"),
)

ARTICLES = shape(
    (STR, "article_id raw_item_id source_id canonical_url title language excerpt author text_for_ai"),
    (TS, "published_at created_at"),
    (BOOL, "full_text_display_allowed"),
    (STR, "content_hash"),
    (LONG, "community_score community_comments community_votes"),
    (STR, "dedupe_status"),
)

# Articles as stored after a run.
STORED_ARTICLES = T.StructType(
    ARTICLES.fields
    + shape((STR, "quality_status visibility_status"), (STRS, "quality_reasons"), (TS, "quality_checked_at")).fields
)

RELATIONS = shape(
    (STR, "relation_type source_id article_id signal_id target_article_id"),
    (DBL, "confidence title_similarity hours_apart"),
    (STRS, "reasons"),
    (DBL, "cluster_score"),
    (STR, "role"),
    (BOOL, "duplicate_support"),
    (DBL, "heat_boost credibility_boost"),
    (TS, "detected_at"),
)

RELATION_KEY = ["relation_type", "source_id", "article_id", "signal_id", "target_article_id"]

KEY_POINTS = T.ArrayType(shape((STR, "text"), (STRS, "source_ids")))
TIMELINE = T.ArrayType(shape((STR, "label at"), (STRS, "source_ids")))
SOURCE_MIX = T.ArrayType(shape((STR, "source_id source_name role")))

SIGNALS = shape(
    (STR, "signal_id slug title summary status"),
    (DBL, "heat_score signal_score"),
    (TS, "primary_published_at"),
    (STR, "enrichment_status ai_brief"),
    (KEY_POINTS, "key_points"),
    (TIMELINE, "timeline"),
    (SOURCE_MIX, "source_mix"),
    (STR, "next_watch"),
    (STRS, "related_signal_ids"),
    (STR, "enrichment_error enrichment_provider error_category"),
    (BOOL, "fallback_generated"),
    (INT, "enrichment_version enrichment_source_count"),
    (TS, "enrichment_generated_at enrichment_failed_at"),
    (STR, "backfill_reason previous_status"),
    (TS, "created_at updated_at"),
)

LINKS = shape((STR, "signal_id article_id role"))

SIGNAL_TOPICS = shape(
    (STR, "signal_id topic_slug method"),
    (DBL, "confidence"),
    (STR, "reason matched_by"),
    (STRS, "matched_terms source_families source_types"),
)

SCORE_COMPONENTS = shape((STR, "signal_id component"), (DBL, "value"), (INT, "weight"), (DBL, "contribution"))

CURSORS = shape((STR, "source_id"), (TS, "last_seen_published_at last_successful_fetch_at"))
HEALTH = shape(
    (STR, "source_id"), (TS, "last_successful_at last_failure_at"), (T.LongType(), "failure_count"), (STR, "last_error_category")
)
SCHEDULE = shape((STR, "source_id"), (TS, "next_fetch_at"))
SEEN_IDS = shape((STR, "source_id external_id"))
