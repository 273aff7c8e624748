"""Ingestion operators over the records and fetch log derived from the event table."""

from pyspark.sql import functions as F

from storyloom.operators import ingest

from .registry import NOW, query

REC = ("records_fx", "sources", "cursors_fx", "seen_fx")
HOURS = 24 * 20
OLD = f"published_at < TIMESTAMP '{NOW}' - INTERVAL {HOURS} HOUR"
MARKED = f"""marked AS (SELECT r.*, CASE WHEN {OLD.replace('published_at', 'r.published_at')} THEN 'lookback'
    WHEN s.external_id IS NOT NULL AND (r.published_at IS NULL OR r.published_at <= c.last_seen_published_at) THEN 'cursor' END AS skip_reason
  FROM records_fx r LEFT JOIN seen_fx s ON s.source_id = r.source_id AND s.external_id = r.external_id LEFT JOIN cursors_fx c ON c.source_id = r.source_id)"""


@query(
    "filter_keywords",
    REC,
    """ SELECT event_id, r.source_id FROM records_fx r JOIN sources s ON s.source_id = r.source_id WHERE s.filter_keywords IS NULL
    OR len(list_filter(s.filter_keywords, lambda k: contains(lower(r.title || ' ' || r.summary), lower(k)))) > 0""",
)
def filter_keywords(t):
    return ingest.filter_keywords(t.records_fx, t.sources).select("event_id", "source_id")


@query("filter_lookback", REC, f" SELECT event_id FROM records_fx WHERE published_at IS NULL OR NOT ({OLD})")
def filter_lookback(t):
    return ingest.filter_lookback(t.records_fx, NOW, HOURS).select("event_id")


@query(
    "filter_cursor",
    REC,
    """ SELECT event_id FROM records_fx r LEFT JOIN seen_fx s ON s.source_id = r.source_id AND s.external_id = r.external_id LEFT JOIN cursors_fx c ON c.source_id = r.source_id
    WHERE NOT coalesce(s.external_id IS NOT NULL AND (r.published_at IS NULL OR r.published_at <= c.last_seen_published_at), false)""",
)
def filter_cursor(t):
    return ingest.filter_cursor(t.records_fx, t.cursors_fx, t.seen_fx, "scheduled", True).select("event_id")


def _marked(t):
    return ingest.filter_records(t.records_fx, t.cursors_fx, t.seen_fx, NOW, "scheduled", True, False, HOURS)


@query(
    "filter_stats",
    REC,
    f""", {MARKED} SELECT source_id, count(*) AS input, count(*) FILTER (skip_reason IS NULL) AS kept, count(*) FILTER (skip_reason = 'lookback') AS skipped_by_lookback,
    count(*) FILTER (skip_reason = 'cursor') AS skipped_by_cursor FROM marked GROUP BY source_id""",
)
def filter_stats(t):
    return ingest.filter_stats(_marked(t))


CANON = "sha256(replace(payload, ' ', ''))"
# First half of January is what is stored already; the second half is the batch.
RAW = f"""folded AS (SELECT source_id, external_id, arg_min(payload, event_id) AS payload, arg_max(response_meta, event_id) FILTER (response_meta IS NOT NULL) AS response_meta,
    min(fetched_at) AS first_fetched_at, max(fetched_at) AS last_fetched_at, count(*) - 1 AS duplicate_fetch_count FROM records_fx GROUP BY source_id, external_id)"""
HALF = "2024-01-15 00:00:00"


def _halves(t):
    r = t.records_fx
    return r.filter(F.col("fetched_at") < F.lit(HALF).cast("timestamp_ntz")), r.filter(F.col("fetched_at") >= F.lit(HALF).cast("timestamp_ntz"))


def _stored(t, first):
    from storyloom.schemas import RAW_ITEMS

    nothing = t.spark.createDataFrame([], RAW_ITEMS)
    return ingest.upsert_raw_items(nothing, first.withColumn("fetched_at", F.col("fetched_at").cast("timestamp")), ["event_id"])


@query(
    "upsert_raw_items",
    REC,
    f", {RAW} SELECT source_id, external_id, {CANON} AS content_hash, payload, response_meta, first_fetched_at, last_fetched_at, duplicate_fetch_count FROM folded",
)
def upsert_raw_items(t):
    first, second = _halves(t)
    second = second.withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    out = ingest.upsert_raw_items(_stored(t, first), second, ["event_id"])
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select(
        "source_id", "external_id", "content_hash", "payload", "response_meta", ntz("first_fetched_at"), ntz("last_fetched_at"), "duplicate_fetch_count"
    )


@query(
    "split_new",
    REC,
    f""", halves AS (SELECT *, fetched_at < TIMESTAMP '{HALF}' AS early FROM records_fx), keys AS (SELECT source_id, external_id, bool_or(early) AS known, bool_or(NOT early) AS again FROM halves GROUP BY source_id, external_id)
    SELECT source_id, external_id, CASE WHEN known THEN 'duplicate' ELSE 'created' END AS kind FROM keys WHERE again""",
)
def split_new(t):
    first, second = _halves(t)
    created, known = ingest.split_new(first, second)
    return created.withColumn("kind", F.lit("created")).unionByName(known.withColumn("kind", F.lit("duplicate")))


@query("content_hash", REC, f" SELECT event_id, {CANON} AS content_hash FROM records_fx")
def content_hash(t):
    return t.records_fx.select("event_id", ingest.content_hash("payload").alias("content_hash"))


@query(
    "advance_cursors",
    REC,
    f""", {MARKED}, newest AS (SELECT source_id, max(published_at) AS newest FROM marked WHERE skip_reason IS NULL GROUP BY source_id)
    SELECT coalesce(c.source_id, n.source_id) AS source_id, greatest(c.last_seen_published_at, n.newest) AS last_seen_published_at,
    CASE WHEN n.source_id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE c.last_successful_fetch_at END AS last_successful_fetch_at FROM cursors_fx c FULL JOIN newest n ON n.source_id = c.source_id""",
)
def advance_cursors(t):
    out = ingest.advance_cursors(t.cursors_fx, _marked(t).filter("skip_reason IS NULL"), NOW)
    return out.select("source_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in out.columns[1:]])


@query("advance_seen", REC, f", {MARKED} SELECT source_id, external_id FROM seen_fx UNION SELECT source_id, external_id FROM marked WHERE skip_reason IS NULL")
def advance_seen(t):
    return ingest.advance_seen(t.seen_fx, _marked(t).filter("skip_reason IS NULL"))


LOG = ("fetch_log_fx", "sources")
CLASSED = """classed AS (SELECT *, CASE WHEN http_status BETWEEN 200 AND 299 THEN 'success' WHEN http_status = 429 THEN 'rate_limited' WHEN http_status IN (401, 403) THEN 'configuration_error'
    WHEN http_status >= 500 THEN 'transient_failure' ELSE 'permanent_failure' END AS category FROM fetch_log_fx)"""


@query("classify_outcomes", LOG, f", {CLASSED} SELECT event_id, category, category IN ('rate_limited', 'transient_failure') AS retryable FROM classed")
def classify_outcomes(t):
    return ingest.classify_outcomes(t.fetch_log_fx).select("event_id", "category", "retryable")


@query(
    "update_health",
    LOG,
    f""", {CLASSED}, days AS (SELECT concat(source_id, '/', strftime(attempted_at, '%d')) AS source_id, attempted_at, event_id, category FROM classed),
    ok AS (SELECT source_id, max(attempted_at) FILTER (category = 'success') AS ok_time, max(attempted_at) FILTER (category <> 'success') AS bad_time FROM days GROUP BY source_id)
    SELECT o.source_id, ok_time AS last_successful_at, bad_time AS last_failure_at, CASE WHEN ok_time IS NULL THEN 2 ELSE 0 END + count(d.event_id) AS failure_count,
      arg_max(d.category, d.attempted_at) AS last_error_category
    FROM ok o LEFT JOIN days d ON d.source_id = o.source_id AND d.category <> 'success' AND (ok_time IS NULL OR d.attempted_at > ok_time) GROUP BY o.source_id, ok_time, bad_time""",
)
def update_health(t):
    log = ingest.classify_outcomes(t.fetch_log_fx).select(
        F.concat("source_id", F.lit("/"), F.date_format("attempted_at", "dd")).alias("source_id"), F.col("attempted_at").alias("at"),
        F.col("event_id").alias("seq"), (F.col("category") == "success").alias("ok"), F.col("category").alias("error_category"),
    )
    start = log.select("source_id").distinct().select(
        "source_id", F.lit(None).cast("timestamp_ntz").alias("last_successful_at"), F.lit(None).cast("timestamp_ntz").alias("last_failure_at"),
        F.lit(2).alias("failure_count"), F.lit("old").alias("last_error_category"),
    )
    return ingest.update_health(start, log)


@query("due_sources", LOG, f" SELECT source_id FROM sources WHERE enabled AND (next_fetch_at IS NULL OR next_fetch_at <= TIMESTAMP '{NOW}')")
def due_sources(t):
    return ingest.due_sources(t.sources, NOW).select("source_id")


@query(
    "next_fetch",
    LOG,
    f""", {CLASSED}, latest AS (SELECT * FROM classed QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY event_id DESC) = 1)
    SELECT s.source_id, CASE WHEN category = 'success' THEN TIMESTAMP '{NOW}' + INTERVAL 1 MINUTE * fetch_interval_minutes
      WHEN category = 'rate_limited' THEN TIMESTAMP '{NOW}' + INTERVAL 1 SECOND * CAST(coalesce(retry_after_seconds, least(60 * pow(2, attempts), 3600)) AS INT)
      ELSE next_fetch_at END AS next_fetch_at FROM sources s LEFT JOIN latest l ON l.source_id = s.source_id""",
)
def next_fetch(t):
    log = ingest.classify_outcomes(t.fetch_log_fx)
    retry = F.lit(NOW).cast("timestamp") + F.make_interval(secs=F.col("retry_after_seconds"))
    picked = log.withColumn("retry_after", F.when(F.col("retry_after_seconds").isNotNull(), retry))
    latest = picked.groupBy("source_id").agg(
        F.max_by(F.struct("category", "attempts", "retry_after"), "event_id").alias("o")
    ).select("source_id", "o.*")
    out = ingest.next_fetch(t.sources, latest, NOW)
    return out.select("source_id", F.col("next_fetch_at").cast("timestamp_ntz").alias("next_fetch_at"))


READY = f"""ready AS (SELECT source_id, name, source_type, next_fetch_at, fetch_interval_minutes, CASE WHEN NOT enabled THEN 'disabled'
      WHEN source_type IN ('rss', 'atom') AND coalesce(feed_url, '') = '' THEN 'missing_feed_url'
      WHEN source_type NOT IN ('rss', 'atom', 'hacker_news') AND coalesce(api_endpoint, '') = '' THEN 'missing_api_endpoint'
      WHEN credential_ref IS NOT NULL AND credential_ref NOT IN ('KEY_3', 'KEY_14') THEN 'credential_missing' END AS reason FROM sources),
  due AS (SELECT source_id, CASE WHEN reason IS NULL AND next_fetch_at > TIMESTAMP '{NOW}' THEN 'not_due' ELSE reason END AS reason FROM ready)"""


def _ready(t):
    refs = t.spark.createDataFrame([("KEY_3",), ("KEY_14",)], "ref STRING")
    return ingest.source_readiness(t.sources, refs)


@query("source_readiness", LOG, f", {READY} SELECT source_id, CASE WHEN reason IS NULL THEN 'ready' ELSE 'skipped' END AS status, reason FROM ready")
def source_readiness(t):
    return _ready(t).select("source_id", "status", "reason")


@query("mark_not_due", LOG, f", {READY} SELECT source_id, CASE WHEN reason IS NULL THEN 'ready' ELSE 'skipped' END AS status, reason FROM due")
def mark_not_due(t):
    return ingest.mark_not_due(_ready(t), t.sources, "scheduled", False, NOW).select("source_id", "status", "reason")


@query("skipped_reasons", LOG, f", {READY} SELECT reason, count(*) AS n FROM due WHERE reason IS NOT NULL GROUP BY reason")
def skipped_reasons(t):
    return ingest.skipped_reasons(ingest.mark_not_due(_ready(t), t.sources, "scheduled", False, NOW))


# Broken on purpose by the source number: one rule per row.
@query(
    "validate_sources",
    LOG,
    """ SELECT source_id, CASE n WHEN 0 THEN 'name_required' WHEN 1 THEN 'unsupported_source_type' WHEN 2 THEN 'unsupported_family' WHEN 3 THEN 'invalid_language' WHEN 4 THEN 'invalid_fetch_interval'
      WHEN 5 THEN 'invalid_freshness_window' WHEN 6 THEN 'invalid_trust_score' WHEN 8 THEN 'feed_url_required' WHEN 19 THEN 'credential_required' WHEN 7 THEN 'usage_policy_required' END AS error
    FROM (SELECT source_id, CAST(substr(source_id, 4) AS INT) AS n FROM sources)""",
)
def validate_sources(t):
    n = F.substring("source_id", 4, 9).cast("int")
    broken = t.sources.withColumns(
        {
            "name": F.when(n == 0, "  ").otherwise(F.col("name")),
            "source_type": F.when(n == 1, "gopher").otherwise(F.col("source_type")),
            "family": F.when(n == 2, "gossip").otherwise(F.col("family")),
            "language": F.when(n == 3, "EN").otherwise(F.col("language")),
            "fetch_interval_minutes": F.when(n == 4, 4).otherwise(F.col("fetch_interval_minutes")),
            "freshness_window_hours": F.when(n == 5, -1.0).otherwise(F.col("freshness_window_hours")),
            "trust_score": F.when(n == 6, 1.2).otherwise(F.col("trust_score")),
            "credential_ref": F.when(n == 19, None).otherwise(F.col("credential_ref")),
            "allow_summary": F.when(n == 7, None).otherwise(F.col("allow_summary")),
        }
    )
    return ingest.validate_sources(broken).select("source_id", "error")


OUT = f"""outs AS (SELECT concat(source_id, '/', strftime(attempted_at, '%d')) AS source_id, CASE WHEN http_status = 200 THEN 'succeeded' WHEN http_status = 403 THEN 'skipped' WHEN http_status = 429 THEN 'ready' ELSE 'failed' END AS status,
    event_id % 7 AS fetched FROM fetch_log_fx)"""


def _outcomes(t):
    s = F.col("http_status")
    return t.fetch_log_fx.select(
        F.concat("source_id", F.lit("/"), F.date_format("attempted_at", "dd")).alias("source_id"),
        F.when(s == 200, "succeeded").when(s == 403, "skipped").when(s == 429, "ready").otherwise("failed").alias("status"),
        F.lit("r").alias("reason"), (F.col("event_id") % 7).alias("fetched"), F.lit(0).alias("processed"),
    )


@query(
    "outcome_counts",
    LOG,
    f""", {OUT} SELECT count(*) FILTER (status <> 'skipped') AS ready, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'succeeded') AS succeeded,
    count(*) FILTER (status = 'failed') AS failed, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(0 AS BIGINT) AS processed FROM outs""",
)
def outcome_counts(t):
    return ingest.outcome_counts(_outcomes(t))


@query(
    "processed_counts",
    LOG,
    f" SELECT source_id, (SELECT count(*) FROM fetch_log_fx f WHERE f.source_id = s.source_id AND http_status = 200) AS processed FROM sources s",
)
def processed_counts(t):
    results = t.fetch_log_fx.select("source_id", F.when(F.col("http_status") == 200, "completed").otherwise("failed").alias("status"))
    start = t.sources.select("source_id", F.lit(0).alias("processed"))
    return ingest.processed_counts(start, results).select("source_id", "processed")


@query(
    "signals_for_articles",
    ("articles", "links_fx"),
    " SELECT DISTINCT signal_id FROM links_fx l JOIN articles a ON a.article_id = l.article_id WHERE a.published_at > TIMESTAMP '2024-01-20 00:00:00'",
)
def signals_for_articles(t):
    """Signals of the articles published after a cursor."""
    touched = t.articles.filter("published_at > TIMESTAMP_NTZ '2024-01-20 00:00:00'").select("article_id")
    return ingest.signals_for_articles(t.links_fx, touched)


RUNS = """runs AS (SELECT CAST(epoch_ms(date_trunc('hour', ts)) / 3600000 AS BIGINT) AS run, max(ts) AS last_ts, count(*) FILTER (event_type = 'view' AND value > 12) AS succeeded,
    count(*) FILTER (event_type = 'error' AND value > 20) AS failed, count(*) FILTER (event_type = 'signup' AND value > 20) AS skipped FROM events GROUP BY 1)"""


@query(
    "run_state",
    ("records_fx",),
    f""", {RUNS} SELECT run, run % 9 <> 1 AND last_ts < TIMESTAMP '2024-01-30 12:00:00' AS stale, CASE WHEN run % 9 = 1 THEN 'demo' WHEN run % 11 = 3 THEN 'loading'
      WHEN succeeded > 0 AND (failed > 0 OR skipped > 0) THEN 'partial_live' WHEN succeeded > 0 AND last_ts < TIMESTAMP '2024-01-30 12:00:00' THEN 'stale_live'
      WHEN succeeded > 0 THEN 'live' WHEN failed > 0 THEN 'failed' ELSE 'empty' END AS state FROM runs""",
)
def run_state(t):
    n = lambda kind, floor: F.count_if((F.col("event_type") == kind) & (F.col("value") > floor))
    runs = t.events.groupBy((F.unix_millis(F.date_trunc("hour", "ts").cast("timestamp")) / 3600000).cast("long").alias("run")).agg(
        F.max("ts").alias("last_live_fetch_at"), n("view", 12).alias("succeeded"), n("error", 20).alias("failed"), n("signup", 20).alias("skipped")
    )
    rows = runs.withColumn("mode", F.when(F.col("run") % 9 == 1, "demo").otherwise("live")).withColumn(
        "completed_at", F.when(F.col("run") % 11 == 3, None).otherwise(F.col("last_live_fetch_at"))
    )
    return ingest.run_state(rows, "2024-01-30 18:00:00").select("run", "stale", "state")
