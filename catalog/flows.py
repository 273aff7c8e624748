"""Streaming and whole-run queries."""

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from storyloom.operators import quality
from storyloom.operators.lineage import shared_folder
from storyloom.plans import batch
from storyloom.streaming import incremental as inc

from .enrich import STALE
from .ingest import CANON, RAW, REC
from .registry import NOW, query
from .scoring import BASE as SCORE_BASE
from .scoring import SCORES
from .serving import _points

CLOCK = datetime(2024, 1, 31)


def _folder(t, name):
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _land_records(t):
    """Records by ten-day span of their fetch, each span appended as the files Spark makes of it."""
    path = _folder(t, "records")
    utc = lambda c: F.col(c).cast("timestamp").alias(c)
    r = t.records_fx.select("source_id", "external_id", "title", "url", utc("published_at"), utc("fetched_at"), "summary", "payload", "response_meta")
    day = F.dayofmonth(F.col("fetched_at") - F.expr("INTERVAL 1 HOUR"))
    for low, high in ((1, 10), (11, 20), (21, 31)):
        r.filter(day.between(low, high)).write.mode("append").parquet(path)
    return path, r.schema


def _sink(path):
    def write(df, batch_id):
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def _ntz(df, *names):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in names})


@query(
    "stream_raw_items",
    REC,
    f", {RAW} SELECT source_id, external_id, {CANON} AS content_hash, payload, response_meta, first_fetched_at, last_fetched_at, duplicate_fetch_count FROM folded",
)
def stream_raw_items(t):
    landing, schema = _land_records(t)
    root = _folder(t, "raw")
    inc.stream_raw_items(t.spark, landing, root, _folder(t, "ckpt"), None, schema, 1).awaitTermination()
    return _ntz(inc.raw_items(t.spark, root), "first_fetched_at", "last_fetched_at")


FIRST = " SELECT DISTINCT source_id, external_id FROM records_fx"


@query("stream_first_seen", REC, FIRST)
def stream_first_seen(t):
    landing, schema = _land_records(t)
    out = _folder(t, "first")
    rows = inc.stream_first_seen(inc.landing_records(t.spark, landing, schema, 1), "60 days")
    inc.start(rows, _sink(out), _folder(t, "ckpt"), None).awaitTermination()
    return t.spark.read.parquet(out).select("source_id", "external_id")


@query("stream_first_seen_exact", REC, FIRST)
def stream_first_seen_exact(t):
    landing, schema = _land_records(t)
    out, root = _folder(t, "first"), _folder(t, "seen")
    handler = inc.first_seen_exact(root, _sink(out))
    inc.start(inc.landing_records(t.spark, landing, schema, 1), handler, _folder(t, "ckpt"), None).awaitTermination()
    return t.spark.read.parquet(out).select("source_id", "external_id")


@query(
    "stream_lookback",
    REC,
    f" SELECT source_id, external_id, fetched_at FROM records_fx WHERE published_at IS NULL OR published_at >= TIMESTAMP '{NOW}' - INTERVAL 240 HOUR",
)
def stream_lookback(t):
    landing, schema = _land_records(t)
    out = _folder(t, "look")
    rows = inc.stream_lookback(inc.landing_records(t.spark, landing, schema, 1), NOW, 240)
    inc.start(rows, _sink(out), _folder(t, "ckpt"), None).awaitTermination()
    return _ntz(t.spark.read.parquet(out).select("source_id", "external_id", "fetched_at"), "fetched_at")


@query(
    "stream_source_state",
    REC,
    " SELECT source_id, max(published_at) AS last_seen_published_at, max(fetched_at) AS last_successful_fetch_at, count(*) AS records FROM records_fx GROUP BY source_id",
)
def stream_source_state(t):
    landing, schema = _land_records(t)
    out = _folder(t, "state")
    rows = inc.stream_source_state(inc.landing_records(t.spark, landing, schema, 1))
    inc.start(rows, _sink(out), _folder(t, "ckpt"), None, "update").awaitTermination()
    newest = t.spark.read.parquet(out).groupBy("source_id").agg(
        F.max_by(F.struct("last_seen_published_at", "last_successful_fetch_at", "records"), "batch").alias("s")
    )
    return _ntz(newest.select("source_id", "s.*"), "last_seen_published_at", "last_successful_fetch_at")


@query(
    "stream_date_summary",
    ("signals_fx",),
    """ SELECT strftime(primary_published_at, '%Y-%m-%d') AS date, count(*) AS signal_count FROM signals_fx WHERE status NOT IN ('hidden', 'deleted') AND primary_published_at IS NOT NULL GROUP BY 1""",
)
def stream_date_summary(t):
    landing, out = _folder(t, "signals"), _folder(t, "days")
    rows = t.signals_fx.select("signal_id", "status", F.col("primary_published_at").cast("timestamp").alias("primary_published_at"))
    rows.repartition(3, "signal_id").write.parquet(landing)
    days = inc.stream_date_summary(inc.landing_records(t.spark, landing, rows.schema, 1))
    inc.start(days, _sink(out), _folder(t, "ckpt"), None, "update").awaitTermination()
    return t.spark.read.parquet(out).groupBy("date").agg(F.max_by("signal_count", "batch").alias("signal_count"))


@query(
    "stream_health",
    ("fetch_log_fx",),
    """, days AS (SELECT concat(source_id, '/', strftime(attempted_at, '%d')) AS source_id, attempted_at, event_id, CASE http_status WHEN 200 THEN 'success' WHEN 429 THEN 'rate_limited' WHEN 403 THEN 'configuration_error' ELSE 'transient_failure' END AS category FROM fetch_log_fx),
    ok AS (SELECT source_id, max(attempted_at) FILTER (category = 'success') AS ok_time, max(attempted_at) FILTER (category <> 'success') AS bad_time FROM days GROUP BY source_id)
    SELECT o.source_id, ok_time AS last_successful_at, bad_time AS last_failure_at, count(d.event_id) AS failure_count, arg_max(d.category, d.attempted_at) AS last_error_category
    FROM ok o LEFT JOIN days d ON d.source_id = o.source_id AND d.category <> 'success' AND (ok_time IS NULL OR d.attempted_at > ok_time) GROUP BY o.source_id, ok_time, bad_time""",
)
def stream_health(t):
    from storyloom.operators import ingest

    log = ingest.classify_outcomes(t.fetch_log_fx).select(
        F.concat("source_id", F.lit("/"), F.date_format("attempted_at", "dd")).alias("source_id"), F.col("attempted_at").cast("timestamp").alias("at"),
        F.col("event_id").alias("seq"), (F.col("category") == "success").alias("ok"), F.col("category").alias("error_category"),
    )
    landing, root = _folder(t, "log"), _folder(t, "health")
    for half in (0, 1):  # arrival in time order
        log.filter((F.hour("at") >= 12) == bool(half)).write.mode("append").parquet(landing)
    none = F.lit(None).cast("timestamp")
    first = log.select("source_id").distinct().select(
        "source_id", none.alias("last_successful_at"), none.alias("last_failure_at"), F.lit(0).cast("bigint").alias("failure_count"), F.lit(None).cast("string").alias("last_error_category")
    )
    inc.start(inc.landing_records(t.spark, landing, log.schema, 1), inc.health_handler(root, first), _folder(t, "ckpt"), None).awaitTermination()
    from storyloom.sources.tables import read_version

    return _ntz(read_version(t.spark, root, "health"), "last_successful_at", "last_failure_at")


@query("stream_refresh", SCORE_BASE, f"{SCORES} SELECT signal_id, heat_score, signal_score FROM scores")
def stream_refresh(t):
    """Stored scores after two batches: all articles, then changed trust of policy sources and links that crossref articles gained."""
    from storyloom.sources.keyed import KeyedTable

    landing, checkpoint = _folder(t, "changes"), _folder(t, "ckpt")
    store = KeyedTable(t.spark, f"scores_{uuid.uuid4().hex}", _folder(t, "scores"), inc.STORED_SCORES, ["signal_id"], parts=16, buckets=4)
    graded = quality.classify_articles(t.articles, t.sources, NOW)
    now = {"signals": t.signals_fx, "links": t.links_fx, "articles": graded, "sources": t.sources, "relations": t.relations_fx, "signal_topics": t.signal_topics_fx}
    policy = F.col("family") == "policy"
    late = t.articles.join(t.sources.filter("source_type = 'crossref'"), "source_id", "left_semi").select("article_id")
    gained = t.links_fx.filter("role = 'supporting'").join(late, "article_id", "left_semi")
    before = now | {
        "sources": t.sources.withColumn("trust_score", F.when(policy, F.lit(0.05)).otherwise(F.col("trust_score"))),
        "links": t.links_fx.join(gained, ["signal_id", "article_id"], "left_anti"),
    }
    ids = lambda kind, df, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("id"))
    first = ids("article", t.articles, "article_id")
    second = ids("source", t.sources.filter(policy), "source_id").unionByName(ids("article", gained, "article_id"))
    for tables, changes in ((before, first), (now, second)):
        changes.write.mode("append").parquet(landing)
        stream = inc.landing_records(t.spark, landing, changes.schema)
        inc.start(stream, inc.refresh_handler(tables.__getitem__, CLOCK, store), checkpoint, None).awaitTermination()
    return store.read().select("signal_id", "heat_score", "signal_score")


# --- whole runs: the documents as records of their sources ---------------------------------


def _inputs(t, days=None):
    a = t.articles
    if days is not None:
        a = a.filter(F.coalesce(F.dayofmonth("published_at"), F.lit(1)).between(*days))
    url = F.coalesce("canonical_url", F.concat(F.lit("https://fallback.example.com/"), "article_id"))
    iso = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    payload = F.to_json(F.struct("title", url.alias("url"), iso.alias("publishedAt"), F.col("text_for_ai").alias("summary"), F.struct(F.lit(1).alias("score")).alias("rawPayload")))
    at = F.lit(NOW).cast("timestamp")
    records = a.select(
        "source_id", F.col("article_id").alias("external_id"), "title", F.col("published_at").cast("timestamp").alias("published_at"), F.col("excerpt").alias("summary"),
        payload.alias("payload"), F.lit("{}").alias("response_meta"), at.alias("fetched_at"),
    )
    none = F.lit(None).cast("string")
    pages = a.select(
        url.alias("url"), url.alias("canonical_url"), "title", "language", "excerpt", F.col("published_at").cast("timestamp").alias("published_at"), none.alias("author"),
        F.col("text_for_ai").alias("page_text"),
    )
    return batch.Inputs(sources=t.sources, records=records, pages=pages, available_refs=t.sources.select(F.col("credential_ref").alias("ref")).filter("ref IS NOT NULL"))


@query("run_batch")
def run_batch(t):
    """Scored signals of a full manual run; the parts are checked one by one elsewhere."""
    out = batch.run_batch(t.spark, _folder(t, "run"), _inputs(t), batch.RunOptions.normalize(), CLOCK, "run1")
    return out["signals"].select("signal_id", "title", "heat_score", "signal_score", "enrichment_status")


@query(
    "run_options",
    (),
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 'startup' WHEN event_type = 'click' THEN 'scheduled' ELSE 'manual' END AS mode,
    CASE WHEN value > 40 THEN false WHEN event_id % 3 = 0 THEN event_type = 'click' ELSE event_id % 3 = 1 END AS incremental, value < 5 AS force, value > 40 AS recovery,
    CASE WHEN event_id % 5 IN (1, 2) THEN CASE WHEN value > 20 THEN value - 20 WHEN event_type = 'view' THEN 24.0 END WHEN event_type = 'view' THEN 24.0 END AS lookback_hours,
    CASE event_id % 4 WHEN 0 THEN event_id % 100 WHEN 1 THEN 7 END AS enrichment_limit FROM events""",
)
def run_options(t):
    """Options as the callers of the event table would give them, some of them odd."""
    n = F.col("event_id")
    rows = t.events.select(
        "event_id", F.when(F.col("event_type") == "view", "startup").when(F.col("event_type") == "click", "scheduled").when(F.col("event_type") == "error", "MANUAL").alias("mode"),
        F.when(n % 3 == 1, "true").when(n % 3 == 2, "no").alias("incremental"), F.when(F.col("value") < 5, "TRUE").otherwise("x").alias("force"),
        F.when(F.col("value") > 40, "true").alias("full_window"),
        F.when((n % 5).isin(1, 2), (F.col("value") - 20).cast("string")).when(n % 5 == 3, "soon").when(n % 5 == 4, "NaN").alias("lookback_hours"),
        F.when(n % 4 == 0, (n % 100).cast("string")).when(n % 4 == 1, "7.0").when(n % 4 == 2, "2.5").otherwise("-1").alias("enrichment_limit"),
    )
    return batch.normalized_options(rows)


RUNNING = "(SELECT source_id FROM sources WHERE enabled AND NOT (source_type IN ('rss', 'atom') AND feed_url IS NULL) AND NOT (source_type NOT IN ('rss', 'atom', 'hacker_news') AND api_endpoint IS NULL))"


@query(
    "run_report",
    ("articles", "sources"),
    f""" SELECT 'partial_live' AS state, (SELECT count(*) FROM sources WHERE source_id IN {RUNNING}) AS succeeded, (SELECT count(*) FROM sources WHERE source_id NOT IN {RUNNING}) AS skipped,
    (SELECT count(*) FROM articles WHERE source_id IN {RUNNING}) AS fetched""",
)
def run_report(t):
    out = batch.run_batch(t.spark, _folder(t, "run"), _inputs(t), batch.RunOptions.normalize(), CLOCK, "run1")
    n = lambda f: F.get_json_object("outcomes", f"$.{f}").cast("bigint").alias(f)
    return out["run_report"].select("state", n("succeeded"), n("skipped"), n("fetched"))


@query(
    "run_backfill",
    ("articles", "sources", "signals_fx", "links_fx"),
    f""", {STALE} SELECT signal_id, CASE WHEN chosen THEN 'fallback' ELSE enrichment_status END AS enrichment_status,
    CASE WHEN chosen AND enrichment_status <> 'pending' THEN CASE WHEN stale THEN 'stale_enrichment' WHEN enrichment_status = 'failed' THEN 'failed_enrichment_retry' ELSE 'fallback_enrichment_retry' END END AS backfill_reason,
    CASE WHEN chosen AND enrichment_status <> 'pending' THEN enrichment_status END AS previous_status
    FROM (SELECT *, stale OR enrichment_status IN ('pending', 'failed', 'fallback') AS chosen FROM scored)""",
)
def run_backfill(t):
    from storyloom.schemas import LINKS, SIGNALS
    from storyloom.sources.tables import read_version, write_version

    root = _folder(t, "run")
    write_version(batch.conform(_points(t.signals_fx), SIGNALS), root, "signals", "start")
    write_version(batch.conform(t.links_fx, LINKS), root, "signal_articles", "start")
    write_version(batch.conform(t.articles, batch.STORED_ARTICLES), root, "articles", "start")
    batch.run_backfill(t.spark, root, batch.Inputs(t.sources, None, None), "backfill", limit=None)
    return read_version(t.spark, root, "signals").select("signal_id", "enrichment_status", "backfill_reason", "previous_status")
