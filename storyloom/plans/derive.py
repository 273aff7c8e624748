"""Articles, sources, signals and their relations derived from the driver tables.

Every table is one SQL text that both Spark and DuckDB run, so a query and its
check start from the same rows.  ``NOW`` is the pinned clock.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

NOW = "2024-01-31 00:00:00"

_SPARK = {"sha": "sha2(", "sha_end": ", 256)", "g": "", "ts": "TIMESTAMP_NTZ", "arr": "array"}
_DUCK = {"sha": "sha256(", "sha_end": ")", "g": ", 'g'", "ts": "TIMESTAMP", "arr": "list_value"}

BASE = ("documents", "pages", "labels", "events")

# name -> (tables it reads, SQL)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "sources": (
        ("documents",),
        """
SELECT source_id, concat('Source ', CAST(n AS STRING)) AS name,
  CASE n % 8 WHEN 0 THEN 'rss' WHEN 1 THEN 'atom' WHEN 2 THEN 'arxiv' WHEN 3 THEN 'newsapi'
    WHEN 4 THEN 'semantic_scholar' WHEN 5 THEN 'hacker_news' WHEN 6 THEN 'product_hunt' ELSE 'crossref' END AS source_type,
  CASE n % 7 WHEN 0 THEN 'technology_media' WHEN 1 THEN 'company_announcement' WHEN 2 THEN 'research'
    WHEN 3 THEN 'funding' WHEN 4 THEN 'policy' WHEN 5 THEN 'community' ELSE 'product_launch' END AS family,
  CASE WHEN n = 8 THEN NULL ELSE concat('https://feed.example.com/', source_id) END AS feed_url,
  CASE WHEN n = 10 THEN NULL ELSE concat('https://api.example.com/', source_id) END AS api_endpoint,
  CASE WHEN n % 4 = 0 THEN 'zh-CN' ELSE 'en' END AS language,
  CASE WHEN n % 5 = 0 THEN {arr}('data', 'The', 'ouque') ELSE CAST(NULL AS {strings}) END AS filter_keywords,
  CAST(30 + (n * 15) % 120 AS INT) AS fetch_interval_minutes,
  CASE WHEN n % 10 = 9 THEN CAST(100 AS DOUBLE) ELSE CAST(NULL AS DOUBLE) END AS freshness_window_hours,
  CAST(40 + (n * 37) % 60 AS DOUBLE) / 100 AS trust_score,
  CASE WHEN n % 8 IN (3, 6) THEN concat('KEY_', CAST(n AS STRING)) ELSE NULL END AS credential_ref,
  n % 3 = 0 AS allow_full_text, true AS allow_summary, n % 2 = 0 AS commercial_use_needs_review,
  n % 6 <> 5 AS attribution_required, n % 9 <> 8 AS enabled,
  CASE WHEN n % 6 = 1 THEN NULL ELSE {ts} '2024-01-30 21:00:00' + INTERVAL '1' HOUR * (n % 7) END AS next_fetch_at
FROM (SELECT DISTINCT source AS source_id, CAST(substr(source, 4) AS INT) AS n FROM documents)""",
    ),
    "articles": (
        ("documents", "pages", "sources"),
        """
SELECT concat('art_', lpad(CAST(d.doc_id AS STRING), 9, '0')) AS article_id,
  concat('raw_', lpad(CAST(d.doc_id AS STRING), 9, '0')) AS raw_item_id,
  d.source AS source_id,
  CASE WHEN d.doc_id % 26 = 4 THEN concat(CASE WHEN d.doc_id % 3 = 0 THEN 'https://Shared.example.com/p/' ELSE 'https://shared.example.com/p/' END,
      CAST(d.doc_id % 260 AS STRING), CASE d.doc_id % 4 WHEN 0 THEN '?utm_source=x' WHEN 2 THEN '/' ELSE '#top' END)
    WHEN d.doc_id % 5 = 0 AND p.url IS NOT NULL THEN p.url WHEN d.doc_id % 11 = 7 THEN NULL
    ELSE concat('https://', d.source, '.example.com/a/', CAST(d.doc_id AS STRING)) END AS canonical_url,
  trim(regexp_extract(d.text, '^[^.,|\\n]+', 0)) AS title,
  CASE WHEN d.lang = 'es' THEN 'zh' ELSE d.lang END AS language,
  substr(d.text, 1, 160) AS excerpt,
  CASE WHEN d.doc_id % 4 = 1 THEN NULL ELSE concat('Author ', CAST(d.doc_id % 37 AS STRING)) END AS author,
  d.text AS text_for_ai,
  {sha}trim(regexp_replace(d.text, '[ \\t\\r\\n]+', ' '{g})){sha_end} AS content_hash,
  CASE WHEN d.doc_id % 17 = 3 THEN NULL
    ELSE {ts} '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST((d.doc_id * 7919) % 43200 AS INT) END AS published_at,
  {ts} '2024-01-31 00:00:00' AS created_at,
  CAST(s.allow_full_text AS BOOLEAN) AS full_text_display_allowed,
  CASE WHEN s.family IN ('community', 'product_launch') THEN d.doc_id % 180 END AS community_score,
  CASE WHEN s.family IN ('community', 'product_launch') THEN d.doc_id % 64 END AS community_comments,
  CASE WHEN s.family IN ('community', 'product_launch') THEN d.doc_id % 7 END AS community_votes,
  'candidate' AS dedupe_status
FROM documents d LEFT JOIN pages p ON p.page_id = CAST(floor(d.doc_id / 5.0) AS BIGINT)
LEFT JOIN sources s ON s.source_id = d.source""",
    ),
    "links_ranked": (
        ("articles", "sources"),
        """
SELECT concat('sig_', lpad(CAST(number AS STRING), 9, '0')) AS signal_id, number, article_id, source_id, title, published_at,
  row_number() OVER (PARTITION BY number ORDER BY trust_score DESC, official DESC, has_text DESC, order_at, article_id) AS lead_rank
FROM (
  SELECT CAST(floor(CAST(substr(a.article_id, 5) AS BIGINT) / 3.0) AS BIGINT) AS number, a.article_id, a.source_id, a.title,
    a.published_at, coalesce(s.trust_score, 0) AS trust_score,
    CASE WHEN s.family = 'company_announcement' THEN 1 ELSE 0 END AS official,
    CASE WHEN a.text_for_ai <> '' THEN 1 ELSE 0 END AS has_text,
    coalesce(a.published_at, a.created_at) AS order_at
  FROM articles a LEFT JOIN sources s ON s.source_id = a.source_id)""",
    ),
    "signals_fx": (
        ("links_ranked",),
        """
SELECT signal_id, number, title, CASE WHEN number % 4 = 1 THEN NULL ELSE concat('Summary of ', title, CASE number % 7 WHEN 0 THEN ' with Agents, tool use and a new GPT'
    WHEN 2 THEN ' (benchmark paper on text-to-video, raised by investors)' WHEN 3 THEN ' announces release notes; series B funding'
    WHEN 5 THEN ' regulators copyright on-device NPU' ELSE '' END) END AS summary,
  CASE WHEN number % 13 = 5 THEN 'hidden' WHEN number % 29 = 7 THEN 'deleted' ELSE 'candidate' END AS status,
  CAST((number * 37) % 10000 AS DOUBLE) / 100 AS heat_score,
  CAST((number * 53) % 9000 AS DOUBLE) / 100 AS signal_score,
  published_at AS primary_published_at,
  CASE number % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'completed' WHEN 2 THEN 'fallback' WHEN 3 THEN 'failed' ELSE 'processing' END AS enrichment_status,
  CASE number % 9 WHEN 0 THEN NULL WHEN 1 THEN '这条资讯已经进入后端处理流程，等待补充。后台已保留原文。'
    WHEN 2 THEN 'AI 精炼暂不可用' WHEN 3 THEN '提供了与该信号相关的基础来源信息' ELSE concat('brief ', title) END AS ai_brief,
  CASE WHEN number % 3 = 0 THEN concat('watch item ', CAST(number % 50 AS STRING), '。') END AS next_watch,
  CAST(CASE WHEN number % 6 = 2 THEN 1 ELSE 2 END AS INT) AS enrichment_version,
  number % 4 = 3 AS fallback_generated,
  CASE WHEN number % 8 = 3 THEN 'enrichment_validation_failed' END AS error_category,
  {ts} '2024-01-30 00:00:00' AS created_at, {ts} '2024-01-30 12:00:00' AS updated_at
FROM links_ranked WHERE lead_rank = 1""",
    ),
    "links_fx": (
        ("links_ranked",),
        """
SELECT signal_id, article_id, CASE WHEN lead_rank = 1 THEN 'lead' ELSE 'supporting' END AS role FROM links_ranked""",
    ),
    "relations_fx": (
        ("links_ranked", "articles"),
        """
SELECT 'signal_support' AS relation_type, source_id, article_id, signal_id, CAST(NULL AS STRING) AS target_article_id,
  CAST(NULL AS DOUBLE) AS confidence,
  CASE WHEN lead_rank = 1 THEN CAST(1 AS DOUBLE) ELSE 0.5 + CAST(CAST(substr(article_id, 5) AS BIGINT) % 50 AS DOUBLE) / 100 END AS cluster_score,
  CAST(NULL AS BOOLEAN) AS duplicate_support, CAST(NULL AS DOUBLE) AS credibility_boost
FROM links_ranked
UNION ALL
SELECT 'duplicate_confirmed', a.source_id, a.article_id, NULL, f.article_id, CAST(0.98 AS DOUBLE), NULL, true, CAST(0.118 AS DOUBLE)
FROM articles a JOIN (SELECT content_hash, min(article_id) AS article_id FROM articles GROUP BY content_hash) g ON g.content_hash = a.content_hash
JOIN articles f ON f.article_id = g.article_id
WHERE a.article_id <> f.article_id AND a.source_id <> f.source_id
UNION ALL
SELECT 'duplicate_candidate', source_id, article_id, NULL, 'art_000000000', CAST(0.6 AS DOUBLE), NULL, false, CAST(0 AS DOUBLE)
FROM articles WHERE CAST(substr(article_id, 5) AS BIGINT) % 29 = 1""",
    ),
    "signal_topics_fx": (
        ("links_ranked",),
        """
SELECT signal_id, CASE (slot) % 8 WHEN 0 THEN 'ai-agent' WHEN 1 THEN 'large-model-products' WHEN 2 THEN 'ai-video' WHEN 3 THEN 'edge-models'
    WHEN 4 THEN 'policy' WHEN 5 THEN 'research' WHEN 6 THEN 'funding' ELSE 'company-announcements' END AS topic_slug,
  'rule' AS method, confidence
FROM (
  SELECT signal_id, CAST(substr(article_id, 5) AS BIGINT) AS slot, 0.5 + CAST(CAST(substr(article_id, 5) AS BIGINT) % 40 AS DOUBLE) / 100 AS confidence
  FROM links_ranked WHERE lead_rank = 1 AND number % 7 <> 6
  UNION ALL
  SELECT signal_id, CAST(substr(article_id, 5) AS BIGINT) + 3, CAST(0.55 AS DOUBLE) FROM links_ranked WHERE lead_rank = 1 AND number % 2 = 0)""",
    ),
    "records_fx": (
        ("events",),
        """
SELECT concat('src', CAST(user_id % 20 AS STRING)) AS source_id, concat('item', CAST(event_id % 4000 AS STRING)) AS external_id,
  concat('Record ', event_type, ' ', CAST(event_id % 4000 AS STRING)) AS title,
  concat('https://records.example.com/', CAST(event_id % 4000 AS STRING)) AS url,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE ts END AS published_at, ts + INTERVAL '1' HOUR AS fetched_at,
  concat(CASE WHEN event_id % 3 = 1 THEN 'note on ' ELSE 'data of ' END, event_type, ' with value ', CAST(CAST(floor(value) AS BIGINT) AS STRING)) AS summary,
  props AS payload, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('meta', CAST(event_id AS STRING)) END AS response_meta, event_id
FROM events""",
    ),
    "fetch_log_fx": (
        ("events",),
        """
SELECT event_id, concat('src', CAST(user_id % 20 AS STRING)) AS source_id, ts AS attempted_at, CAST(event_id % 3 AS INT) AS attempts,
  CAST(CASE event_type WHEN 'signup' THEN 429 WHEN 'purchase' THEN 503 WHEN 'error' THEN 403 ELSE 200 END AS INT) AS http_status,
  CAST(CASE WHEN event_id % 10 = 7 THEN 90 END AS INT) AS retry_after_seconds
FROM events""",
    ),
    "cursors_fx": (
        ("events",),
        """
SELECT source_id, max(published_at) AS last_seen_published_at, max(fetched_at) AS last_successful_fetch_at
FROM (SELECT concat('src', CAST(user_id % 20 AS STRING)) AS source_id, CASE WHEN event_id % 23 = 0 THEN NULL ELSE ts END AS published_at,
  ts + INTERVAL '1' HOUR AS fetched_at FROM events WHERE ts < {ts} '2024-01-15 00:00:00' AND user_id % 20 <> 4) GROUP BY source_id""",
    ),
    "seen_fx": (
        ("events",),
        """
SELECT DISTINCT concat('src', CAST(user_id % 20 AS STRING)) AS source_id, concat('item', CAST(event_id % 4000 AS STRING)) AS external_id
FROM events WHERE ts < {ts} '2024-01-15 00:00:00' AND user_id % 20 <> 4""",
    ),
    "verdicts_fx": (
        ("labels",),
        """
SELECT concat('art_', lpad(CAST(doc_id AS STRING), 9, '0')) AS article_id, quality = 1 AS relevant FROM labels""",
    ),
    "suggestions_fx": (
        ("links_ranked",),
        """
SELECT signal_id, CASE number % 3 WHEN 0 THEN 'ai-agent' WHEN 1 THEN 'not-a-topic' ELSE 'policy' END AS topic_slug,
  CASE number % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(1.5 AS DOUBLE) ELSE CAST(0.66 AS DOUBLE) END AS confidence
FROM links_ranked WHERE lead_rank = 1 AND number % 2 = 1""",
    ),
}


def _closure(name: str, landed: tuple[str, ...] = ()) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in BASE or n in landed or n in order:
            return
        for dep in TABLES[n][0]:
            visit(dep)
        order.append(n)

    visit(name)
    return order


def table(spark: SparkSession, sf_dir: str, name: str, landed: dict[str, DataFrame] | None = None) -> DataFrame:
    """A derived table over the parquet files of ``sf_dir``.

    Tables of ``landed`` are read as they were written instead of being derived
    again, texts and all, wherever ``name`` refers to them.
    """
    landed = landed or {}
    need = [n for n in _closure(name, tuple(landed)) if n not in landed]
    base = sorted({d for n in need for d in TABLES[n][0] if d in BASE and d not in landed})
    ctes = [f"{b} AS (SELECT * FROM parquet.`{sf_dir}/{b}.parquet`)" for b in base]
    for dep, rows in landed.items():
        view = f"landed_{dep}_{uuid.uuid4().hex}"
        rows.createTempView(view)
        ctes.append(f"{dep} AS (SELECT * FROM {view})")
    ctes += [f"{n} AS ({TABLES[n][1].format(strings='ARRAY<STRING>', **_SPARK)})" for n in need]
    return spark.sql(f"WITH {', '.join(ctes)} SELECT * FROM {name}")


def with_sql(*names: str) -> str:
    """The same tables as a DuckDB ``WITH`` list (no trailing comma)."""
    need: list[str] = []
    for n in names:
        need += [d for d in _closure(n) if d not in need]
    return "WITH " + ", ".join(
        f"{n} AS ({TABLES[n][1].format(strings='VARCHAR[]', **_DUCK).replace('AS STRING', 'AS VARCHAR')})" for n in need
    )
