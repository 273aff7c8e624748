"""Registered queries and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators.lineage import cut
from storyloom.plans import derive
from storyloom.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = derive.NOW


class Tables:
    """Derived and base tables of one scale factor, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in derive.BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _LANDED:
            landed = {d: getattr(self, d) for d in derive.TABLES[name][0] if d not in derive.BASE}
            if name == "articles":  # the document file may be one split; the texts move once, to where their pages go
                parts = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
                landed["documents"] = self.documents.repartition(parts, F.expr("CAST(floor(doc_id / 5.0) AS BIGINT)"))
            _LANDED[key] = cut(derive.table(self.spark, self.sf_dir, name, landed))
        return _LANDED[key]


# Derived input tables written once per session, as a pipeline would find them.
_LANDED: dict[tuple[str, str, str], DataFrame] = {}


def query(name: str, tables: tuple[str, ...] = (), sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` continues the WITH list of ``tables``."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(configure(spark), sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            head = derive.with_sql(*tables).replace("WITH ", "WITH RECURSIVE ", 1) if tables else ""
            ORACLE[name] = f"{head} {sql}"
        return fn

    return wrap


def r3(expr: str) -> str:
    return f"(floor(({expr}) * 1000.0 + 0.5) / 1000.0)"


def r2(expr: str) -> str:
    return f"(floor(({expr}) * 100.0 + 0.5) / 100.0)"


# Stop words.
_STOP = "['a','an','and','are','as','at','for','from','in','into','new','of','on','the','to','with']"


def words(expr: str) -> str:
    """Title words in DuckDB."""
    return (
        f"list_filter(string_split(regexp_replace(lower(coalesce({expr}, '')), '[^a-z0-9一-鿿]+', ' ', 'g'), ' '), "
        f"lambda w: w <> '' AND NOT list_contains({_STOP}, w))"
    )


def hours(a: str, b: str) -> str:
    return f"(abs(epoch_ms({a}) - epoch_ms({b})) / 3600000.0)"


def clean(expr: str) -> str:
    return f"nullif(trim(regexp_replace({expr}, '[\\s\\x0b\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+', ' ', 'g')), '')"


# Quality reasons, freshness hours by family.
GRADED = f"""
graded AS (
  SELECT a.*, s.family, s.trust_score, s.source_type,
    list_filter([CASE WHEN length(trim(coalesce(a.title, ''))) < 6 THEN 'missing_title' END,
      CASE WHEN coalesce(a.canonical_url, '') = '' THEN 'missing_url' END,
      CASE WHEN a.published_at IS NULL THEN 'missing_published_at' END,
      CASE WHEN length(trim(coalesce(a.excerpt, ''))) < 20 AND length(trim(coalesce(a.text_for_ai, ''))) < 80 THEN 'missing_content' END,
      CASE WHEN a.language NOT IN ('en', 'zh', 'zh-CN', '') THEN 'unsupported_language' END], lambda x: x IS NOT NULL) AS low_reasons,
    coalesce(CASE WHEN s.freshness_window_hours > 0 THEN s.freshness_window_hours END,
      CASE s.family WHEN 'technology_media' THEN 168 WHEN 'company_announcement' THEN 336 WHEN 'research' THEN 720 WHEN 'funding' THEN 720
        WHEN 'policy' THEN 720 WHEN 'community' THEN 72 WHEN 'product_launch' THEN 336 END, 168)::DOUBLE AS window_hours,
    coalesce(greatest(0, (epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(a.published_at)) / 3600000.0)
      > coalesce(CASE WHEN s.freshness_window_hours > 0 THEN s.freshness_window_hours END,
      CASE s.family WHEN 'technology_media' THEN 168 WHEN 'company_announcement' THEN 336 WHEN 'research' THEN 720 WHEN 'funding' THEN 720
        WHEN 'policy' THEN 720 WHEN 'community' THEN 72 WHEN 'product_launch' THEN 336 END, 168), false) AS is_stale
  FROM articles a LEFT JOIN sources s ON s.source_id = a.source_id),
classified AS (
  SELECT *, CASE WHEN len(low_reasons) > 0 THEN 'low_quality' ELSE 'approved' END AS quality_status,
    CASE WHEN len(low_reasons) > 0 OR is_stale THEN 'hidden_latest' ELSE 'visible_latest' END AS visibility_status,
    CASE WHEN is_stale THEN list_append(low_reasons, 'stale_for_latest') ELSE low_reasons END AS quality_reasons
  FROM graded)"""
