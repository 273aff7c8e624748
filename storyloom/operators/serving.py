"""Ranked, archive, paging and search queries over scored signals."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round2
from ..functions.text import clean_text, strip_terminal
from ..functions.times import date_range, millis, order_key, within
from .search_index import TEXTS, SearchIndex, hit_columns
from .summaries import measure

HIDDEN = ["hidden", "deleted"]
HOT_HEAT = 70.0
PAGE_DEFAULT, PAGE_MAX = 20, 50

# Labels shown for families and data states.
FAMILY_LABELS = {
    "technology_media": "Technology Media",
    "research": "Research",
    "funding": "Funding",
    "policy": "Policy",
    "community": "Community",
    "product_launch": "Product Launch",
    "company_announcement": "Company Announcement",
}
STATE_LABELS = {
    "loading": "Loading live data",
    "empty_live": "Empty live data",
    "live": "Live data",
    "partial_live": "Partial live data",
    "stale_live": "Stale live data",
    "demo": "Demo data",
    "api_unavailable": "API unavailable",
    "unknown": "Unknown data state",
}
# Phrases that must not be shown.
UNAVAILABLE = "AI 精炼暂不可用"
INTERNAL = "(后端处理流程|后台已保留)"
INTERNAL_SENTENCES = ["。?这条资讯已经进入后端处理流程[^。]*。?", "。?后台已保留[^。]*。?"]
EMPTY_POINT = "提供了与该信号相关的基础来源信息|提供了该信号的基础来源信息"
FALLBACK_OPENING = " 已根据来源标题、摘要和发布时间完成基础整理"
FALLBACK_CLOSING = "。后续会结合模型精炼、官方更新或更多来源确认继续补充要点。"


def is_visible() -> Column:
    return ~F.coalesce(F.col("status"), F.lit("")).isin(*HIDDEN)


def visible(signals: DataFrame) -> DataFrame:
    return signals.filter(is_visible())


def _heat() -> Column:
    return F.coalesce("heat_score", F.lit(0.0))


def _score() -> Column:
    return F.coalesce("signal_score", F.lit(0.0))


def _published() -> Column:
    return F.coalesce(millis("primary_published_at"), F.lit(0).cast("long"))


def product_order() -> list[Column]:
    """Heat, then signal score, then newest, then id."""
    return [_heat().desc(), _score().desc(), _published().desc(), F.col("signal_id").asc()]


def _rank() -> Column:
    """``product_order`` as one value; the smallest comes first."""
    return F.struct(
        (-_heat()).alias("h"), (-_score()).alias("s"), (-_published()).alias("p"), F.col("signal_id").alias("i")
    )


def ranked_visible(signals: DataFrame) -> DataFrame:
    return visible(signals).orderBy(*product_order())


def label_of(family: Column) -> Column:
    out = family
    for name, label in FAMILY_LABELS.items():
        out = F.when(family == name, label).otherwise(out)
    return out


# --- context ------------------------------------------------------------------


def signal_sources(links: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per (signal, known source): first member's place and URL, article count, source facts."""
    place = articles.select("article_id", "source_id", "canonical_url", order_key().alias("place"))
    dims = sources.select("source_id", "name", "source_type", "family", "trust_score", "language", "attribution_required")
    return (
        links.select("signal_id", "article_id")
        .join(place, "article_id")
        .groupBy("signal_id", "source_id")
        .agg(
            F.min("place").alias("place"),
            F.min_by(F.struct("canonical_url"), "place").alias("first"),
            F.count("*").alias("n_articles"),
        )
        .select("signal_id", "source_id", "place", "n_articles", F.col("first.canonical_url").alias("original_url"))
        .join(dims, "source_id")
    )


def source_context(links: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Per signal: sources and families in first-seen order, main language.

    Arrays hold one entry per source, never one per article.
    """
    rows = signal_sources(links, articles, sources)
    entry = F.struct("place", "source_id", "name", "source_type", "family", "trust_score", "original_url", "language", "attribution_required")
    grouped = rows.groupBy("signal_id").agg(
        F.array_sort(F.collect_list(entry)).alias("seen"), F.sum("n_articles").alias("article_count")
    )
    languages = F.filter(F.transform("seen", lambda s: s["language"]), lambda x: x.isNotNull() & (x != ""))
    families = F.filter(F.transform("seen", lambda s: s["family"]), lambda x: x.isNotNull() & (x != ""))
    return grouped.select(
        "signal_id",
        F.size("seen").alias("source_count"),
        "article_count",
        F.array_distinct(families).alias("source_families"),
        F.transform(
            "seen",
            lambda s: F.struct(
                s["source_id"].alias("source_id"), s["name"].alias("name"), s["source_type"].alias("source_type"),
                s["family"].alias("family"), s["trust_score"].alias("trust_score"), s["original_url"].alias("original_url"),
            ),
        ).alias("sources"),
        F.coalesce(F.try_element_at(languages, F.lit(1)), F.lit("unknown")).alias("language"),
        F.exists("seen", lambda s: F.coalesce(s["attribution_required"], F.lit(True))).alias("attribution_required"),
    )


def with_context(signals: DataFrame, context: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return (
        signals.join(context, "signal_id", "left")
        .withColumn("source_count", F.coalesce("source_count", F.lit(0)))
        .withColumn("source_families", F.coalesce("source_families", empty))
        .withColumn("language", F.coalesce("language", F.lit("unknown")))
    )


def visible_topics(signal_topics: DataFrame, topics: DataFrame, context: DataFrame) -> DataFrame:
    """Topic rows that may be shown: company announcements only next to that family."""
    named = topics.select(F.col("slug").alias("topic_slug"), F.col("name").alias("topic_name"))
    joined = signal_topics.join(context.select("signal_id", "source_families"), "signal_id", "left")
    shown = (F.col("topic_slug") != "company-announcements") | F.coalesce(
        F.array_contains("source_families", "company_announcement"), F.lit(False)
    )
    return (
        joined.filter(shown)
        .join(named, "topic_slug", "left")
        .select("signal_id", "topic_slug", F.coalesce("topic_name", "topic_slug").alias("topic_name"), "confidence", "method")
    )


def display_brief(signals: DataFrame) -> DataFrame:
    """Signals with ``display_brief``: internal phrases replaced by key points and next-watch text."""
    brief = F.coalesce(clean_text(F.coalesce(F.nullif("ai_brief", F.lit("")), F.col("summary"))), F.lit(""))
    points = F.coalesce(F.transform("key_points", lambda p: strip_terminal(p["text"])), F.array().cast("array<string>"))
    said = F.filter(points, lambda p: p != "")
    two = F.array_join(F.slice(said, 1, 2), "；")
    watch = strip_terminal("next_watch")
    repaired = F.concat(
        F.when(two != "", F.concat(F.lit("要点显示："), two, F.lit("。"))).otherwise(""),
        F.when(watch != "", F.concat(F.lit("后续观察："), watch, F.lit("。"))).otherwise(""),
    )
    cut = brief
    for pattern in INTERNAL_SENTENCES:
        cut = F.regexp_replace(cut, pattern, "")
    telling = F.filter(said, lambda p: ~p.rlike(EMPTY_POINT))
    opening = F.coalesce(
        F.try_element_at(telling, F.lit(1)), F.concat(F.coalesce(clean_text("title"), F.lit("")), F.lit(FALLBACK_OPENING))
    )
    fallback = F.concat(strip_terminal(opening), F.lit(FALLBACK_CLOSING))
    return signals.withColumn(
        "display_brief",
        F.when(brief.contains(UNAVAILABLE), fallback)
        .when(~brief.rlike(INTERNAL), brief)
        .when(repaired != "", repaired)
        .otherwise(cut),
    )


def signal_summary(signals: DataFrame, context: DataFrame, shown_topics: DataFrame) -> DataFrame:
    """Summary documents.  Attribution links come as rows from ``attribution_links``."""
    topics = shown_topics.groupBy("signal_id").agg(
        F.array_sort(F.collect_list(F.struct("topic_slug", "topic_name", "confidence", "method"))).alias("topics")
    )
    base = with_context(display_brief(signals), context).join(topics, "signal_id", "left")
    return base.select(
        "signal_id",
        *(["slug"] if "slug" in signals.columns else []),
        "title",
        F.coalesce(F.nullif("display_brief", F.lit("")), F.col("summary")).alias("summary"),
        F.when(F.coalesce("ai_brief", F.lit("")) != "", F.col("display_brief")).otherwise(F.col("ai_brief")).alias("ai_brief"),
        _heat().alias("heat_score"),
        _score().alias("signal_score"),
        "status",
        "primary_published_at",
        "enrichment_status",
        "source_count",
        "source_families",
        "sources",
        "topics",
        F.transform("sources", lambda s: s["name"]).alias("source_names"),
    )


def attribution_links(signals: DataFrame, links: DataFrame, articles: DataFrame) -> DataFrame:
    """One row per linked article: the original links of a signal, whole even for a huge story."""
    facts = articles.select("article_id", "source_id", "title", F.col("canonical_url").alias("url"))
    return signals.select("signal_id").join(links, "signal_id").join(facts, "article_id").select(
        "signal_id", "article_id", "source_id", "title", "url", "role"
    )


# --- rankings -------------------------------------------------------------------


def diversity_tiers(signals: DataFrame, within_key: str | None = None) -> DataFrame:
    """``tier`` 0 for the best signal, 1 for the best of each language, 2 for the rest.

    Two small aggregates mark the chosen ids; nothing is numbered globally.
    """
    keys = [within_key] if within_key else []
    by_language = signals.groupBy(*keys, "language").agg(F.min(_rank()).alias("top"))
    best = by_language.groupBy(*keys).agg(F.min("top").alias("best")) if keys else by_language.agg(F.min("top").alias("best"))
    chosen = by_language.select(*keys, F.col("top.i").alias("signal_id"), F.lit(1).alias("chosen"))
    first = best.select(*keys, F.col("best.i").alias("signal_id"), F.lit(1).alias("first"))
    on = [*keys, "signal_id"]
    return (
        signals.join(chosen, on, "left")
        .join(first, on, "left")
        .withColumn("tier", F.when(F.col("first") == 1, 0).when(F.col("chosen") == 1, 1).otherwise(2))
        .drop("chosen", "first")
    )


def diversify(signals: DataFrame, limit: int | None = None) -> DataFrame:
    """Best signal, best of every language, then the rest in product order."""
    ordered = diversity_tiers(signals).orderBy("tier", *product_order())
    return ordered if limit is None else ordered.limit(limit)


def home(signals: DataFrame, context: DataFrame, limit: int = 8) -> DataFrame:
    """The front list; ``place`` 0 is the lead."""
    top = diversify(with_context(visible(signals), context), limit)
    place = F.row_number().over(Window.orderBy("tier", *product_order())) - 1  # at most ``limit`` rows
    return top.withColumn("place", place)


def data_window(signals: DataFrame, front: DataFrame, now: datetime) -> DataFrame:
    """Label (today/latest), date, whether the front list has today, first and last date."""
    today = now.strftime("%Y-%m-%d")
    day = F.date_format("primary_published_at", "yyyy-MM-dd")
    seen = measure(any_today=(visible(signals), F.count_if(day == today)))
    span = front.agg(
        F.coalesce(F.bool_or(day == today), F.lit(False)).alias("includes_today"),
        F.min("primary_published_at").alias("from_at"),
        F.max("primary_published_at").alias("to_at"),
    )
    return span.join(F.broadcast(seen), F.lit(True)).select(  # one row each
        F.when(F.col("any_today") > 0, "today").otherwise("latest").alias("label"),
        F.lit(today).alias("date"),
        "includes_today", "from_at", "to_at",
    )


def plain_number(c: Column) -> Column:
    """At most two decimals, no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", round2(c)), "0+$", ""), "\\.$", "")


def ticker(front: DataFrame, size: int = 6) -> DataFrame:
    text = F.concat(
        F.col("title"), F.lit(" · "), F.col("source_count").cast("string"), F.lit(" sources · heat "), plain_number(_heat())
    )
    return front.filter(F.col("place") < size).select("place", "signal_id", text.alias("text"), _heat().alias("heat_score"), "primary_published_at")


def stats(signals: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    seen = visible(signals)
    return measure(
        visible_signals=(seen, F.count("*")),
        enriched_signals=(seen, F.count_if(F.col("enrichment_status") == "completed")),
        articles_indexed=(articles, F.count("*")),
        source_count=(sources, F.count("*")),
        hot_signals=(seen, F.count_if(_heat() >= HOT_HEAT)),
    )


def family_summary(signals: DataFrame, context: DataFrame, sources: DataFrame) -> DataFrame:
    """Families of visible signals with label, signal count and source count."""
    counts = (
        with_context(visible(signals), context)
        .select(F.explode("source_families").alias("family"))
        .groupBy("family")
        .agg(F.count("*").alias("signal_count"))
    )
    per_family = sources.groupBy("family").agg(F.count("*").alias("source_count"))
    return (
        counts.join(per_family, "family", "left")
        .select("family", label_of(F.col("family")).alias("label"), "signal_count", F.coalesce("source_count", F.lit(0)).alias("source_count"))
        .orderBy(F.desc("signal_count"), "family")
    )


def date_summary(signals: DataFrame) -> DataFrame:
    return (
        visible(signals)
        .filter("primary_published_at IS NOT NULL")
        .groupBy(F.date_format("primary_published_at", "yyyy-MM-dd").alias("date"))
        .agg(F.count("*").alias("signal_count"))
        .orderBy(F.desc("date"))
    )


def list_sources(signals: DataFrame, links: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Every source with its signal and article counts."""
    per_source = (
        visible(signals).select("signal_id").join(links.select("signal_id", "article_id"), "signal_id")
        .join(articles.select("article_id", "source_id"), "article_id")
        .select("signal_id", "source_id").distinct()
        .groupBy("source_id").agg(F.count("*").alias("signal_count"))
    )
    article_counts = articles.groupBy("source_id").agg(F.count("*").alias("article_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return public_source(sources).join(per_source, "source_id", "left").join(article_counts, "source_id", "left").select(
        "source_id", "name", "family", "source_type", "enabled", "trust_score", zero("signal_count"), zero("article_count")
    )


def source_type_previews(signals: DataFrame, context: DataFrame, previews: int = 3) -> DataFrame:
    """Up to ``previews`` diversified signals per family; ``place`` counts from 1."""
    rows = with_context(visible(signals), context).withColumn("family", F.explode("source_families"))
    tiers = diversity_tiers(rows, "family")
    place = F.row_number().over(Window.partitionBy("family").orderBy("tier", *product_order()))
    return tiers.withColumn("place", place).filter(F.col("place") <= previews)


def source_types(signals: DataFrame, context: DataFrame, sources: DataFrame, previews: int = 3) -> DataFrame:
    """Family list with preview signal ids in order."""
    shown = (
        source_type_previews(signals, context, previews)
        .groupBy("family")
        .agg(F.array_sort(F.collect_list(F.struct("place", "signal_id"))).alias("p"))
        .select("family", F.transform("p", lambda x: x["signal_id"]).alias("preview_ids"))
    )
    return family_summary(signals, context, sources).join(shown, "family", "left").orderBy(F.desc("signal_count"), "family")


# --- archives and paging ----------------------------------------------------------


def page_bounds(cursor=None, limit=None) -> tuple[int, int]:
    """Offset and page size from loose input."""

    def whole(value, default):
        try:
            return int(str(value).strip())
        except ValueError:
            return default

    return max(0, whole(cursor, 0)), min(PAGE_MAX, max(1, whole(limit, PAGE_DEFAULT)))


def paginate(rows: DataFrame, order: Sequence[Column], cursor=None, limit=None) -> tuple[DataFrame, DataFrame]:
    """(page, page info).  The page is a top-k plan; the total is a count over the same rows."""
    offset, size = page_bounds(cursor, limit)
    page = rows.orderBy(*order).offset(offset).limit(size)
    total = F.count("*")
    after = F.least(F.lit(offset + size), F.greatest(total, F.lit(offset)))
    info = rows.agg(
        F.lit(size).alias("limit"),
        F.lit(str(offset)).alias("cursor"),
        F.when(after < total, after.cast("string")).alias("next_cursor"),
        (after < total).alias("has_more"),
        total.alias("total"),
    )
    return page, info


def page_after(rows: DataFrame, last: dict | None, limit=None) -> DataFrame:
    """Keyset page: the rows behind ``last`` (heat, score, published ms, id) in product order."""
    _, size = page_bounds(None, limit)
    if last:
        mark = F.struct(
            F.lit(-float(last["heat_score"])).alias("h"), F.lit(-float(last["signal_score"])).alias("s"),
            F.lit(-int(last["published_ms"])).cast("long").alias("p"), F.lit(last["signal_id"]).alias("i"),
        )
        rows = rows.filter(_rank() > mark)
    return rows.orderBy(*product_order()).limit(size)


def signals_of_sources(signals: DataFrame, links: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Visible signals with a member article of the given sources."""
    members = articles.join(sources.select("source_id"), "source_id", "left_semi").select("article_id")
    ids = links.join(members, "article_id", "left_semi").select("signal_id")
    return visible(signals).join(ids, "signal_id", "left_semi")


def signals_of_family(signals: DataFrame, context: DataFrame, family: str) -> DataFrame:
    return with_context(visible(signals), context).filter(F.array_contains("source_families", family))


def source_type_archive(signals: DataFrame, context: DataFrame, family: str, cursor=None, limit=None):
    rows = diversity_tiers(signals_of_family(signals, context, family))
    return paginate(rows, [F.col("tier"), *product_order()], cursor, limit)


def newest_articles(articles: DataFrame) -> DataFrame:
    return public_article(articles).orderBy(F.coalesce(millis("published_at"), F.lit(0)).desc(), "article_id")


def family_archive(signals, links, articles, sources, family: str, cursor=None, limit=None):
    """(signal page, page info, all articles of the family, its sources)."""
    own = sources.filter(F.col("family") == family)
    page, info = paginate(signals_of_sources(signals, links, articles, own), product_order(), cursor, limit)
    rows = newest_articles(articles.join(own.select("source_id"), "source_id", "left_semi"))
    return page, info, rows, public_source(own)


def source_archive(signals, links, articles, sources, family: str, source_id: str):
    """(source, ranked signals, its articles newest first); empty when the family does not match."""
    own = sources.filter((F.col("source_id") == source_id) & (F.col("family") == family))
    ranked = signals_of_sources(signals, links, articles, own).orderBy(*product_order())
    return public_source(own), ranked, newest_articles(articles.join(own.select("source_id"), "source_id", "left_semi"))


def date_archive(signals: DataFrame, now: datetime, label=None, start=None, end=None, cursor=None, limit=None):
    _, first, last = date_range(label, start, end, now)
    return paginate(visible(signals).filter(within("primary_published_at", first, last)), product_order(), cursor, limit)


def list_topics(signals: DataFrame, shown_topics: DataFrame, topics: DataFrame) -> DataFrame:
    """Every topic with the count and newest date of its visible signals."""
    counts = (
        shown_topics.select("signal_id", "topic_slug").distinct()
        .join(visible(signals).select("signal_id", "primary_published_at"), "signal_id")
        .groupBy("topic_slug")
        .agg(F.count("*").alias("signal_count"), F.max("primary_published_at").alias("latest_signal_at"))
    )
    return topics.join(counts, F.col("slug") == F.col("topic_slug"), "left").select(
        "slug", "name", "description", F.coalesce("signal_count", F.lit(0)).alias("signal_count"), "latest_signal_at"
    )


def topic_archive(signals: DataFrame, shown_topics: DataFrame, slug: str, cursor=None, limit=None):
    own = shown_topics.filter(F.col("topic_slug") == slug).select("signal_id")
    return paginate(visible(signals).join(own, "signal_id", "left_semi"), product_order(), cursor, limit)


# --- search -------------------------------------------------------------------------


def _hits(columns: Sequence[str], terms: Sequence[str]) -> Column:
    mask = F.lit(0).cast("long")
    for i, term in enumerate(terms):
        found = F.lit(False)
        for c in columns:
            found = found | F.coalesce(F.lower(c).contains(term), F.lit(False))
        mask = mask + F.when(found, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return mask


def search(
    signals: DataFrame,
    links: DataFrame,
    articles: DataFrame,
    context: DataFrame,
    shown_topics: DataFrame,
    q: str = "",
    topic: str | None = None,
    family: str | None = None,
    start: str | None = None,
    end: str | None = None,
    now: datetime | None = None,
    require_term_hit: bool = False,
    index: SearchIndex | None = None,
) -> DataFrame:
    """Visible signals by relevance: share of query terms found plus heat / 1000.

    By default a signal with heat passes without a term hit, only ranked low;
    ``require_term_hit`` drops it.  With an ``index`` of the articles' texts the
    member articles are found by postings; without one the texts of the filtered
    signals are matched and OR-ed as bits.
    """
    rows = with_context(visible(signals), context)
    if topic:
        rows = rows.join(shown_topics.filter(F.col("topic_slug") == topic).select("signal_id"), "signal_id", "left_semi")
    if family:
        rows = rows.filter(F.array_contains("source_families", family))
    if start or end:
        _, first, last = date_range(None, start, end, now or datetime(1970, 1, 1))
        rows = rows.filter(within("primary_published_at", first, last))
    terms = q.lower().split()
    newest = [_published().desc(), F.col("signal_id").asc()]
    if not terms:
        return rows.withColumn("relevance", _heat() / 100.0).orderBy(F.desc("relevance"), *newest)
    hits, distinct = None, sorted(set(terms))
    for at in range(0, len(distinct), 60):  # bits of a long
        hits = [*(hits or []), distinct[at : at + 60]]
    names = [f"m{i}" for i in range(len(hits))]
    ids = links.join(rows.select("signal_id"), "signal_id", "left_semi")
    if index is not None:
        members = hit_columns(index, ids, hits, names)
    else:
        asked = articles.join(ids.select("article_id").distinct(), "article_id", "left_semi")  # texts of the filtered signals only
        matched = asked.select("article_id", *[_hits(list(TEXTS), part).alias(n) for n, part in zip(names, hits)])
        members = ids.join(matched, "article_id").groupBy("signal_id").agg(*[F.bit_or(n).alias(f"members_{n}") for n in names])
    found = rows.join(members, "signal_id", "left")
    total = F.lit(0)
    for n, part in zip(names, hits):
        mask = _hits(["title", "summary", "ai_brief", "next_watch"], part).bitwiseOR(
            F.coalesce(f"members_{n}", F.lit(0).cast("long"))
        )
        for i, term in enumerate(part):
            total = total + F.when(mask.bitwiseAND(F.lit(1 << i).cast("long")) != 0, terms.count(term)).otherwise(0)
    share = total / float(len(terms))
    out = found.withColumn("share", share).withColumn("relevance", F.col("share") + _heat() / 1000.0).drop(*[f"members_{n}" for n in names])
    out = out.filter(F.col("share") > 0) if require_term_hit else out.filter(F.col("relevance") > 0)
    return out.orderBy(F.desc("relevance"), *newest)


# --- detail ---------------------------------------------------------------------------


def detail_points(signals: DataFrame, links: DataFrame, articles: DataFrame, sources: DataFrame, column: str = "key_points") -> DataFrame:
    """(signal_id, position, item fields, sources): source ids of each item resolved to member sources."""
    own = signal_sources(links, articles, sources).select("signal_id", "source_id", "name", "source_type", "family", "trust_score")
    items = signals.select("signal_id", F.posexplode(column).alias("position", "item"))
    ids = items.select("signal_id", "position", F.posexplode("item.source_ids").alias("n", "source_id"))
    refs = (
        ids.join(own, ["signal_id", "source_id"])
        .groupBy("signal_id", "position")
        .agg(F.array_sort(F.collect_list(F.struct("n", "source_id", "name", "source_type", "family", "trust_score"))).alias("sources"))
    )
    return items.join(refs, ["signal_id", "position"], "left").select("signal_id", "position", "item.*", "sources").drop("source_ids")


def detail_mix(signals: DataFrame, links: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Source mix entries with name and original URL filled in."""
    own = signal_sources(links, articles, sources).select("signal_id", "source_id", "name", "original_url")
    items = signals.select("signal_id", F.posexplode("source_mix").alias("position", "m"))
    return items.select("signal_id", "position", "m.*").join(own, ["signal_id", "source_id"], "left").select(
        "signal_id", "position", "source_id", F.coalesce(F.nullif("source_name", F.lit("")), F.col("name")).alias("source_name"),
        F.coalesce(F.nullif("role", F.lit("")), F.lit("supporting")).alias("role"), "original_url",
    )


def related_signals(signals: DataFrame, wanted: DataFrame) -> DataFrame:
    """(signal_id, position, related id, title) of visible related signals of ``wanted``."""
    ids = wanted.select("signal_id", F.posexplode("related_signal_ids").alias("position", "related_id"))
    seen = visible(signals).select(F.col("signal_id").alias("related_id"), F.col("title").alias("related_title"))
    return ids.join(seen, "related_id").select("signal_id", "position", "related_id", "related_title")


def signal_detail(signals, links, articles, sources, signal_topics, topics, components, signal_id: str) -> dict[str, DataFrame]:
    """The parts of one signal's page; all empty when it is hidden or unknown."""
    one = visible(signals).filter(F.col("signal_id") == signal_id)
    own_links = links.filter(F.col("signal_id") == signal_id)
    own_articles = articles.join(own_links.select("article_id"), "article_id", "left_semi")
    context = source_context(own_links, own_articles, sources)
    shown = visible_topics(signal_topics.filter(F.col("signal_id") == signal_id), topics, context)
    return {
        "summary": signal_summary(one, context, shown),
        "key_points": detail_points(one, own_links, own_articles, sources, "key_points"),
        "timeline": detail_points(one, own_links, own_articles, sources, "timeline"),
        "source_mix": detail_mix(one, own_links, own_articles, sources),
        "related": related_signals(signals, one),
        "components": components.filter(F.col("signal_id") == signal_id),
        "articles": public_article(own_articles.join(own_links.select("article_id", "role"), "article_id")),
        "attribution": attribution_links(one, own_links, own_articles),
        "topics": shown,
    }


# --- data state and public columns -------------------------------------------------------


def data_state(status: DataFrame) -> DataFrame:
    """``data_state`` and label of status rows (mode, state, stale, counts, dates, visible_count)."""
    has = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    dated = F.col("last_live_fetch_at").isNotNull() | F.col("completed_at").isNotNull()
    none = F.coalesce("visible_count", F.lit(0)) == 0
    live = (
        F.when(F.coalesce("stale", F.lit(False)), "stale_live")
        .when(none & (dated | has("succeeded") | has("failed") | has("skipped")), "empty_live")
        .when(none, "loading")
        .when(has("succeeded") & (has("failed") | has("skipped")), "partial_live")
        .when(has("succeeded") | dated, "live")
        .otherwise("loading")
    )
    state = (
        F.when(F.col("state").isin(*STATE_LABELS), F.col("state"))
        .when(F.col("mode").isin("demo", "fixture"), "demo")
        .when(F.col("mode") == "live", live)
        .when(F.col("mode") == "api_unavailable", "api_unavailable")
        .otherwise("unknown")
    )
    out = status.withColumn("data_state", state)
    label = F.col("data_state")
    for name, text in STATE_LABELS.items():
        label = F.when(F.col("data_state") == name, text).otherwise(label)
    return out.withColumn("label", label).withColumn("is_empty", none)


def public_source(sources: DataFrame) -> DataFrame:
    return sources.select("source_id", "name", "source_type", "family", "enabled", "trust_score", "language")


def public_article(articles: DataFrame) -> DataFrame:
    names = ["article_id", "source_id", "title", "excerpt", "author", "language", "published_at"]
    extra = ["role"] if "role" in articles.columns else []
    return articles.select(
        *names, F.col("canonical_url").alias("original_url"), *extra,
        F.coalesce("full_text_display_allowed", F.lit(False)).alias("full_text_display_allowed"),
    )
