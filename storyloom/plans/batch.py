"""The whole batch run and the enrichment backfill, over versioned tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import ts_lit
from ..operators import cluster, dedupe, enrich, ingest, normalize, quality, scoring, topics
from ..operators.lineage import cut
from ..schemas import (
    CURSORS, HEALTH, LINKS, RAW_ITEMS, RELATION_KEY, RELATIONS, SCHEDULE, SCORE_COMPONENTS, SEEN_IDS, SIGNAL_TOPICS, SIGNALS, STORED_ARTICLES,
)
from ..sources.tables import read_version, upsert, write_version

STARTUP_LOOKBACK_HOURS = 24.0
MODES = ("startup", "scheduled", "manual")


@dataclass(frozen=True)
class RunOptions:
    """Normalized options of one run."""

    mode: str = "manual"
    incremental: bool = False
    force: bool = False
    recovery: bool = False
    lookback_hours: float | None = None
    enrichment_limit: int | None = None

    @staticmethod
    def normalize(**raw) -> RunOptions:
        """Loose input (any type, missing keys) as options; recovery switches incremental off."""
        mode = raw.get("mode") if raw.get("mode") in MODES else "manual"
        recovery = bool(raw.get("recovery") or raw.get("full_window"))
        given = raw.get("incremental")
        incremental = mode == "scheduled" if given is None else bool(given)
        return RunOptions(
            mode=mode,
            incremental=incremental and not recovery,
            force=bool(raw.get("force")),
            recovery=recovery,
            lookback_hours=_positive(raw.get("lookback_hours"), STARTUP_LOOKBACK_HOURS if mode == "startup" else None),
            enrichment_limit=_count(raw.get("enrichment_limit")),
        )


def _positive(value, default):
    try:
        number = float(value)
    except (TypeError, ValueError):
        return default
    return number if 0 < number < float("inf") else default


def normalized_options(rows: DataFrame) -> DataFrame:
    """The same for rows of text columns (mode, incremental, force, recovery, full_window, lookback_hours, enrichment_limit), as asked for by many callers.

    Columns that are missing count as not given.  Flags are 'true' or not; numbers
    that don't parse, or lie out of range, fall back to the mode's default.
    """
    given = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("string")
    flag = lambda name: F.coalesce(F.lower(given(name)) == "true", F.lit(False))
    number = lambda name: F.expr(f"try_cast(`{name}` AS DOUBLE)") if name in rows.columns else F.lit(None).cast("double")
    mode = F.when(given("mode").isin(*MODES), given("mode")).otherwise("manual")
    recovery = flag("recovery") | flag("full_window")
    wanted = F.when(given("incremental").isNull(), mode == "scheduled").otherwise(flag("incremental"))
    hours, limit = number("lookback_hours"), number("enrichment_limit")
    default = F.when(mode == "startup", F.lit(STARTUP_LOOKBACK_HOURS))
    settled = {
        "mode": mode, "incremental": wanted & ~recovery, "force": flag("force"), "recovery": recovery,
        "lookback_hours": F.when((hours > 0) & (hours < float("inf")), hours).otherwise(default),
        "enrichment_limit": F.when((limit >= 0) & (limit < 2**53) & (limit == F.floor(limit)), limit.cast("long")),
    }
    return rows.select(*[c for c in rows.columns if c not in (*settled, "full_window")], *[v.alias(k) for k, v in settled.items()])


def _count(value):
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return int(number) if number >= 0 and number.is_integer() else None


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in order; missing ones null."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def run_report(run_id: str, options: RunOptions, now, outcomes: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """One row: run facts, outcome counts, skip reasons, and each stage's one-row summary as JSON."""
    counts = ingest.outcome_counts(outcomes)
    sections = {"outcomes": counts, **parts}
    rows = [df.select(F.lit(name).alias("k"), F.to_json(F.struct("*")).alias("v")) for name, df in sections.items()]
    reasons = ingest.skipped_reasons(outcomes).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("reason", "n")))).alias("v")  # a handful of reasons
    )
    rows.append(reasons.select(F.lit("skipped_reasons").alias("k"), F.coalesce("v", F.lit("{}")).alias("v")))
    united = reduce(DataFrame.unionByName, rows)
    body = united.agg(*[F.max(F.when(F.col("k") == name, F.col("v"))).alias(name) for name in [*sections, "skipped_reasons"]])
    got = lambda field: F.coalesce(F.get_json_object("outcomes", f"$.{field}").cast("bigint"), F.lit(0))
    state = (
        F.when((got("succeeded") > 0) & ((got("failed") > 0) | (got("skipped") > 0)), "partial_live")
        .when(got("succeeded") > 0, "live")
        .when(got("failed") > 0, "failed")
        .otherwise("empty")
    )
    return body.select(
        F.lit(run_id).alias("run_id"), F.lit("live").alias("mode"), F.lit(options.mode).alias("run_mode"),
        F.lit(options.incremental).alias("incremental"), F.lit(options.force).alias("force"), F.lit(options.recovery).alias("recovery"),
        ts_lit(now).alias("completed_at"), F.when(got("succeeded") > 0, ts_lit(now)).alias("last_live_fetch_at"), state.alias("state"), "*",
    )


@dataclass
class Inputs:
    """What one run reads besides the stored tables."""

    sources: DataFrame
    records: DataFrame
    pages: DataFrame
    available_refs: DataFrame | None = None
    # (source_id, reason) of fetches that failed; http_status, attempts and retry_after where they are known
    failed_sources: DataFrame | None = None
    verdicts: DataFrame | None = None
    suggestions: DataFrame | None = None
    outputs: DataFrame | None = None  # (signal_id, content) from a model


def run_batch(spark: SparkSession, root: str, inputs: Inputs, options: RunOptions, now: datetime, run_id: str) -> dict[str, DataFrame]:
    """Records to scored, enriched signals.  Returns the written tables by name.

    Every stage ends in a new table version, so a lost executor or a failed run
    leaves the last complete versions in place.
    """
    read = lambda name, schema: read_version(spark, root, name, schema)
    write = lambda name, df: write_version(df, root, name, run_id)
    out: dict[str, DataFrame] = {}

    # Which sources run, and what of their records is new.  The last run's schedule goes before the source list's.
    planned = read("schedule", SCHEDULE).select("source_id", F.col("next_fetch_at").alias("_planned"))
    known_sources = inputs.sources.join(planned, "source_id", "left").withColumn("next_fetch_at", F.coalesce("_planned", "next_fetch_at")).drop("_planned")
    refs = inputs.available_refs if inputs.available_refs is not None else spark.createDataFrame([], "ref STRING")
    readiness = ingest.mark_not_due(
        ingest.source_readiness(known_sources, refs), known_sources, options.mode, options.force, now
    )
    failed = inputs.failed_sources if inputs.failed_sources is not None else spark.createDataFrame([], "source_id STRING, reason STRING")
    cursors, seen = read("cursors", CURSORS), read("seen_ids", SEEN_IDS)
    running = readiness.filter("status = 'ready'").join(failed.select("source_id"), "source_id", "left_anti").select("source_id")
    received = inputs.records.join(running, "source_id", "left_semi")
    marked = cut(
        ingest.filter_records(received, cursors, seen, now, options.mode, options.incremental, options.force, options.lookback_hours)
    )
    kept = marked.filter("skip_reason IS NULL").drop("skip_reason")

    raw_before = read("raw_items", RAW_ITEMS)
    created, duplicates = ingest.split_new(raw_before, kept)
    created = cut(created)
    per_source = created.groupBy("source_id").agg(F.count("*").alias("created"))
    known = duplicates.groupBy("source_id").agg(F.count("*").alias("duplicates"))
    stats = ingest.filter_stats(marked).select("source_id", F.col("input").alias("received"), F.col("kept").alias("fetched"))
    out["raw_items"] = write("raw_items", conform(ingest.upsert_raw_items(raw_before, kept), RAW_ITEMS))
    out["cursors"] = write("cursors", conform(ingest.advance_cursors(cursors, kept, now, running), CURSORS))
    out["seen_ids"] = write("seen_ids", ingest.advance_seen(seen, kept))

    _record_fetches(read, write, out, known_sources, readiness, running, failed, now)

    # New raw items become articles; every stored article is judged again.
    fresh = out["raw_items"].join(created, ingest.RECORD_KEY, "left_semi")
    candidates, errors = normalize.normalize(fresh, inputs.sources, inputs.pages)
    stored = read("articles", STORED_ARTICLES)
    added = cut(normalize.article_candidates(candidates, stored))
    everything = conform(stored, STORED_ARTICLES).unionByName(conform(added, STORED_ARTICLES))
    judged = cut(conform(quality.classify_articles(everything, inputs.sources, now, inputs.verdicts), STORED_ARTICLES))

    # Duplicates and stories share one title-similarity table.
    pairs = cut(dedupe.title_pairs(judged))
    assigned = cut(dedupe.assign_duplicates(judged, pairs))
    old_relations = read("relations", RELATIONS)
    stale = cut(dedupe.stale_relations(old_relations, judged))
    found = dedupe.duplicate_relations(assigned, judged, now)
    relation_rest = [f.name for f in RELATIONS.fields if f.name not in RELATION_KEY]
    sound = old_relations.join(stale.select("relation_type", "article_id", "target_article_id"), ["relation_type", "article_id", "target_article_id"], "left_anti")
    relations = cut(upsert(conform(sound, RELATIONS), conform(found, RELATIONS), RELATION_KEY, relation_rest))
    out["articles"] = write("articles", conform(dedupe.dedupe_status(judged, assigned), STORED_ARTICLES))
    articles = out["articles"]

    members = cut(cluster.assign_clusters(articles, relations, pairs))
    leads = cut(cluster.choose_lead(members, articles, inputs.sources))
    old_signals, old_links = read("signals", SIGNALS), read("signal_articles", LINKS)
    matched = cut(cluster.match_signals(members, leads, articles, old_signals, old_links))
    out["signal_articles"] = write("signal_articles", conform(cluster.replace_members(old_links, members, matched), LINKS))
    links = out["signal_articles"]
    current = cut(cluster.story_links(members, matched))
    support = cluster.support_edges(current, articles, relations, now)
    pruned = cluster.prune_support(relations, links)
    out["relations"] = write("relations", upsert(conform(pruned, RELATIONS), conform(support, RELATIONS), RELATION_KEY, relation_rest))
    kept_signals = cluster.touch_signals(conform(old_signals, SIGNALS), matched, now)
    signals = kept_signals.unionByName(conform(cluster.new_signals(matched, now), SIGNALS))

    # Topics and scores.
    assigned_topics = cut(topics.classify_signals(signals, links, articles, inputs.sources, inputs.suggestions))
    out["signal_topics"] = write("signal_topics", topics.upsert_signal_topics(read("signal_topics", SIGNAL_TOPICS), assigned_topics))
    context = scoring.score_context(signals, links, articles, inputs.sources, out["relations"], out["signal_topics"], now)
    out["score_components"] = write("score_components", conform(scoring.score_components(context), SCORE_COMPONENTS))
    scores = scoring.score_signals(out["score_components"])
    scored = cut(conform(scoring.apply_scores(signals, scores), SIGNALS))

    # Enrichment of signals touched by this run (all pending ones in recovery).
    touched = None if options.recovery else ingest.signals_for_articles(links, added)
    waiting = enrich.pending_enrichment(scored, retry=inputs.outputs is not None, ids=touched)
    if options.enrichment_limit is not None:
        waiting = waiting.orderBy("signal_id").limit(options.enrichment_limit)
    waiting = cut(waiting)
    out["signals"] = write("signals", conform(_enriched(scored, waiting, links, articles, inputs, now), SIGNALS))

    outcomes = (
        readiness.join(failed.withColumnRenamed("reason", "f_reason"), "source_id", "left")
        .join(stats, "source_id", "left").join(per_source, "source_id", "left").join(known, "source_id", "left")
        .select(
            "source_id",
            F.when((F.col("status") == "ready") & F.col("f_reason").isNotNull(), "failed").when(F.col("status") == "ready", "succeeded").otherwise(F.col("status")).alias("status"),
            F.coalesce("f_reason", "reason").alias("reason"),
            *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("fetched", "received", "created", "duplicates")],
            F.lit(0).cast("bigint").alias("processed"),
        )
    )
    results = added.select("source_id", F.lit("completed").alias("status"))
    outcomes = ingest.processed_counts(outcomes, results)
    out["run_outcomes"] = write("run_outcomes", outcomes)
    out["process_errors"] = write("process_errors", errors)
    report = run_report(
        run_id, options, now, out["run_outcomes"],
        {
            "quality": quality.quality_summary(articles),
            "dedupe": dedupe.dedupe_summary(assigned, stale),
            "cluster": cluster.cluster_summary(articles, matched, current),
            "topics": topics.topic_summary(signals, assigned_topics),
            "scoring": scoring.score_summary(signals, scores),
            "enrichment": out["signals"].agg(
                *[F.count_if(F.col("enrichment_status") == s).alias(s) for s in ("pending", "completed", "fallback", "failed")]
            ),
        },
    )
    out["run_report"] = write("run_report", report)
    return out


def _record_fetches(read, write, out, sources, readiness, running, failed, now) -> None:
    """Health and next fetch of every source that was asked in this run."""
    log = failed
    for name, kind in (("http_status", "int"), ("attempts", "int"), ("retry_after", "timestamp")):
        if name not in log.columns:
            log = log.withColumn(name, F.lit(None).cast(kind))
    asked = readiness.filter("status = 'ready'").select("source_id")
    log = log.join(asked, "source_id", "left_semi").select("source_id", "http_status", F.coalesce("attempts", F.lit(0)).alias("attempts"), "retry_after")
    went_well = running.select("source_id", F.lit(200).alias("http_status"), F.lit(0).alias("attempts"), F.lit(None).cast("timestamp").alias("retry_after"))
    results = cut(ingest.classify_outcomes(log.unionByName(went_well)))
    before = read("health", HEALTH)
    fresh = sources.select("source_id").join(before.select("source_id"), "source_id", "left_anti")
    rows = before.unionByName(conform(fresh, HEALTH))
    ok = F.col("category") == "success"
    outcomes = results.select("source_id", ts_lit(now).alias("at"), F.lit(0).alias("seq"), ok.alias("ok"), F.when(~ok, F.col("category")).alias("error_category"))
    out["health"] = write("health", conform(ingest.update_health(rows, outcomes), HEALTH))
    out["schedule"] = write("schedule", conform(ingest.next_fetch(sources, results, now), SCHEDULE))


def _enriched(signals: DataFrame, waiting: DataFrame, links: DataFrame, articles: DataFrame, inputs: Inputs, now: datetime) -> DataFrame:
    context = enrich.enrichment_context(waiting, links, articles, inputs.sources)
    counts = enrich.member_counts(context)
    fallback = cut(enrich.fallback_outputs(waiting, context, enrich.extract_terms_claims(waiting, links, articles)))
    if inputs.outputs is None:
        return enrich.apply_enrichment(signals, enrich.enrichment_results(waiting, fallback, None, None), None, now, counts)
    repaired = enrich.repair_outputs(enrich.parse_outputs(inputs.outputs), fallback, waiting)
    checked = enrich.validate_outputs(repaired, fallback)
    return enrich.apply_enrichment(signals, enrich.enrichment_results(waiting, fallback, checked, "table"), "table", now, counts)


def run_backfill(
    spark: SparkSession, root: str, inputs: Inputs, run_id: str, limit: int | None = 25, dry_run: bool = False,
    stale_only: bool = False, statuses: list[str] | None = None, published_after=None, now: datetime | None = None,
) -> DataFrame:
    """Select stale signals, set them to pending and make their text again; a dry run only returns the candidates."""
    signals = read_version(spark, root, "signals", SIGNALS)
    candidates = cut(enrich.backfill_candidates(signals, limit, stale_only, statuses, published_after))
    if dry_run:
        return candidates
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    marked = conform(enrich.mark_backfill(signals, candidates, now=now), SIGNALS)
    links, articles = read_version(spark, root, "signal_articles", LINKS), read_version(spark, root, "articles", STORED_ARTICLES)
    waiting = cut(marked.join(candidates.select("signal_id"), "signal_id", "left_semi"))
    write_version(conform(_enriched(marked, waiting, links, articles, inputs, now), SIGNALS), root, "signals", run_id)
    return candidates
