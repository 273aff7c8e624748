"""Topic assignment from source families, keyword rules and outside suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp01, round3
from ..functions.text import ascii_word
from .lineage import cut
from .summaries import measure

# Controlled topics (slug, name, description).
TOPICS = [
    ("ai-agent", "AI Agent", "Agentic systems, tool use, autonomous workflows, and agent platforms."),
    ("large-model-products", "Large Model Products",
     "Model releases, LLM products, developer APIs, and productized foundation model capabilities."),
    ("ai-video", "AI Video", "Text-to-video, image-to-video, video editing, and multimodal video generation."),
    ("edge-models", "Edge Models",
     "On-device inference, edge AI deployment, NPUs, mobile models, and compact local models."),
    ("policy", "Policy", "Regulation, governance, safety policy, compliance, copyright, and public-sector AI rules."),
    ("research", "Research", "Papers, benchmarks, datasets, evaluations, and academic or lab research updates."),
    ("funding", "Funding", "Fundraises, investments, valuations, acquisitions, and startup financing."),
    ("company-announcements", "Company Announcements",
     "Official company news, release notes, launch posts, and corporate announcements."),
]

# Keyword rules (topic, confidence, reason, family gate, [(term, literal every match contains)]).
KEYWORD_RULES = [
    ("ai-agent", 0.82, "The signal mentions agents, tool use, or workflow automation.", None,
     [("agents?", "agent"), ("agentic", "agentic"), ("tool use", "tool use"),
      ("workflow automation", "workflow automation"), ("autonomous workflow", "autonomous workflow")]),
    ("large-model-products", 0.76,
     "The signal describes a model, LLM product, workspace, or developer API launch.", None,
     [("llm", "llm"), ("large language model", "large language model"), ("gpt", "gpt"), ("gemini", "gemini"),
      ("claude", "claude"), ("model workspace", "model workspace"), ("developer api", "developer api"),
      ("foundation model", "foundation model")]),
    ("ai-video", 0.82, "The signal mentions AI video generation or video editing capabilities.", None,
     [("video generation", "video generation"), ("text-to-video", "text-to-video"),
      ("image-to-video", "image-to-video"), ("veo", "veo"), ("sora", "sora"), ("runway", "runway"),
      ("pika", "pika"), ("video editing", "video editing")]),
    ("edge-models", 0.8, "The signal mentions edge deployment or on-device inference.", None,
     [("edge ai", "edge ai"), ("edge model", "edge model"), ("on-device", "on-device"),
      ("local inference", "local inference"), ("npu", "npu"), ("mobile deployment", "mobile deployment"),
      ("compact model", "compact model")]),
    ("policy", 0.8, "The signal mentions AI policy, regulation, safety governance, or compliance.", None,
     [("policy", "policy"), ("regulation", "regulation"), ("regulators?", "regulator"), ("ai act", "ai act"),
      ("governance", "governance"), ("compliance", "compliance"), ("safety reporting", "safety reporting"),
      ("copyright", "copyright")]),
    ("research", 0.78, "The signal mentions papers, benchmarks, datasets, or evaluations.", None,
     [("arxiv", "arxiv"), ("paper", "paper"), ("benchmark", "benchmark"), ("dataset", "dataset"),
      ("evaluation", "evaluation"), ("research", "research")]),
    ("funding", 0.82, "The signal mentions funding, investment rounds, or valuation.", None,
     [("funding", "funding"), ("raises?", "raise"), ("series [abc]", "series "), ("seed round", "seed round"),
      ("investors?", "investor"), ("valuation", "valuation")]),
    ("company-announcements", 0.76,
     "The signal uses announcement or release language associated with official updates.", "company_announcement",
     [("announces?", "announce"), ("introduces?", "introduce"), ("releases?", "release"), ("launched?", "launche"),
      ("release notes?", "release note")]),
]

# Family rules (topic, confidence, reason, matched term).
FAMILY_RULES = [
    ("research", 0.88, "The signal is backed by research source metadata.", "research"),
    ("company-announcements", 0.86, "The lead evidence includes an official company announcement source.",
     "company_announcement"),
    ("funding", 0.84, "The source family identifies this signal as funding-related.", "funding"),
    ("policy", 0.84, "The source family identifies this signal as policy-related.", "policy"),
    ("large-model-products", 0.74, "The source family indicates a product launch or model product update.",
     "product_launch"),
]
RESEARCH_TYPES = ["arxiv", "semantic_scholar", "crossref"]
SUGGESTED_CONFIDENCE = 0.72
SUGGESTED_REASON = "AI provider suggested this controlled topic."
MAX_TOPICS = 4
GATED = {"company-announcements": "company_announcement"}



def topics_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOPICS, "slug STRING, name STRING, description STRING")


def upsert_topics(topics: DataFrame, changes: DataFrame) -> DataFrame:
    from ..sources.tables import upsert

    return upsert(topics, changes, ["slug"], ["name", "description"])


def _term_mask(text: Column, terms: list[tuple[str, str]], start: int) -> Column:
    """Bit per matching term; the cheap literal test runs before the regex."""
    mask = F.lit(0).cast("long")
    for i, (term, literal) in enumerate(terms):
        hit = text.contains(literal) & text.rlike(ascii_word(term))
        mask = mask + F.when(hit, F.lit(1 << (start + i)).cast("long")).otherwise(F.lit(0).cast("long"))
    return mask


def _rule_offsets() -> list[tuple[int, tuple]]:
    out, start = [], 0
    for rule in KEYWORD_RULES:
        out.append((start, rule))
        start += len(rule[4])
    return out


def keyword_mask(*texts: str) -> Column:
    """All keyword terms found in any of the text columns, as bits of one long."""
    lowered = F.lower(F.concat_ws("\n", *[F.col(t) for t in texts]))
    total = F.lit(0).cast("long")
    for start, rule in _rule_offsets():
        total = total + _term_mask(lowered, rule[4], start)
    return total


def signal_context(signals: DataFrame, links: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Keyword bits, source families and source types per signal.

    No rule spans a line break, so terms are matched per article text and the
    bits are OR-ed; the texts of a signal are never gathered into one row.
    """
    text_bits = articles.select("article_id", "source_id", keyword_mask("title", "excerpt", "text_for_ai").alias("bits"))
    dims = sources.select("source_id", "family", "source_type")
    per_source = (
        links.select("signal_id", "article_id")
        .join(text_bits, "article_id")
        .groupBy("signal_id", "source_id")
        .agg(F.bit_or("bits").alias("bits"))
    )
    members = (
        per_source.join(dims, "source_id", "left")
        .groupBy("signal_id")
        .agg(
            F.bit_or("bits").alias("member_bits"),
            F.array_sort(F.collect_set(F.nullif("family", F.lit("")))).alias("source_families"),
            F.array_sort(F.collect_set(F.nullif("source_type", F.lit("")))).alias("source_types"),
        )
    )
    empty = F.array().cast("array<string>")
    return signals.select("signal_id", keyword_mask("title", "summary").alias("own_bits")).join(
        members, "signal_id", "left"
    ).select(
        "signal_id",
        F.col("own_bits").bitwiseOR(F.coalesce("member_bits", F.lit(0).cast("long"))).alias("bits"),
        F.coalesce("source_families", empty).alias("source_families"),
        F.coalesce("source_types", empty).alias("source_types"),
    )


def _candidates(context: DataFrame, parts: list[Column]) -> DataFrame:
    return context.select("signal_id", F.inline(F.array_compact(F.array(*parts))))


def _row(cond: Column, slug: str, confidence: float, reason: str, by: str, terms: Column) -> Column:
    return F.when(
        cond,
        F.struct(
            F.lit(slug).alias("topic_slug"), F.lit("rule").alias("method"), F.lit(confidence).alias("confidence"),
            F.lit(reason).alias("reason"), F.lit(by).alias("matched_by"), terms.alias("matched_terms"),
        ),
    )


def keyword_topics(context: DataFrame) -> DataFrame:
    """One candidate row per keyword rule with at least one matching term."""
    parts = []
    for start, (slug, confidence, reason, gate, terms) in _rule_offsets():
        width = (1 << len(terms)) - 1
        found = F.shiftright("bits", start).bitwiseAND(F.lit(width).cast("long"))
        names = F.array_compact(
            F.array(
                *[
                    F.when(F.col("bits").bitwiseAND(F.lit(1 << (start + i)).cast("long")) != 0, F.lit(term))
                    for i, (term, _) in enumerate(terms)
                ]
            )
        )
        allowed = F.array_contains("source_families", gate) if gate else F.lit(True)
        parts.append(_row((found != 0) & allowed, slug, confidence, reason, "keyword", names))
    return _candidates(context, parts)


def family_topics(context: DataFrame) -> DataFrame:
    parts = []
    for slug, confidence, reason, term in FAMILY_RULES:
        hit = F.array_contains("source_families", term)
        if slug == "research":
            hit = hit | F.arrays_overlap("source_types", F.array(*[F.lit(t) for t in RESEARCH_TYPES]))
        parts.append(_row(hit, slug, confidence, reason, "source_family", F.array(F.lit(term))))
    return _candidates(context, parts)


def suggested_topics(suggestions: DataFrame, topics: DataFrame) -> DataFrame:
    """Outside suggestions (signal_id, topic_slug[, confidence, reason]) on controlled topics."""
    columns = suggestions.columns
    confidence = F.col("confidence").cast("double") if "confidence" in columns else F.lit(None).cast("double")
    reason = F.nullif(F.col("reason"), F.lit("")) if "reason" in columns else F.lit(None).cast("string")
    known = topics.select(F.col("slug").alias("topic_slug"))
    return suggestions.join(F.broadcast(known), "topic_slug", "left_semi").select(  # topics: a fixed list of eight
        "signal_id", "topic_slug", F.lit("ai").alias("method"),
        clamp01(F.coalesce(F.nanvl(confidence, F.lit(0.0)), F.lit(SUGGESTED_CONFIDENCE))).alias("confidence"),
        F.coalesce(reason, F.lit(SUGGESTED_REASON)).alias("reason"),
        F.lit("ai_topic_provider").alias("matched_by"), F.array().cast("array<string>").alias("matched_terms"),
    )


def resolve_topics(
    context: DataFrame, families: DataFrame, keywords: DataFrame, suggested: DataFrame | None = None, k: int = MAX_TOPICS
) -> DataFrame:
    """Best candidate per topic, gated topics dropped, the ``k`` most confident kept.

    Equal confidence: suggestions before families before keywords, then the slug.
    """
    groups = ([] if suggested is None else [(0, suggested)]) + [(1, families), (2, keywords)]
    united = None
    for order, frame in groups:
        part = frame.withColumn("origin", F.lit(order))
        united = part if united is None else united.unionByName(part)
    best = Window.partitionBy("signal_id", "topic_slug").orderBy(F.desc("confidence"), "origin")
    top = Window.partitionBy("signal_id").orderBy(F.desc("confidence"), "topic_slug")
    rows = (
        united.withColumn("pick", F.row_number().over(best))
        .filter("pick = 1")
        .withColumn("confidence", round3(F.col("confidence")))
        .join(context.select("signal_id", "source_families", "source_types"), "signal_id")
    )
    for slug, family in GATED.items():
        rows = rows.filter((F.col("topic_slug") != slug) | F.array_contains("source_families", family))
    return rows.withColumn("place", F.row_number().over(top)).filter(F.col("place") <= k).drop("pick", "place", "origin")


def classify_signals(
    signals: DataFrame, links: DataFrame, articles: DataFrame, sources: DataFrame, suggestions: DataFrame | None = None
) -> DataFrame:
    """Topic rows of every signal."""
    context = cut(signal_context(signals, links, articles, sources))  # one small row per signal, texts read once
    suggested = None
    if suggestions is not None:
        suggested = suggested_topics(suggestions, topics_dim(signals.sparkSession))
    return resolve_topics(context, family_topics(context), keyword_topics(context), suggested)


def check_assignments(assignments: DataFrame) -> DataFrame:
    """Rows with the first rule they break in ``error`` (null when sound)."""
    blank = lambda name: F.coalesce(F.col(name), F.lit("")) == ""
    ok = F.col("confidence").between(0.0, 1.0)
    return assignments.withColumn(
        "error",
        F.when(blank("signal_id"), "missing_signal_id")
        .when(blank("topic_slug"), "missing_topic_slug")
        .when(blank("method"), "missing_method")
        .when(~F.coalesce(ok, F.lit(False)), "confidence_out_of_range")
        .when(blank("reason"), "missing_reason"),
    )


def upsert_signal_topics(existing: DataFrame, assignments: DataFrame) -> DataFrame:
    """Keyed upsert of the sound rows; rows not produced again stay."""
    from ..sources.tables import upsert

    sound = check_assignments(assignments).filter("error IS NULL").select(*existing.columns)
    rest = [c for c in existing.columns if c not in ("signal_id", "topic_slug")]
    return upsert(existing, sound, ["signal_id", "topic_slug"], rest)


def topic_summary(signals: DataFrame, assignments: DataFrame) -> DataFrame:
    return measure(
        checked_signals=(signals, F.count("*")),
        classified_signals=(assignments, F.count_distinct("signal_id")),
        topic_assignments=(assignments, F.count("*")),
    )
