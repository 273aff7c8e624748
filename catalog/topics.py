"""Topic rules and assignments."""

from pyspark.sql import functions as F

from storyloom.operators import topics

from .registry import query

BASE = ("articles", "sources", "signals_fx", "links_fx")


def _duck_terms() -> str:
    rows = []
    for n, (slug, conf, reason, gate, terms) in enumerate(topics.KEYWORD_RULES):
        for i, (term, _) in enumerate(terms):
            rows.append(f"({n}, {i}, '{slug}', {conf}::DOUBLE, {'NULL' if gate is None else repr(gate)}, '{term}')")
    return "(VALUES " + ", ".join(rows) + ") r(rule, pos, topic_slug, confidence, gate, term)"


# Terms are matched per text and united, as one text would be matched.
TEXTS = f"""texts AS (
  SELECT signal_id, lower(coalesce(title, '') || chr(10) || coalesce(summary, '')) AS txt FROM signals_fx
  UNION ALL
  SELECT l.signal_id, lower(coalesce(a.title, '') || chr(10) || coalesce(a.excerpt, '') || chr(10) || coalesce(a.text_for_ai, ''))
  FROM links_fx l JOIN articles a ON a.article_id = l.article_id),
terms AS (SELECT * FROM {_duck_terms()}),
found AS (
  SELECT DISTINCT signal_id, rule, pos, topic_slug, confidence, gate, term FROM texts JOIN terms
  ON regexp_matches(txt, '(^|[^0-9A-Za-z_])' || term || '([^0-9A-Za-z_]|$)')),
fams AS (
  SELECT l.signal_id, list(DISTINCT s.family) AS families, list(DISTINCT s.source_type) AS types
  FROM links_fx l JOIN articles a ON a.article_id = l.article_id JOIN sources s ON s.source_id = a.source_id GROUP BY l.signal_id),
keyword AS (
  SELECT f.signal_id, topic_slug, max(confidence) AS confidence, string_agg(term, ',' ORDER BY pos) AS terms, 'keyword' AS matched_by, 2 AS origin
  FROM found f JOIN fams g ON g.signal_id = f.signal_id WHERE gate IS NULL OR list_contains(families, gate) GROUP BY f.signal_id, rule, topic_slug),
family AS (
  SELECT signal_id, topic_slug, confidence, term AS terms, 'source_family' AS matched_by, 1 AS origin FROM fams JOIN (VALUES
    ('research', 0.88::DOUBLE, 'research'), ('company-announcements', 0.86::DOUBLE, 'company_announcement'), ('funding', 0.84::DOUBLE, 'funding'),
    ('policy', 0.84::DOUBLE, 'policy'), ('large-model-products', 0.74::DOUBLE, 'product_launch')) v(topic_slug, confidence, term)
  ON list_contains(families, term) OR (term = 'research' AND list_has_any(types, ['arxiv', 'semantic_scholar', 'crossref']))),
suggested AS (
  SELECT signal_id, topic_slug, least(1.0, greatest(0.0, coalesce(confidence, 0.72)))::DOUBLE AS confidence, '' AS terms, 'ai_topic_provider' AS matched_by, 0 AS origin
  FROM suggestions_fx WHERE topic_slug IN ({', '.join(repr(s) for s, _, _ in topics.TOPICS)})),
united AS (SELECT * FROM suggested UNION ALL SELECT * FROM family UNION ALL SELECT * FROM keyword),
best AS (SELECT * FROM united QUALIFY row_number() OVER (PARTITION BY signal_id, topic_slug ORDER BY confidence DESC, origin) = 1),
resolved AS (SELECT b.* FROM best b JOIN fams g ON g.signal_id = b.signal_id
  WHERE b.topic_slug <> 'company-announcements' OR list_contains(families, 'company_announcement')
  QUALIFY row_number() OVER (PARTITION BY b.signal_id ORDER BY confidence DESC, topic_slug) <= 4)"""
ALL = (*BASE, "suggestions_fx")


def _context(t):
    return topics.signal_context(t.signals_fx, t.links_fx, t.articles, t.sources)


def _flat(df):
    return df.select(
        "signal_id", "topic_slug", "confidence", "matched_by", F.array_join("matched_terms", ",").alias("terms")
    )


@query("signal_context", ALL, f", {TEXTS} SELECT signal_id, array_to_string(list_sort(families), ',') AS families, array_to_string(list_sort(types), ',') AS types FROM fams")
def signal_context(t):
    return _context(t).select(
        "signal_id", F.array_join("source_families", ",").alias("families"), F.array_join("source_types", ",").alias("types")
    )


@query("keyword_topics", ALL, f", {TEXTS} SELECT signal_id, topic_slug, confidence, matched_by, terms FROM keyword")
def keyword_topics(t):
    return _flat(topics.keyword_topics(_context(t)))


@query("family_topics", ALL, f", {TEXTS} SELECT signal_id, topic_slug, confidence, matched_by, terms FROM family")
def family_topics(t):
    return _flat(topics.family_topics(_context(t)))


@query("suggested_topics", ALL, f", {TEXTS} SELECT signal_id, topic_slug, confidence, matched_by, terms FROM suggested")
def suggested_topics(t):
    return _flat(topics.suggested_topics(t.suggestions_fx, topics.topics_dim(t.spark)))


@query("resolve_topics", ALL, f", {TEXTS} SELECT signal_id, topic_slug, confidence, matched_by, terms FROM resolved")
def resolve_topics(t):
    return _flat(topics.classify_signals(t.signals_fx, t.links_fx, t.articles, t.sources, t.suggestions_fx))


@query(
    "topic_summary",
    ALL,
    f", {TEXTS} SELECT (SELECT count(*) FROM signals_fx) AS checked_signals, count(DISTINCT signal_id) AS classified_signals, count(*) AS topic_assignments FROM resolved",
)
def topic_summary(t):
    rows = topics.classify_signals(t.signals_fx, t.links_fx, t.articles, t.sources, t.suggestions_fx)
    return topics.topic_summary(t.signals_fx, rows)


@query(
    "upsert_signal_topics",
    (*ALL, "signal_topics_fx"),
    f""", {TEXTS} SELECT coalesce(r.signal_id, o.signal_id) AS signal_id, coalesce(r.topic_slug, o.topic_slug) AS topic_slug,
    CASE WHEN r.signal_id IS NULL THEN o.method WHEN r.origin = 0 THEN 'ai' ELSE 'rule' END AS method, coalesce(r.confidence, o.confidence)::DOUBLE AS confidence
    FROM resolved r FULL JOIN signal_topics_fx o ON o.signal_id = r.signal_id AND o.topic_slug = r.topic_slug""",
)
def upsert_signal_topics(t):
    rows = topics.classify_signals(t.signals_fx, t.links_fx, t.articles, t.sources, t.suggestions_fx)
    return topics.upsert_signal_topics(t.signal_topics_fx, rows)


# The topic list, written out for the check.
TOPIC_NAMES = "['large-model-products', 'ai-agent', 'research', 'company-announcements', 'funding', 'policy', 'ai-video', 'edge-models']"


@query(
    "upsert_topics",
    ("signals_fx", "suggestions_fx"),
    f""", asked AS (SELECT topic_slug AS slug, count(*) AS n FROM suggestions_fx GROUP BY topic_slug),
    listed AS (SELECT unnest({TOPIC_NAMES}) AS slug)
    SELECT coalesce(l.slug, a.slug) AS slug, a.slug IS NOT NULL AS renamed, CASE WHEN a.slug IS NOT NULL THEN 'suggested ' || a.n || ' times' END AS given FROM listed l FULL JOIN asked a ON a.slug = l.slug""",
)
def upsert_topics(t):
    """The topic list after suggested topics were put into it: new ones join, known ones get the new name and text."""
    asked = t.suggestions_fx.groupBy("topic_slug").agg(F.count("*").alias("n"))
    text = F.concat(F.lit("suggested "), F.col("n").cast("string"), F.lit(" times"))
    changes = asked.select(F.col("topic_slug").alias("slug"), F.concat(F.lit("New "), "topic_slug").alias("name"), text.alias("description"))
    out = topics.upsert_topics(topics.topics_dim(t.spark), changes)
    renamed = F.col("name").startswith("New ")
    return out.select("slug", renamed.alias("renamed"), F.when(renamed, F.col("description")).alias("given"))
