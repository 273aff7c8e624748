"""Score components and scores over the fixed three-article signals."""

from pyspark.sql import functions as F

from storyloom.operators import quality, scoring

from .registry import GRADED, NOW, query, r2, r3

BASE = ("articles", "sources", "signals_fx", "links_fx", "relations_fx", "signal_topics_fx")

MEMBERS = """members AS (
  SELECT l.signal_id, c.* FROM links_fx l JOIN classified c ON c.article_id = l.article_id
  WHERE c.visibility_status <> 'hidden_latest' AND c.quality_status <> 'low_quality'),
scoped AS (
  SELECT m.signal_id AS in_signal, r.* FROM relations_fx r JOIN members m ON m.article_id = r.article_id)"""

PARTS = f"""people AS (
  SELECT signal_id, max(published_at) AS newest, least(count(DISTINCT source_id) / 4.0, 1.0) AS source_count,
    least(count(DISTINCT family) / 4.0, 1.0) AS source_diversity, count(DISTINCT source_id) AS n_sources,
    avg(coalesce(nullif(trust_score, 0), 0.35)) AS source_trust,
    least(sum(coalesce(community_score, 0) + 2 * coalesce(community_comments, 0) + coalesce(community_votes, 0)) / 250.0, 1.0) AS community_activity,
    avg(CASE WHEN length(title) >= 18 THEN 0.25 ELSE 0.0 END + CASE WHEN length(excerpt) >= 20 THEN 0.2 ELSE 0.0 END
      + CASE WHEN length(text_for_ai) >= 80 THEN 0.4 WHEN length(text_for_ai) > 0 THEN 0.2 ELSE 0.0 END
      + CASE WHEN coalesce(canonical_url, '') <> '' THEN 0.15 ELSE 0.0 END) AS content_quality
  FROM members GROUP BY signal_id),
fresh AS (
  SELECT *, (epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(newest)) / 3600000.0 AS age FROM people),
edges AS (
  SELECT in_signal AS signal_id, count(*) FILTER (dup) AS n_dup, least(count(*) FILTER (dup) / 3.0, 1.0) AS duplicate_support,
    coalesce(avg(coalesce(nullif(confidence, 0), nullif(credibility_boost, 0), 0.7)) FILTER (dup), 0) AS duplicate_confidence,
    avg(coalesce(nullif(cluster_score, 0), 0.5)) FILTER (relation_type = 'signal_support') AS mean_support
  FROM (SELECT *, relation_type = 'duplicate_confirmed' AND coalesce(duplicate_support, false) AS dup FROM scoped) GROUP BY in_signal),
conf AS (SELECT signal_id, avg(coalesce(nullif(confidence, 0), 0.25)) AS topic_confidence FROM signal_topics_fx GROUP BY signal_id),
velocity AS (
  SELECT a.signal_id, least(count(DISTINCT b.signal_id) / 3.0, 1.0) AS topic_velocity
  FROM (SELECT s.signal_id, s.primary_published_at AS at, t.topic_slug FROM signals_fx s JOIN signal_topics_fx t ON t.signal_id = s.signal_id) a
  JOIN (SELECT s.signal_id, s.primary_published_at AS at, t.topic_slug FROM signals_fx s JOIN signal_topics_fx t ON t.signal_id = s.signal_id) b
    ON a.topic_slug = b.topic_slug AND a.signal_id <> b.signal_id AND abs(epoch_ms(a.at) - epoch_ms(b.at)) <= 72 * 3600000
  GROUP BY a.signal_id),
context AS (
  SELECT s.signal_id,
    CASE WHEN f.newest IS NULL THEN 0.15 WHEN age <= 6 THEN 1.0 WHEN age <= 24 THEN 0.9 WHEN age <= 72 THEN 0.65 WHEN age <= 168 THEN 0.4
      WHEN age <= 336 THEN 0.18 ELSE 0.05 END AS freshness,
    coalesce(f.source_count, 0) AS source_count, coalesce(f.source_diversity, 0) AS source_diversity,
    coalesce(e.duplicate_support, 0) AS duplicate_support, coalesce(f.community_activity, 0) AS community_activity,
    coalesce(f.source_trust, 0.35) AS source_trust, coalesce(v.topic_velocity, 0) AS topic_velocity,
    coalesce(c.topic_confidence, 0.25) AS topic_confidence,
    CASE WHEN f.n_sources IS NULL THEN 0.0 ELSE least(
      least(coalesce(e.mean_support, 0.45) * 0.55 + least(f.n_sources / 4.0, 1.0) * 0.35 + CASE WHEN coalesce(e.n_dup, 0) > 0 THEN 0.2 ELSE 0.0 END, 1.0),
      CASE WHEN f.n_sources <= 1 AND coalesce(e.n_dup, 0) = 0 THEN 0.58 ELSE 1.0 END) END AS evidence_strength,
    coalesce(f.content_quality, 0) AS content_quality, coalesce(e.duplicate_confidence, 0) AS duplicate_confidence
  FROM signals_fx s LEFT JOIN fresh f ON f.signal_id = s.signal_id LEFT JOIN edges e ON e.signal_id = s.signal_id
  LEFT JOIN conf c ON c.signal_id = s.signal_id LEFT JOIN velocity v ON v.signal_id = s.signal_id)"""

_WEIGHTS = [("heat", n, w) for n, w in scoring.HEAT_WEIGHTS.items()] + [("signal", n, w) for n, w in scoring.SIGNAL_WEIGHTS.items()]
COMPONENTS = "components AS (" + " UNION ALL ".join(
    f"SELECT signal_id, '{p}_{n}' AS component, {r3(f'least(1.0, greatest(0.0, {n}))')} AS value, {w} AS weight, "
    f"{r3(f'least(1.0, greatest(0.0, {n})) * {w}.0')} AS contribution FROM context"
    for p, n, w in _WEIGHTS
) + ")"
FULL = f", {GRADED}, {MEMBERS}, {PARTS}, {COMPONENTS}"
SCORES = f"""{FULL}, scores AS (SELECT signal_id,
  {r2(r3("sum(contribution) FILTER (component LIKE 'heat%')"))} AS heat_score,
  {r2(r3("sum(contribution) FILTER (component LIKE 'signal%')"))} AS signal_score FROM components GROUP BY signal_id)"""


def _context(t):
    graded = quality.classify_articles(t.articles, t.sources, NOW)
    return scoring.score_context(t.signals_fx, t.links_fx, graded, t.sources, t.relations_fx, t.signal_topics_fx, NOW)


@query("score_members", BASE, f", {GRADED}, {MEMBERS} SELECT signal_id, article_id, source_id FROM members")
def score_members(t):
    graded = quality.classify_articles(t.articles, t.sources, NOW)
    return scoring.score_members(t.links_fx, graded).select("signal_id", "article_id", "source_id")


@query(
    "scope_relations",
    BASE,
    f", {GRADED}, {MEMBERS} SELECT in_signal AS signal_id, relation_type, article_id, target_article_id FROM scoped",
)
def scope_relations(t):
    graded = quality.classify_articles(t.articles, t.sources, NOW)
    scoped = scoring.scope_relations(t.relations_fx, scoring.score_members(t.links_fx, graded))
    return scoped.select("signal_id", "relation_type", "article_id", "target_article_id")


@query(
    "member_scores",
    BASE,
    f""", {GRADED}, {MEMBERS}, {PARTS} SELECT c.signal_id, c.freshness::DOUBLE AS freshness, c.source_count, c.source_diversity,
    {r3('c.source_trust')} AS source_trust, c.community_activity, {r3('c.content_quality')} AS content_quality
    FROM context c JOIN people p ON p.signal_id = c.signal_id""",
)
def member_scores(t):
    graded = quality.classify_articles(t.articles, t.sources, NOW)
    m = scoring.member_scores(scoring.score_members(t.links_fx, graded), t.sources, NOW)
    return m.select(
        "signal_id", "freshness", "source_count", "source_diversity",
        scoring.round3(F.col("source_trust")).alias("source_trust"), "community_activity",
        scoring.round3(F.col("content_quality")).alias("content_quality"),
    )


@query(
    "relation_scores",
    BASE,
    f""", {GRADED}, {MEMBERS}, {PARTS} SELECT signal_id, n_dup, {r3('duplicate_support')} AS duplicate_support,
    {r3('duplicate_confidence')} AS duplicate_confidence, {r3('mean_support')} AS mean_support FROM edges""",
)
def relation_scores(t):
    graded = quality.classify_articles(t.articles, t.sources, NOW)
    e = scoring.relation_scores(scoring.scope_relations(t.relations_fx, scoring.score_members(t.links_fx, graded)))
    names = ["duplicate_support", "duplicate_confidence", "mean_support"]
    return e.select("signal_id", "n_dup", *[scoring.round3(F.col(n)).alias(n) for n in names])


@query(
    "topic_confidence",
    ("signal_topics_fx",),
    f"SELECT signal_id, {r3('avg(coalesce(nullif(confidence, 0), 0.25))')} AS topic_confidence FROM signal_topics_fx GROUP BY signal_id",
)
def topic_confidence(t):
    return scoring.topic_confidence(t.signal_topics_fx).select(
        "signal_id", scoring.round3(F.col("topic_confidence")).alias("topic_confidence")
    )


@query(
    "topic_velocity",
    BASE,
    f", {GRADED}, {MEMBERS}, {PARTS} SELECT signal_id, {r3('topic_velocity')} AS topic_velocity FROM context",
)
def topic_velocity(t):
    v = scoring.topic_velocity(t.signals_fx, t.signal_topics_fx)
    return v.select("signal_id", scoring.round3(F.col("topic_velocity")).alias("topic_velocity"))


@query("score_components", BASE, f"{FULL} SELECT signal_id, component, value, weight, contribution FROM components")
def score_components(t):
    return scoring.score_components(_context(t))


@query("score_signals", BASE, f"{SCORES} SELECT signal_id, heat_score, signal_score FROM scores")
def score_signals(t):
    return scoring.score_signals(scoring.score_components(_context(t)))


@query("score_summary", BASE, f"{SCORES} SELECT (SELECT count(*) FROM signals_fx) AS checked_signals, (SELECT count(*) FROM scores) AS scored_signals")
def score_summary(t):
    return scoring.score_summary(t.signals_fx, scoring.score_signals(scoring.score_components(_context(t))))


@query(
    "top_signals",
    BASE,
    f"""{SCORES} SELECT s.signal_id, s.title, s.primary_published_at, c.heat_score, c.signal_score
    FROM signals_fx s JOIN scores c ON c.signal_id = s.signal_id WHERE s.status NOT IN ('hidden', 'deleted')
    ORDER BY c.heat_score DESC, c.signal_score DESC, s.primary_published_at DESC NULLS LAST, s.signal_id LIMIT 20""",
)
def top_signals(t):
    from storyloom.operators import serving

    scores = scoring.score_signals(scoring.score_components(_context(t)))
    scored = scoring.apply_scores(t.signals_fx, scores)
    return serving.ranked_visible(scored).limit(20).select(
        "signal_id", "title", "primary_published_at", "heat_score", "signal_score"
    )
