"""Duplicate detection and story clustering."""

from pyspark.sql import functions as F

from storyloom.operators import cluster, components, dedupe, quality, simjoin
from storyloom.operators.lineage import cut

from .registry import GRADED, NOW, hours, query, r3, words

BASE = ("articles",)
FULL = ("articles", "sources")

NORM = """regexp_replace(CASE WHEN regexp_matches(canonical_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')
  THEN lower(regexp_extract(canonical_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)) ||
    CASE WHEN regexp_extract(canonical_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) = '' THEN '/'
      ELSE regexp_extract(canonical_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) END
  ELSE trim(canonical_url) END, '/$', '')"""


def _star(key: str, name: str) -> str:
    return f""", rows_ AS (SELECT article_id, source_id, {key} AS k, coalesce(published_at, created_at) AS pub FROM articles WHERE coalesce({key}, '') <> ''),
    ranked AS (SELECT *, count(*) OVER (PARTITION BY k) AS group_size, row_number() OVER (PARTITION BY k ORDER BY pub, article_id) AS rn FROM rows_),
    grp AS (SELECT k, count(DISTINCT source_id) AS n_sources FROM rows_ GROUP BY k),
    other AS (SELECT a.article_id, arg_min(b.article_id, b.rn) AS first_other FROM ranked a JOIN ranked b
      ON a.k = b.k AND b.rn < a.rn AND a.source_id <> b.source_id GROUP BY a.article_id),
    heads AS (SELECT k, article_id FROM ranked WHERE rn = 1)
    SELECT r.article_id, r.k AS {name}, r.group_size, g.n_sources,
      CASE WHEN r.rn > 1 THEN h.article_id END AS first_article_id, o.first_other AS first_other_article_id
    FROM ranked r JOIN grp g ON g.k = r.k JOIN heads h ON h.k = r.k LEFT JOIN other o ON o.article_id = r.article_id WHERE r.group_size > 1"""


@query("url_pairs", BASE, _star(NORM, "normalized_url"))
def url_pairs(t):
    return dedupe.url_pairs(t.articles)


@query("hash_pairs", BASE, _star("content_hash", "hash"))
def hash_pairs(t):
    return dedupe.hash_pairs(t.articles)


TITLES = f"""titles AS (SELECT DISTINCT {words('title')} AS w FROM articles WHERE len({words('title')}) > 0),
  sims AS (SELECT array_to_string(a.w, ' ') AS first_key, array_to_string(b.w, ' ') AS second_key,
    2.0::DOUBLE * len(list_filter(a.w, lambda x: list_contains(b.w, x))) / (len(a.w) + len(b.w)) AS sim
  FROM titles a JOIN titles b ON a.w <> b.w)"""


def _sim_sql(limit: float) -> str:
    return f", {TITLES} SELECT first_key, second_key, {r3('sim')} AS similarity FROM sims WHERE sim >= {limit}::DOUBLE"


def _sim(t, limit):
    return simjoin.title_similarity_join(t.articles, limit).withColumn("similarity", dedupe.round3(F.col("similarity")))


@query("title_similarity_possible", BASE, _sim_sql(0.5))
def title_similarity_possible(t):
    return _sim(t, 0.5)


@query("title_similarity_related", BASE, _sim_sql(0.62))
def title_similarity_related(t):
    return _sim(t, 0.62)


@query("title_similarity_confirmed", BASE, _sim_sql(0.82))
def title_similarity_confirmed(t):
    return _sim(t, 0.82)


# All article pairs, for checks at small scale only.
PAIRS = f"""side AS (SELECT article_id, source_id, {NORM} AS url, nullif(content_hash, '') AS hash, {words('title')} AS w, published_at AS at,
    row_number() OVER (ORDER BY coalesce(published_at, created_at), article_id) AS rn FROM articles),
  raw AS (SELECT a.article_id AS first_id, b.article_id AS second_id, a.rn AS first_rn, b.rn AS second_rn, b.source_id, a.source_id <> b.source_id AS diverse,
    coalesce(a.url = b.url AND a.url <> '', false) AS same_url, coalesce(a.hash = b.hash, false) AS same_hash,
    coalesce(regexp_matches(a.url, '^[^:/?#]+://[^/]+/+[^/]'), false) AS specific,
    CASE WHEN len(a.w) > 0 AND len(b.w) > 0 THEN 2.0::DOUBLE * len(list_filter(a.w, lambda x: list_contains(b.w, x))) / (len(a.w) + len(b.w)) ELSE 0.0::DOUBLE END AS sim,
    {hours('a.at', 'b.at')} AS gap FROM side a JOIN side b ON a.rn < b.rn),
  marked AS (SELECT *, gap IS NULL OR gap <= 72 AS inside, (same_hash AND (diverse OR (same_url AND specific))) OR (same_url AND diverse)
      OR (same_url AND NOT diverse AND sim >= 0.82 AND specific) AS trusted FROM raw),
  evid AS (SELECT *, {r3("CASE WHEN trusted THEN 0.98 ELSE sim * CASE WHEN inside THEN 1.0 ELSE 0.65 END END")}::DOUBLE AS confidence, {r3('sim')} AS title_similarity FROM marked),
  decided AS (SELECT *, CASE WHEN same_hash THEN diverse OR (same_url AND specific)
      WHEN same_url THEN diverse OR (title_similarity >= 0.82 AND specific) ELSE diverse AND confidence >= 0.82 END AS confirmed FROM evid)"""

# The sequential pass: one step per article, carrying the list of leads.
GREEDY = """, near AS (SELECT second_rn AS rn, list(first_rn) AS before FROM decided WHERE confirmed GROUP BY second_rn),
  steps AS (SELECT rn, before, row_number() OVER (ORDER BY rn) AS step FROM near),
  dups(step, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
    SELECT s.step, CASE WHEN len(list_filter(s.before, lambda x: NOT list_contains(d.gone, x))) > 0 THEN list_append(d.gone, s.rn) ELSE d.gone END
    FROM dups d JOIN steps s ON s.step = d.step + 1),
  gone AS (SELECT unnest(gone) AS rn FROM (SELECT gone FROM dups ORDER BY step DESC LIMIT 1)),
  claims AS (SELECT second_rn AS rn, min(first_rn) AS lead_rn FROM decided WHERE confirmed AND second_rn IN (SELECT rn FROM gone)
    AND first_rn NOT IN (SELECT rn FROM gone) GROUP BY second_rn),
  maybe AS (SELECT d.second_rn AS rn, min(d.first_rn) AS lead_rn FROM decided d LEFT JOIN claims c ON c.rn = d.second_rn
    WHERE d.confidence >= 0.5 AND d.first_rn NOT IN (SELECT rn FROM gone) AND (c.lead_rn IS NULL OR d.first_rn < c.lead_rn) GROUP BY d.second_rn),
  assigned AS (SELECT s.article_id, s.source_id, c.rn IS NOT NULL AS is_duplicate, l.article_id AS duplicate_of, m.article_id AS candidate_of
    FROM side s LEFT JOIN claims c ON c.rn = s.rn LEFT JOIN side l ON l.rn = c.lead_rn LEFT JOIN maybe y ON y.rn = s.rn LEFT JOIN side m ON m.rn = y.lead_rn)"""

@query("assign_duplicates", BASE, f", {PAIRS} {GREEDY} SELECT * FROM assigned")
def assign_duplicates(t):
    return dedupe.assign_duplicates(t.articles)


REASONS = """coalesce(array_to_string(list_filter([CASE WHEN same_url THEN 'canonical_url' END, CASE WHEN same_hash THEN 'content_hash' END,
    CASE WHEN NOT trusted AND sim >= 0.5 THEN 'title_similarity' END, CASE WHEN NOT trusted AND inside THEN 'time_window' END,
    CASE WHEN NOT trusted AND diverse THEN 'source_diversity' END], lambda x: x IS NOT NULL), ','), '')"""


@query(
    "duplicate_relations",
    BASE,
    f""", {PAIRS} {GREEDY} SELECT relation_type, d.source_id, article_id, target_article_id, confidence, title_similarity, {r3('gap')} AS hours_apart,
    {REASONS} AS reasons, relation_type = 'duplicate_confirmed' AS duplicate_support,
    (CASE WHEN relation_type = 'duplicate_confirmed' THEN {r3('confidence * 0.2')} ELSE 0 END)::DOUBLE AS heat_boost,
    (CASE WHEN relation_type = 'duplicate_confirmed' THEN {r3('confidence * 0.12')} ELSE 0 END)::DOUBLE AS credibility_boost
    FROM (SELECT 'duplicate_confirmed' AS relation_type, article_id, duplicate_of AS target_article_id FROM assigned WHERE duplicate_of IS NOT NULL
      UNION ALL SELECT 'duplicate_candidate', article_id, candidate_of FROM assigned WHERE candidate_of IS NOT NULL) r
    JOIN decided d ON d.first_id = r.target_article_id AND d.second_id = r.article_id""",
)
def duplicate_relations(t):
    rows = dedupe.duplicate_relations(cut(dedupe.assign_duplicates(t.articles)), t.articles, NOW)
    return rows.select(
        "relation_type", "source_id", "article_id", "target_article_id", "confidence", "title_similarity",
        dedupe.round3(F.col("hours_apart")).alias("hours_apart"), F.array_join("reasons", ",").alias("reasons"),
        "duplicate_support", "heat_boost", "credibility_boost",
    )


@query(
    "dedupe_status",
    BASE,
    f""", {PAIRS} {GREEDY} SELECT a.article_id, CASE WHEN s.is_duplicate THEN 'duplicate'
      WHEN a.article_id IN (SELECT duplicate_of FROM assigned WHERE duplicate_of IS NOT NULL) THEN 'canonical'
      WHEN s.candidate_of IS NOT NULL THEN 'possible_duplicate' ELSE a.dedupe_status END AS dedupe_status
    FROM articles a JOIN assigned s ON s.article_id = a.article_id""",
)
def dedupe_status(t):
    return dedupe.dedupe_status(t.articles, cut(dedupe.assign_duplicates(t.articles))).select("article_id", "dedupe_status")


@query(
    "dedupe_summary",
    (*BASE, "sources", "relations_fx"),
    f""", {PAIRS} {GREEDY}, olds AS (SELECT * FROM relations_fx WHERE relation_type = 'duplicate_confirmed')
    SELECT (SELECT count(*) FROM assigned) AS checked_articles, (SELECT count(duplicate_of) FROM assigned) AS confirmed_duplicates,
      (SELECT count(candidate_of) FROM assigned) AS possible_duplicates,
      (SELECT count(*) FROM olds o WHERE NOT EXISTS (SELECT 1 FROM decided d WHERE d.confirmed AND least(d.first_id, d.second_id) = least(o.article_id, o.target_article_id)
        AND greatest(d.first_id, d.second_id) = greatest(o.article_id, o.target_article_id))) AS removed_stale_relations""",
)
def dedupe_summary(t):
    rel = t.relations_fx
    return dedupe.dedupe_summary(cut(dedupe.assign_duplicates(t.articles)), dedupe.stale_relations(rel, t.articles))


# Evidence of each article against the one published next in its source-independent order.
NEXT = """nexts AS (SELECT a.article_id AS first_id, b.article_id AS second_id FROM articles a JOIN articles b
  ON CAST(substr(b.article_id, 5) AS BIGINT) = CAST(substr(a.article_id, 5) AS BIGINT) + 1),
  hashes AS (SELECT content_hash, min(article_id) AS m FROM articles GROUP BY content_hash),
  given AS (SELECT * FROM nexts UNION SELECT h.m, a.article_id FROM articles a JOIN hashes h ON h.content_hash = a.content_hash WHERE a.article_id <> h.m)"""
ONE_PAIR = PAIRS.replace("FROM side a JOIN side b ON a.rn < b.rn", "FROM given g JOIN side a ON a.article_id = g.first_id JOIN side b ON b.article_id = g.second_id")


def _given(t):
    a = t.articles.select("article_id", "content_hash")
    number = F.substring("article_id", 5, 20).cast("long")
    nexts = a.select(F.col("article_id").alias("first_id"), (number + 1).alias("n")).join(
        a.select(F.col("article_id").alias("second_id"), number.alias("n")), "n"
    ).select("first_id", "second_id")
    firsts = a.groupBy("content_hash").agg(F.min("article_id").alias("first_id"))
    copies = a.withColumnRenamed("article_id", "second_id").join(firsts, "content_hash").filter("first_id <> second_id")
    return nexts.unionByName(copies.select("first_id", "second_id")).distinct()


@query(
    "pair_evidence",
    BASE,
    f", {NEXT}, {ONE_PAIR} SELECT first_id, second_id, confidence, title_similarity, {r3('gap')} AS hours_apart, {REASONS} AS reasons FROM decided",
)
def pair_evidence(t):
    return dedupe.pair_evidence(_given(t), t.articles).select(
        "first_id", "second_id", "confidence", "title_similarity", dedupe.round3(F.col("hours_apart")).alias("hours_apart"),
        F.array_join("reasons", ",").alias("reasons"),
    )


@query(
    "pair_decision",
    BASE,
    f", {NEXT}, {ONE_PAIR} SELECT first_id, second_id, confirmed, NOT confirmed AND confidence >= 0.5 AS possible FROM decided",
)
def pair_decision(t):
    return dedupe.pair_decision(dedupe.pair_evidence(_given(t), t.articles)).select("first_id", "second_id", "confirmed", "possible")


@query(
    "retract_stale",
    (*BASE, "sources", "relations_fx"),
    f""", given AS (SELECT target_article_id AS first_id, article_id AS second_id FROM relations_fx WHERE relation_type = 'duplicate_confirmed'), {ONE_PAIR}
    SELECT relation_type, r.source_id, article_id, signal_id, target_article_id FROM relations_fx r
    LEFT JOIN decided d ON d.first_id = r.target_article_id AND d.second_id = r.article_id AND d.confirmed
    WHERE relation_type <> 'duplicate_confirmed' OR d.first_id IS NOT NULL""",
)
def retract_stale(t):
    return dedupe.retract_stale(t.relations_fx, t.articles).select(
        "relation_type", "source_id", "article_id", "signal_id", "target_article_id"
    )


@query(
    "connected_components",
    BASE,
    """, edges AS (SELECT g.m AS a, a.article_id AS b FROM articles a JOIN (SELECT content_hash, min(article_id) AS m FROM articles GROUP BY content_hash) g
        ON g.content_hash = a.content_hash WHERE g.m <> a.article_id
      UNION SELECT g.m, a.article_id FROM articles a JOIN (SELECT title, min(article_id) AS m FROM articles GROUP BY title) g
        ON g.title = a.title WHERE g.m <> a.article_id),
    both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
    reach(id, other) AS (SELECT article_id, article_id FROM articles UNION SELECT r.id, b.b FROM reach r JOIN both_ b ON b.a = r.other)
    SELECT id, min(other) AS component FROM reach GROUP BY id""",
)
def connected_components(t):
    a = t.articles.select("article_id", "content_hash", "title")

    def star(key):
        first = a.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("article_id").alias("a"))
        return a.join(first, key).filter("a <> article_id").select("a", F.col("article_id").alias("b"))

    return components.connected_components(star("content_hash").unionByName(star("title")), a.select(F.col("article_id").alias("id")))


# --- clusters: duplicates from the pass above, all within the eligible articles -------------

ELIGIBLE = "classified WHERE visibility_status <> 'hidden_latest' AND quality_status <> 'low_quality'"
CLUSTER = f""", ok AS (SELECT article_id FROM {ELIGIBLE}),
  copies AS (SELECT article_id AS x, duplicate_of AS y FROM assigned WHERE duplicate_of IS NOT NULL),
  cpairs AS (SELECT first_rn, second_rn, diverse, title_similarity AS sim, gap IS NULL OR gap <= 48 AS inside,
      EXISTS (SELECT 1 FROM copies WHERE (x = first_id AND y = second_id) OR (x = second_id AND y = first_id)) AS is_copy
    FROM decided WHERE first_id IN (SELECT article_id FROM ok) AND second_id IN (SELECT article_id FROM ok)),
  cscored AS (SELECT *, CASE WHEN is_copy THEN 0.98::DOUBLE ELSE {r3("least(0.94, (sim + CASE WHEN diverse THEN 0.06 ELSE 0.0 END) * CASE WHEN inside THEN 1.0 ELSE 0.45 END)")}::DOUBLE END AS score,
      is_copy OR (sim >= 0.62 AND inside AND diverse) AS clusterable FROM cpairs),
  cedges AS (SELECT * FROM cscored WHERE is_copy OR (sim >= 0.62 AND inside) OR sim >= 1.45)"""
# One step per article: its label is the smallest label whose best-scoring earlier member pulls it in.
WALK = """, cnear AS (SELECT second_rn AS rn, list(struct_pack(f := first_rn, s := score, c := clusterable) ORDER BY score DESC, first_rn) AS edges FROM cedges GROUP BY second_rn),
  csteps AS (SELECT rn, edges, row_number() OVER (ORDER BY rn) AS step FROM cnear),
  walk(step, seen, labels) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL
    SELECT n.step, list_append(w.seen, n.rn), list_append(w.labels, coalesce(list_min(list_filter(
      list_transform(n.edges, lambda e, i: CASE WHEN e.c AND i = list_position(
          list_transform(n.edges, lambda g: coalesce(w.labels[list_position(w.seen, g.f)], g.f)), coalesce(w.labels[list_position(w.seen, e.f)], e.f))
        THEN coalesce(w.labels[list_position(w.seen, e.f)], e.f) END), lambda v: v IS NOT NULL)), n.rn))
    FROM walk w JOIN csteps n ON n.step = w.step + 1),
  final AS (SELECT unnest(seen) AS rn, unnest(labels) AS label FROM (SELECT * FROM walk ORDER BY step DESC LIMIT 1)),
  stories AS (SELECT s.article_id, s.rn, coalesce(f.label, s.rn) AS label, l.article_id AS first_article_id
    FROM side s JOIN ok ON ok.article_id = s.article_id LEFT JOIN final f ON f.rn = s.rn JOIN side l ON l.rn = coalesce(f.label, s.rn))"""
ALL = f", {GRADED}, {PAIRS} {GREEDY} {CLUSTER}"


def _cluster_inputs(t):
    graded = cut(quality.classify_articles(t.articles, t.sources, NOW))
    pairs = cut(dedupe.title_pairs(graded))
    relations = cut(dedupe.duplicate_relations(cut(dedupe.assign_duplicates(graded, pairs)), graded, NOW))
    return graded, pairs, relations


def _ident(c):
    return F.substring_index(c, "|", -1)


@query("cluster_eligible", FULL, f", {GRADED} SELECT article_id FROM {ELIGIBLE}")
def cluster_eligible(t):
    return cluster.eligible(quality.classify_articles(t.articles, t.sources, NOW)).select("article_id")


@query(
    "cluster_edges",
    FULL,
    f"{ALL} SELECT a.article_id AS first_id, b.article_id AS second_id, score, clusterable FROM cedges e JOIN side a ON a.rn = e.first_rn JOIN side b ON b.rn = e.second_rn",
)
def cluster_edges(t):
    graded, pairs, relations = _cluster_inputs(t)
    return cluster.cluster_edges(graded, relations, pairs).select(
        _ident(F.col("first_key")).alias("first_id"), _ident(F.col("second_key")).alias("second_id"), "score", "clusterable"
    )


def _stories(t):
    graded, pairs, relations = _cluster_inputs(t)
    members = cut(cluster.assign_clusters(graded, relations, pairs))
    return graded, relations, members


@query("assign_clusters", FULL, f"{ALL} {WALK} SELECT article_id, first_article_id FROM stories")
def assign_clusters(t):
    return _stories(t)[2].select("article_id", _ident(F.col("story")).alias("first_article_id"))


LEADS = """, ranked_ AS (SELECT y.label, y.article_id, c.source_id, c.title, c.published_at, row_number() OVER (PARTITION BY label ORDER BY coalesce(c.trust_score, 0) DESC,
    CASE WHEN c.family = 'company_announcement' THEN 0 ELSE 1 END, CASE WHEN length(c.text_for_ai) > 0 THEN 0 ELSE 1 END, y.rn) AS place
    FROM stories y JOIN classified c ON c.article_id = y.article_id),
  leads AS (SELECT label, article_id AS lead_article_id, title, published_at FROM ranked_ WHERE place = 1)"""


@query(
    "choose_lead",
    FULL,
    f"{ALL} {WALK} {LEADS} SELECT f.article_id AS first_article_id, lead_article_id FROM leads JOIN side f ON f.rn = leads.label",
)
def choose_lead(t):
    graded, _, members = _stories(t)
    return cluster.choose_lead(members, graded, t.sources).select(_ident(F.col("story")).alias("first_article_id"), "lead_article_id")


# Known signals: the fixed three-article ones, so some leads match and most do not.
MATCH = """, sizes_ AS (SELECT label, count(*) AS n FROM stories GROUP BY label), ssizes AS (SELECT signal_id, count(*) AS n FROM links_fx GROUP BY signal_id),
  same AS (SELECT label, min(signal_id) AS by_members FROM (SELECT y.label, l.signal_id, count(*) AS shared FROM stories y JOIN links_fx l ON l.article_id = y.article_id
    GROUP BY y.label, l.signal_id) q JOIN sizes_ s USING (label) JOIN ssizes z USING (signal_id) WHERE shared = s.n AND shared = z.n GROUP BY label),
  led AS (SELECT label, min(signal_id) AS by_lead FROM leads JOIN links_fx l ON l.article_id = lead_article_id AND l.role = 'lead' GROUP BY label),
  matched AS (SELECT d.label, lead_article_id, d.title, d.published_at, coalesce(by_members, by_lead, 'sig_' || substr(sha256(lead_article_id), 1, 16)) AS signal_id,
    by_members IS NULL AND by_lead IS NULL AS is_new FROM leads d LEFT JOIN same USING (label) LEFT JOIN led USING (label)),
  fresh_links AS (SELECT signal_id, y.article_id, CASE WHEN y.article_id = lead_article_id THEN 'lead' ELSE 'supporting' END AS role FROM stories y JOIN matched USING (label))"""
KNOWN = (*FULL, "signals_fx", "links_fx")


def _matched(t):
    graded, relations, members = _stories(t)
    leads = cut(cluster.choose_lead(members, graded, t.sources))
    matched = cut(cluster.match_signals(members, leads, graded, t.signals_fx, t.links_fx))
    return graded, relations, members, matched


@query("match_signals", KNOWN, f"{ALL} {WALK} {LEADS} {MATCH} SELECT signal_id, lead_article_id, is_new, title, published_at AS primary_published_at FROM matched")
def match_signals(t):
    m = _matched(t)[3]
    return m.select("signal_id", "lead_article_id", "is_new", "title", F.col("primary_published_at").cast("timestamp_ntz").alias("primary_published_at"))


@query(
    "touch_signals",
    KNOWN,
    f"""{ALL} {WALK} {LEADS} {MATCH} SELECT signal_id, CASE WHEN EXISTS (SELECT 1 FROM matched m WHERE m.signal_id = s.signal_id AND NOT is_new) THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at
    FROM signals_fx s""",
)
def touch_signals(t):
    touched = cluster.touch_signals(t.signals_fx, _matched(t)[3], NOW)
    return touched.select("signal_id", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query(
    "replace_members",
    KNOWN,
    f"""{ALL} {WALK} {LEADS} {MATCH} SELECT * FROM fresh_links UNION ALL SELECT signal_id, article_id, role FROM links_fx l
    WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.signal_id = l.signal_id)""",
)
def replace_members(t):
    _, _, members, matched = _matched(t)
    return cluster.replace_members(t.links_fx, members, matched)


@query(
    "support_edges",
    KNOWN,
    f"""{ALL} {WALK} {LEADS} {MATCH}, given AS (SELECT m.lead_article_id AS first_id, f.article_id AS second_id, f.signal_id, f.role
      FROM fresh_links f JOIN matched m ON m.signal_id = f.signal_id),
    against AS (SELECT g.signal_id, g.role, b.article_id, b.source_id, a.source_id <> b.source_id AS diverse,
      {r3("CASE WHEN len(a.w) > 0 AND len(b.w) > 0 THEN 2.0::DOUBLE * len(list_filter(a.w, lambda x: list_contains(b.w, x))) / (len(a.w) + len(b.w)) ELSE 0.0 END")} AS sim,
      {hours('a.at', 'b.at')} AS gap, EXISTS (SELECT 1 FROM copies WHERE (x = g.first_id AND y = g.second_id) OR (x = g.second_id AND y = g.first_id)) AS is_copy
      FROM given g JOIN side a ON a.article_id = g.first_id JOIN side b ON b.article_id = g.second_id)
    SELECT signal_id, source_id, article_id, role, (CASE WHEN role = 'lead' THEN 1.0 ELSE sim END)::DOUBLE AS title_similarity,
      (CASE WHEN role = 'lead' THEN 0.0 ELSE {r3('gap')} END)::DOUBLE AS hours_apart,
      (CASE WHEN role = 'lead' THEN 1.0 WHEN is_copy THEN 0.98 ELSE {r3("least(0.94, (sim + CASE WHEN diverse THEN 0.06 ELSE 0.0 END) * CASE WHEN coalesce(gap, 0) <= 48 THEN 1.0 ELSE 0.45 END)")} END)::DOUBLE AS cluster_score,
      CASE WHEN role = 'lead' THEN 'lead_article' WHEN is_copy THEN 'duplicate_confirmed' ELSE coalesce(array_to_string(list_filter([CASE WHEN sim >= 0.62 THEN 'title_similarity' END,
        CASE WHEN coalesce(gap, 0) <= 48 THEN 'time_window' END, CASE WHEN diverse THEN 'source_diversity' END], lambda x: x IS NOT NULL), ','), '') END AS reasons
    FROM against""",
)
def support_edges(t):
    graded, relations, members, matched = _matched(t)
    rows = cluster.support_edges(cluster.story_links(members, matched), graded, relations, NOW)
    return rows.select(
        "signal_id", "source_id", "article_id", "role", "title_similarity", dedupe.round3(F.col("hours_apart")).alias("hours_apart"),
        "cluster_score", F.array_join("reasons", ",").alias("reasons"),
    )


@query(
    "cluster_summary",
    KNOWN,
    f"""{ALL} {WALK} {LEADS} {MATCH} SELECT (SELECT count(*) FROM articles) AS checked_articles, (SELECT count(*) FROM ok) AS eligible_articles,
    (SELECT count(*) FROM matched WHERE is_new) AS created_signals, (SELECT count(*) FROM matched WHERE NOT is_new) AS updated_signals,
    (SELECT count(*) FROM fresh_links) AS linked_articles, (SELECT count(*) FROM articles) - (SELECT count(*) FROM ok) AS unclustered_articles""",
)
def cluster_summary(t):
    graded, _, members, matched = _matched(t)
    return cluster.cluster_summary(graded, matched, cluster.story_links(members, matched))
