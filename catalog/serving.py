"""Read queries over the fixed signals."""

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from storyloom.operators import scoring, serving, topics
from storyloom.operators.lineage import shared_folder
from storyloom.operators.search_index import SearchIndex, StoredIndex
from storyloom.operators.serving import FAMILY_LABELS

from .registry import query, r3
from .scoring import SCORES

BASE = ("articles", "sources", "signals_fx", "links_fx", "signal_topics_fx")
CLOCK = datetime(2024, 1, 31)

LABEL = "CASE family " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILY_LABELS.items()) + " ELSE family END"
NAMES = "(VALUES " + ", ".join(f"('{s}', '{n}', '{d}')" for s, n, d in topics.TOPICS) + ") v(slug, name, description)"

# Visible signals, sources in first-seen order, main language, shown topics.
CTX = f"""vis AS (SELECT * FROM signals_fx WHERE status NOT IN ('hidden', 'deleted')),
  placed AS (SELECT l.signal_id, a.source_id, s.name, s.family, s.language, coalesce(a.published_at, a.created_at) AS pub, a.article_id, a.canonical_url
    FROM links_fx l JOIN articles a ON a.article_id = l.article_id JOIN sources s ON s.source_id = a.source_id),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY signal_id, source_id ORDER BY pub, article_id) AS rn FROM placed),
  seen AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY pub, article_id) AS place FROM firsts WHERE rn = 1),
  fams AS (SELECT signal_id, family, min(place) AS place FROM seen GROUP BY signal_id, family),
  ctx AS (SELECT s.signal_id, count(*) AS source_count, string_agg(source_id, ',' ORDER BY place) AS source_ids, string_agg(coalesce(canonical_url, '-'), ' ' ORDER BY place) AS urls,
    (SELECT string_agg(family, ',' ORDER BY f.place) FROM fams f WHERE f.signal_id = s.signal_id) AS families,
    arg_min(language, place) AS language FROM seen s GROUP BY s.signal_id),
  shown AS (SELECT t.signal_id, t.topic_slug, n.name AS topic_name, t.confidence, t.method FROM signal_topics_fx t JOIN {NAMES.replace(' v(', ' n(')} ON n.slug = t.topic_slug
    WHERE t.topic_slug <> 'company-announcements' OR EXISTS (SELECT 1 FROM fams f WHERE f.signal_id = t.signal_id AND f.family = 'company_announcement'))"""
ORDER = "heat_score DESC, signal_score DESC, coalesce(epoch_ms(primary_published_at), 0) DESC, signal_id"
TIERS = f"""ranked AS (SELECT v.*, c.source_count, c.families, c.language, row_number() OVER (ORDER BY {ORDER.replace('signal_id', 'v.signal_id')}) AS rn,
    row_number() OVER (PARTITION BY c.language ORDER BY {ORDER.replace('signal_id', 'v.signal_id')}) AS in_language FROM vis v JOIN ctx c ON c.signal_id = v.signal_id),
  tiers AS (SELECT *, CASE WHEN rn = 1 THEN 0 WHEN in_language = 1 THEN 1 ELSE 2 END AS tier FROM ranked),
  front AS (SELECT *, row_number() OVER (ORDER BY tier, rn) - 1 AS place FROM tiers QUALIFY place < 8)"""


def _context(t):
    return serving.source_context(t.links_fx, t.articles, t.sources)


def _shown(t, context):
    return serving.visible_topics(t.signal_topics_fx, topics.topics_dim(t.spark), context)


_INDEXES: dict[tuple[str, str], SearchIndex] = {}


def _index(t):
    """The search index of the articles, written once per session."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = SearchIndex.of(t.articles)
    return _INDEXES[key]


def _points(df):
    """Key points with the texts the display rules look at."""
    point = lambda text: F.struct(text.alias("text"), F.array().cast("array<string>").alias("source_ids"))
    n = F.col("number")
    return df.withColumn(
        "key_points",
        F.when(n % 4 == 0, F.array(point(F.lit("提供了该信号的基础来源信息")), point(F.concat(F.lit("要点 "), n.cast("string"), F.lit("！")))))
        .when(n % 4 == 1, F.array(point(F.lit("first.")), point(F.lit("second")), point(F.lit("third")))),
    )


@query("ranked_visible", BASE, f", {CTX} SELECT signal_id, heat_score, signal_score FROM vis ORDER BY {ORDER}")
def ranked_visible(t):
    return serving.ranked_visible(t.signals_fx).select("signal_id", "heat_score", "signal_score")


@query("source_context", BASE, f", {CTX} SELECT * FROM ctx")
def source_context(t):
    c = _context(t)
    pick = lambda f: F.transform("sources", lambda s: s[f])
    return c.select(
        "signal_id", "source_count", F.array_join(pick("source_id"), ",").alias("source_ids"),
        F.array_join(F.transform("sources", lambda s: F.coalesce(s["original_url"], F.lit("-"))), " ").alias("urls"),
        F.array_join("source_families", ",").alias("families"), "language",
    )


@query("visible_topics", BASE, f", {CTX} SELECT signal_id, topic_slug, topic_name, confidence, method FROM shown")
def visible_topics(t):
    return _shown(t, _context(t))


BRIEF = """points AS (SELECT signal_id, CASE number % 4 WHEN 0 THEN ['提供了该信号的基础来源信息', '要点 ' || number] WHEN 1 THEN ['first', 'second', 'third'] ELSE []::VARCHAR[] END AS said FROM signals_fx),
  briefs AS (SELECT s.*, p.said, coalesce(nullif(trim(regexp_replace(coalesce(nullif(ai_brief, ''), summary), '\\s+', ' ', 'g')), ''), '') AS b,
    regexp_replace(coalesce(trim(regexp_replace(next_watch, '\\s+', ' ', 'g')), ''), '[。.!?！？；;]+$', '') AS watch FROM signals_fx s JOIN points p USING (signal_id)),
  shown_briefs AS (SELECT *, CASE
    WHEN contains(b, 'AI 精炼暂不可用') THEN regexp_replace(coalesce(list_filter(said, lambda p: NOT contains(p, '提供了该信号的基础来源信息'))[1],
      trim(regexp_replace(title, '\\s+', ' ', 'g')) || ' 已根据来源标题、摘要和发布时间完成基础整理'), '[。.!?！？；;]+$', '') || '。后续会结合模型精炼、官方更新或更多来源确认继续补充要点。'
    WHEN NOT regexp_matches(b, '(后端处理流程|后台已保留)') THEN b
    WHEN len(said) > 0 OR watch <> '' THEN CASE WHEN len(said) > 0 THEN '要点显示：' || array_to_string(said[1:2], '；') || '。' ELSE '' END || CASE WHEN watch <> '' THEN '后续观察：' || watch || '。' ELSE '' END
    ELSE regexp_replace(regexp_replace(b, '。?这条资讯已经进入后端处理流程[^。]*。?', '', 'g'), '。?后台已保留[^。]*。?', '', 'g') END AS display_brief FROM briefs)"""


@query("display_brief", BASE, f", {BRIEF} SELECT signal_id, display_brief FROM shown_briefs")
def display_brief(t):
    return serving.display_brief(_points(t.signals_fx)).select("signal_id", "display_brief")


@query(
    "signal_summary",
    BASE,
    f""", {CTX}, {BRIEF} SELECT b.signal_id, coalesce(nullif(display_brief, ''), summary) AS summary, CASE WHEN coalesce(ai_brief, '') <> '' THEN display_brief ELSE ai_brief END AS ai_brief,
    heat_score, signal_score, status, source_count, families, source_ids,
    coalesce((SELECT string_agg(topic_slug, ',' ORDER BY topic_slug) FROM shown h WHERE h.signal_id = b.signal_id), '') AS topics
    FROM shown_briefs b JOIN ctx c ON c.signal_id = b.signal_id WHERE status NOT IN ('hidden', 'deleted')""",
)
def signal_summary(t):
    context = _context(t)
    s = serving.signal_summary(serving.visible(_points(t.signals_fx)), context, _shown(t, context))
    return s.select(
        "signal_id", "summary", "ai_brief", "heat_score", "signal_score", "status", "source_count",
        F.array_join("source_families", ",").alias("families"),
        F.array_join(F.transform("sources", lambda x: x["source_id"]), ",").alias("source_ids"),
        F.coalesce(F.array_join(F.transform("topics", lambda x: x["topic_slug"]), ","), F.lit("")).alias("topics"),
    )


@query(
    "attribution_links",
    BASE,
    f", {CTX} SELECT v.signal_id, a.article_id, a.source_id, a.title, a.canonical_url AS url, l.role FROM vis v JOIN links_fx l ON l.signal_id = v.signal_id JOIN articles a ON a.article_id = l.article_id",
)
def attribution_links(t):
    return serving.attribution_links(serving.visible(t.signals_fx), t.links_fx, t.articles)


@query("diversify", BASE, f", {CTX}, {TIERS} SELECT signal_id, tier, language FROM tiers ORDER BY tier, rn LIMIT 8")
def diversify(t):
    rows = serving.with_context(serving.visible(t.signals_fx), _context(t))
    return serving.diversify(rows, 8).select("signal_id", "tier", "language")


@query("home", BASE, f", {CTX}, {TIERS} SELECT place, signal_id, title, heat_score, source_count FROM front")
def home(t):
    return serving.home(t.signals_fx, _context(t)).select("place", "signal_id", "title", "heat_score", "source_count")


@query(
    "data_window",
    BASE,
    f""", {CTX}, {TIERS} SELECT CASE WHEN (SELECT count(*) FROM vis WHERE strftime(primary_published_at, '%Y-%m-%d') = '2024-01-30') > 0 THEN 'today' ELSE 'latest' END AS label,
    '2024-01-30' AS date, coalesce(bool_or(strftime(primary_published_at, '%Y-%m-%d') = '2024-01-30'), false) AS includes_today,
    min(primary_published_at) AS from_at, max(primary_published_at) AS to_at FROM front""",
)
def data_window(t):
    return serving.data_window(t.signals_fx, serving.home(t.signals_fx, _context(t)), datetime(2024, 1, 30, 12))


@query(
    "ticker",
    BASE,
    f""", {CTX}, {TIERS} SELECT place, signal_id, title || ' · ' || source_count || ' sources · heat ' ||
    regexp_replace(regexp_replace(printf('%.2f', floor(heat_score * 100.0 + 0.5) / 100.0), '0+$', ''), '\\.$', '') AS text, heat_score, primary_published_at FROM front WHERE place < 6""",
)
def ticker(t):
    return serving.ticker(serving.home(t.signals_fx, _context(t)))


@query(
    "stats",
    BASE,
    f""", {CTX} SELECT count(*) AS visible_signals, count(*) FILTER (enrichment_status = 'completed') AS enriched_signals, (SELECT count(*) FROM articles) AS articles_indexed,
    (SELECT count(*) FROM sources) AS source_count, count(*) FILTER (heat_score >= 70) AS hot_signals FROM vis""",
)
def stats(t):
    return serving.stats(t.signals_fx, t.articles, t.sources)


FAMILIES = f"""counted AS (SELECT f.family, count(*) AS signal_count FROM fams f JOIN vis v ON v.signal_id = f.signal_id GROUP BY f.family),
  families_ AS (SELECT family, {LABEL} AS label, signal_count, (SELECT count(*) FROM sources s WHERE s.family = c.family) AS source_count FROM counted c)"""


@query("family_summary", BASE, f", {CTX}, {FAMILIES} SELECT * FROM families_")
def family_summary(t):
    return serving.family_summary(t.signals_fx, _context(t), t.sources)


@query("date_summary", BASE, f", {CTX} SELECT strftime(primary_published_at, '%Y-%m-%d') AS date, count(*) AS signal_count FROM vis WHERE primary_published_at IS NOT NULL GROUP BY 1")
def date_summary(t):
    return serving.date_summary(t.signals_fx)


@query(
    "list_sources",
    BASE,
    f""", {CTX} SELECT source_id, name, family, source_type, enabled, trust_score,
    (SELECT count(DISTINCT p.signal_id) FROM placed p JOIN vis v ON v.signal_id = p.signal_id WHERE p.source_id = s.source_id) AS signal_count,
    (SELECT count(*) FROM articles a WHERE a.source_id = s.source_id) AS article_count FROM sources s""",
)
def list_sources(t):
    return serving.list_sources(t.signals_fx, t.links_fx, t.articles, t.sources)


PREVIEWS = f"""by_family AS (SELECT f.family, r.*, row_number() OVER (PARTITION BY f.family ORDER BY rn) AS frn, row_number() OVER (PARTITION BY f.family, r.language ORDER BY rn) AS fl
    FROM fams f JOIN ranked r ON r.signal_id = f.signal_id),
  previews AS (SELECT family, signal_id, row_number() OVER (PARTITION BY family ORDER BY CASE WHEN frn = 1 THEN 0 WHEN fl = 1 THEN 1 ELSE 2 END, frn) AS place FROM by_family)"""


@query("source_type_previews", BASE, f", {CTX}, {TIERS}, {PREVIEWS} SELECT family, place, signal_id FROM previews WHERE place <= 3")
def source_type_previews(t):
    return serving.source_type_previews(t.signals_fx, _context(t)).select("family", "place", "signal_id")


@query(
    "source_types",
    BASE,
    f""", {CTX}, {TIERS}, {PREVIEWS}, {FAMILIES} SELECT m.*, (SELECT string_agg(signal_id, ',' ORDER BY place) FROM previews p WHERE p.family = m.family AND place <= 3) AS preview_ids FROM families_ m""",
)
def source_types(t):
    return serving.source_types(t.signals_fx, _context(t), t.sources).withColumn("preview_ids", F.array_join("preview_ids", ","))


@query(
    "source_type_archive",
    BASE,
    f", {CTX}, {TIERS}, {PREVIEWS} SELECT signal_id, place FROM previews WHERE family = 'research' ORDER BY place LIMIT 10 OFFSET 5".replace("SELECT signal_id, place FROM", "SELECT signal_id FROM"),
)
def source_type_archive(t):
    return serving.source_type_archive(t.signals_fx, _context(t), "research", "5", 10)[0].select("signal_id")


OF_FAMILY = "signal_id IN (SELECT p.signal_id FROM placed p WHERE p.family = 'policy')"


@query("family_archive", BASE, f", {CTX} SELECT signal_id FROM vis WHERE {OF_FAMILY} ORDER BY {ORDER} LIMIT 20")
def family_archive(t):
    return serving.family_archive(t.signals_fx, t.links_fx, t.articles, t.sources, "policy")[0].select("signal_id")


@query(
    "family_archive_page_info",
    BASE,
    f""", {CTX} SELECT CAST(50 AS INT) AS "limit", '20' AS cursor, CASE WHEN n > 70 THEN '70' END AS next_cursor, n > 70 AS has_more, n AS total FROM (SELECT count(*) AS n FROM vis WHERE {OF_FAMILY})""",
)
def family_archive_page_info(t):
    return serving.family_archive(t.signals_fx, t.links_fx, t.articles, t.sources, "policy", 20, 500)[1]


@query(
    "family_archive_articles",
    BASE,
    """ SELECT a.article_id, a.source_id, title, excerpt, author, a.language, published_at, canonical_url AS original_url, coalesce(full_text_display_allowed, false) AS full_text_display_allowed
    FROM articles a JOIN sources s ON s.source_id = a.source_id WHERE s.family = 'policy'""",
)
def family_archive_articles(t):
    return serving.family_archive(t.signals_fx, t.links_fx, t.articles, t.sources, "policy")[2]


@query("source_archive", BASE, f", {CTX} SELECT signal_id, title FROM vis WHERE signal_id IN (SELECT signal_id FROM placed WHERE source_id = 'src3')")
def source_archive(t):
    return serving.source_archive(t.signals_fx, t.links_fx, t.articles, t.sources, "funding", "src3")[1].select("signal_id", "title")


@query(
    "date_archive_week",
    BASE,
    f", {CTX} SELECT signal_id, primary_published_at FROM vis WHERE primary_published_at >= TIMESTAMP '2024-01-25' AND primary_published_at < TIMESTAMP '2024-02-01' ORDER BY {ORDER} LIMIT 20",
)
def date_archive_week(t):
    return serving.date_archive(t.signals_fx, CLOCK, "week")[0].select("signal_id", "primary_published_at")


@query(
    "date_archive_range",
    BASE,
    f", {CTX} SELECT signal_id FROM vis WHERE primary_published_at >= TIMESTAMP '2024-01-05' AND primary_published_at < TIMESTAMP '2024-01-13' ORDER BY {ORDER} LIMIT 30 OFFSET 3",
)
def date_archive_range(t):
    return serving.date_archive(t.signals_fx, CLOCK, None, "2024-01-05", "2024-01-12", 3, 30)[0].select("signal_id")


@query(
    "list_topics",
    BASE,
    f""", {CTX} SELECT v.slug, v.name, v.description, count(DISTINCT s.signal_id) AS signal_count, max(s.primary_published_at) AS latest_signal_at FROM {NAMES}
    LEFT JOIN shown h ON h.topic_slug = v.slug LEFT JOIN vis s ON s.signal_id = h.signal_id GROUP BY v.slug, v.name, v.description""",
)
def list_topics(t):
    return serving.list_topics(t.signals_fx, _shown(t, _context(t)), topics.topics_dim(t.spark))


@query("topic_archive", BASE, f", {CTX} SELECT signal_id FROM vis WHERE signal_id IN (SELECT signal_id FROM shown WHERE topic_slug = 'policy') ORDER BY {ORDER} LIMIT 15")
def topic_archive(t):
    return serving.topic_archive(t.signals_fx, _shown(t, _context(t)), "policy", None, "15")[0].select("signal_id")


HITS = f"""texts AS (SELECT signal_id, lower(concat_ws(' ', title, summary, ai_brief, next_watch)) AS txt FROM vis
    UNION ALL SELECT l.signal_id, lower(concat_ws(' ', a.title, a.excerpt, a.text_for_ai)) FROM links_fx l JOIN articles a ON a.article_id = l.article_id),
  hits AS (SELECT signal_id, (max(CASE WHEN contains(txt, 'the') THEN 1 ELSE 0 END) * 2 + max(CASE WHEN contains(txt, 'watch') THEN 1 ELSE 0 END) + max(CASE WHEN contains(txt, 'zzz') THEN 1 ELSE 0 END)) / 4.0 AS share FROM texts GROUP BY signal_id),
  found AS (SELECT v.*, h.share + heat_score / 1000.0 AS relevance, h.share FROM vis v JOIN hits h USING (signal_id))"""


@query("search", BASE, f", {CTX}, {HITS} SELECT signal_id, {r3('relevance')} AS relevance FROM found WHERE relevance > 0")
def search(t):
    c = _context(t)
    rows = serving.search(t.signals_fx, t.links_fx, t.articles, c, _shown(t, c), "The watch the  ZZZ", index=_index(t))
    return rows.select("signal_id", (F.floor(F.col("relevance") * 1000.0 + 0.5) / 1000.0).alias("relevance"))


@query(
    "search_filtered",
    BASE,
    f""", {CTX}, {HITS} SELECT signal_id, {r3('relevance')} AS relevance FROM found WHERE share > 0 AND signal_id IN (SELECT signal_id FROM fams WHERE family = 'research')
    AND signal_id IN (SELECT signal_id FROM shown WHERE topic_slug IN ('policy')) AND primary_published_at >= TIMESTAMP '2024-01-03' AND primary_published_at < TIMESTAMP '2024-01-29'""",
)
def search_filtered(t):
    c = _context(t)
    rows = serving.search(
        t.signals_fx, t.links_fx, t.articles, c, _shown(t, c), "the watch the zzz", "policy", "research", "2024-01-03", "2024-01-28", CLOCK, True, _index(t)
    )
    return rows.select("signal_id", (F.floor(F.col("relevance") * 1000.0 + 0.5) / 1000.0).alias("relevance"))


@query(
    "search_by_texts",
    BASE,
    f", {CTX}, {HITS} SELECT signal_id, {r3('relevance')} AS relevance FROM found WHERE relevance > 0",
)
def search_by_texts(t):
    """The same search without an index, and by an index whose articles were changed and put back; both must agree."""
    c = _context(t)
    plain = serving.search(t.signals_fx, t.links_fx, t.articles, c, _shown(t, c), "the WATCH the zzz")
    stored = StoredIndex(t.spark, f"postings_{uuid.uuid4().hex}", f"{shared_folder(t.spark)}/postings-{uuid.uuid4().hex}", parts=16)
    late = t.articles.filter("published_at > TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    stored.update(t.articles.withColumn("text_for_ai", F.when(F.col("published_at") > F.lit("2024-01-20").cast("timestamp_ntz"), "watch zzz").otherwise(F.col("text_for_ai"))))
    stored.update(late)
    found = serving.search(t.signals_fx, t.links_fx, t.articles, c, _shown(t, c), "the WATCH the zzz", index=stored.read())
    rounded = lambda rows: rows.select("signal_id", (F.floor(F.col("relevance") * 1000.0 + 0.5) / 1000.0).alias("relevance"))
    return rounded(plain).join(rounded(found), ["signal_id", "relevance"])


@query("search_no_query", BASE, f", {CTX} SELECT signal_id, heat_score / 100.0 AS relevance FROM vis WHERE signal_id IN (SELECT signal_id FROM fams WHERE family = 'community')")
def search_no_query(t):
    c = _context(t)
    return serving.search(t.signals_fx, t.links_fx, t.articles, c, _shown(t, c), "", family="community").select("signal_id", "relevance")


@query("paginate", BASE, f", {CTX} SELECT signal_id, heat_score FROM vis ORDER BY {ORDER} LIMIT 20 OFFSET 40")
def paginate(t):
    return serving.paginate(serving.visible(t.signals_fx), serving.product_order(), "40")[0].select("signal_id", "heat_score")


@query("page_after", BASE, f", {CTX} SELECT signal_id, heat_score FROM vis WHERE heat_score < 80 ORDER BY {ORDER} LIMIT 20")
def page_after(t):
    last = {"heat_score": 80.0, "signal_score": -1.0, "published_ms": 0, "signal_id": ""}
    return serving.page_after(serving.visible(t.signals_fx), last).select("signal_id", "heat_score")


# Points refer to the first three sources of the table by number; only member sources resolve.
@query(
    "detail_points",
    BASE,
    f""", {CTX}, items AS (SELECT signal_id, CAST(n AS INT) AS position, 'point ' || n AS text, n FROM vis, (VALUES (0), (1)) x(n)),
    ids AS (SELECT signal_id, position, text, unnest(['src' || (position * 5), 'src' || (position * 5 + 1), 'src' || (position * 5 + 2), 'src' || (position * 5 + 3)]) AS source_id, unnest([0, 1, 2, 3]) AS n FROM items)
    SELECT i.signal_id, i.position, i.text, coalesce(string_agg(s.source_id, ',' ORDER BY i.n) FILTER (s.source_id IS NOT NULL), '') AS sources
    FROM ids i LEFT JOIN seen s ON s.signal_id = i.signal_id AND s.source_id = i.source_id GROUP BY i.signal_id, i.position, i.text""",
)
def detail_points(t):
    point = lambda k: F.struct(
        F.lit(f"point {k}").alias("text"), F.array(*[F.lit(f"src{k * 5 + i}") for i in range(4)]).alias("source_ids")
    )
    rows = serving.visible(t.signals_fx).withColumn("key_points", F.array(point(0), point(1)))
    out = serving.detail_points(rows, t.links_fx, t.articles, t.sources)
    refs = F.coalesce(F.array_join(F.transform("sources", lambda s: s["source_id"]), ","), F.lit(""))
    return out.select("signal_id", "position", "text", refs.alias("sources"))


@query(
    "related_signals",
    BASE,
    f""", {CTX} SELECT v.signal_id, CAST(n AS INT) AS position, o.signal_id AS related_id, o.title AS related_title FROM vis v, (VALUES (0), (1)) x(n)
    JOIN vis o ON o.number = v.number + 1 + n""",
)
def related_signals(t):
    sid = lambda n: F.concat(F.lit("sig_"), F.lpad(n.cast("string"), 9, "0"))
    rows = serving.visible(t.signals_fx).withColumn("related_signal_ids", F.array(sid(F.col("number") + 1), sid(F.col("number") + 2)))
    return serving.related_signals(t.signals_fx, rows)


# The mix of every signal names the first three sources, with and without a name and a role of their own.
def _mixed(signals):
    given = lambda source, name, role: F.struct(F.lit(source).alias("source_id"), F.lit(name).alias("source_name"), F.lit(role).alias("role"))
    return signals.withColumn("source_mix", F.array(given("src0", "", "official"), given("src1", "Given name", ""), given("src2", None, None)))


MIX = f"""mixes AS (SELECT vis.signal_id, position, m.source_id, coalesce(nullif(m.source_name, ''), s.name) AS source_name, coalesce(nullif(m.role, ''), 'supporting') AS role, s.canonical_url AS original_url
    FROM vis CROSS JOIN (VALUES (CAST(0 AS INT), 'src0', '', 'official'), (1, 'src1', 'Given name', ''), (2, 'src2', NULL, NULL)) m(position, source_id, source_name, role)
    LEFT JOIN seen s ON s.signal_id = vis.signal_id AND s.source_id = m.source_id)"""


@query("detail_mix", BASE, f", {CTX}, {MIX} SELECT * FROM mixes")
def detail_mix(t):
    return serving.detail_mix(_mixed(serving.visible(t.signals_fx)), t.links_fx, t.articles, t.sources)


# --- one signal's page, all parts -----------------------------------------------------------


def _page_signals(t):
    """Signals with points, timeline, mix and related ids."""
    point = lambda k: F.struct(F.lit(f"point {k}").alias("text"), F.array(*[F.lit(f"src{k * 5 + i}") for i in range(4)]).alias("source_ids"))
    step = lambda k: F.struct(F.lit(f"step {k}").alias("label"), F.lit("2024-01-02").alias("at"), F.array(F.lit(f"src{k}"), F.lit(f"src{k + 7}")).alias("source_ids"))
    sid = lambda n: F.concat(F.lit("sig_"), F.lpad(n.cast("string"), 9, "0"))
    return _mixed(t.signals_fx).withColumns(
        {
            "key_points": F.array(point(0), point(1)), "timeline": F.array(step(0), step(1), step(2)),
            "related_signal_ids": F.array(sid(F.col("number") + 1), sid(F.col("number") + 2)),
        }
    )


SHOWN_PAGE = f"""one AS (SELECT * FROM vis ORDER BY {ORDER} LIMIT 1),
  points AS (SELECT 'key_points' AS part, CAST(k AS INT) AS place, 'point ' || k AS text, ['src' || (k * 5), 'src' || (k * 5 + 1), 'src' || (k * 5 + 2), 'src' || (k * 5 + 3)] AS ids FROM (VALUES (0), (1)) x(k)
    UNION ALL SELECT 'timeline', CAST(k AS INT), 'step ' || k, ['src' || k, 'src' || (k + 7)] FROM (VALUES (0), (1), (2)) x(k)),
  cited AS (SELECT part, place, text, coalesce(string_agg(s.source_id, ',' ORDER BY n) FILTER (s.source_id IS NOT NULL), '') AS sources
    FROM (SELECT part, place, text, unnest(ids) AS source_id, generate_subscripts(ids, 1) AS n FROM points) p LEFT JOIN (SELECT source_id FROM seen WHERE signal_id = (SELECT signal_id FROM one)) s USING (source_id) GROUP BY ALL)"""


@query(
    "signal_detail",
    (*BASE, "relations_fx"),
    f"""{SCORES}, {CTX.replace("seen AS", "seen AS MATERIALIZED")}, {MIX}, {SHOWN_PAGE}
    SELECT 'summary' AS part, 0 AS place, o.signal_id || ' ' || c.source_count || ' ' || c.families AS text FROM one o JOIN ctx c USING (signal_id)
    UNION ALL SELECT part, place, text || ': ' || sources FROM cited
    UNION ALL SELECT 'source_mix', position, source_id || ' ' || coalesce(source_name, '-') || ' ' || role || ' ' || coalesce(original_url, '-') FROM mixes WHERE signal_id = (SELECT signal_id FROM one)
    UNION ALL SELECT 'related', CAST(k AS INT), v.signal_id || ' ' || coalesce(v.title, '') FROM one o CROSS JOIN (VALUES (0), (1)) x(k) JOIN vis v ON v.number = o.number + 1 + k
    UNION ALL SELECT 'components', 0, component || ' ' || weight || ' ' || CAST(round(contribution * 1000) AS BIGINT) FROM components WHERE signal_id = (SELECT signal_id FROM one)
    UNION ALL SELECT 'articles', 0, l.article_id || ' ' || l.role || ' ' || a.source_id FROM links_fx l JOIN articles a USING (article_id) WHERE l.signal_id = (SELECT signal_id FROM one)
    UNION ALL SELECT 'attribution', 0, l.article_id || ' ' || coalesce(a.canonical_url, '-') FROM links_fx l JOIN articles a USING (article_id) WHERE l.signal_id = (SELECT signal_id FROM one)
    UNION ALL SELECT 'topics', 0, topic_slug || ' ' || topic_name FROM shown WHERE signal_id = (SELECT signal_id FROM one)""",
)
def signal_detail(t):
    """The whole page of the best signal, one row per thing on it."""
    from .scoring import _context as _score_context

    signals = _page_signals(t)
    best = serving.ranked_visible(signals).select("signal_id").first()
    components = scoring.score_components(_score_context(t))
    page = serving.signal_detail(signals, t.links_fx, t.articles, t.sources, t.signal_topics_fx, topics.topics_dim(t.spark), components, best.signal_id if best else "")
    zero, j = F.lit(0).alias("place"), lambda *c: F.concat_ws(" ", *c).alias("text")
    refs = F.coalesce(F.array_join(F.transform("sources", lambda s: s["source_id"]), ","), F.lit(""))
    or_dash = lambda c: F.coalesce(c, F.lit("-"))
    shown = {
        "summary": lambda p: p.select(zero, j("signal_id", F.col("source_count").cast("string"), F.array_join("source_families", ","))),
        "key_points": lambda p: p.select(F.col("position").alias("place"), F.concat("text", F.lit(": "), refs).alias("text")),
        "timeline": lambda p: p.select(F.col("position").alias("place"), F.concat("label", F.lit(": "), refs).alias("text")),
        "source_mix": lambda p: p.select(F.col("position").alias("place"), j("source_id", or_dash("source_name"), "role", or_dash("original_url"))),
        "related": lambda p: p.select(F.col("position").alias("place"), F.concat("related_id", F.lit(" "), F.coalesce("related_title", F.lit(""))).alias("text")),
        "components": lambda p: p.select(zero, j("component", F.col("weight").cast("string"), F.round(F.col("contribution") * 1000).cast("long").cast("string"))),
        "articles": lambda p: p.select(zero, j("article_id", "role", "source_id")),
        "attribution": lambda p: p.select(zero, j("article_id", or_dash("url"))),
        "topics": lambda p: p.select(zero, j("topic_slug", "topic_name")),
    }
    out = None
    for name, rows in page.items():
        part = shown[name](rows).select(F.lit(name).alias("part"), "place", "text")
        out = part if out is None else out.unionByName(part)
    return out


# One status row per minute-of-day bucket of the event table.
STATUS = """status AS (SELECT CAST(epoch_ms(date_trunc('hour', ts)) / 3600000 AS BIGINT) AS run, count(*) FILTER (event_type = 'view') AS succeeded, count(*) FILTER (event_type = 'error' AND value > 20) AS failed,
    count(*) FILTER (event_type = 'signup' AND value > 20) AS skipped, count(*) FILTER (event_type = 'purchase' AND value > 10) AS visible_count, max(ts) AS last_ts FROM events GROUP BY 1),
  runs AS (SELECT *, CASE run % 6 WHEN 0 THEN 'demo' WHEN 1 THEN 'other' ELSE 'live' END AS mode, CASE WHEN run % 17 = 0 THEN 'loading' END AS state, run % 5 = 0 AS stale FROM status)"""


@query(
    "data_state",
    ("records_fx",),
    f""", {STATUS} SELECT run, CASE WHEN state IS NOT NULL THEN state WHEN mode = 'demo' THEN 'demo' WHEN mode <> 'live' THEN 'unknown' WHEN stale THEN 'stale_live'
      WHEN visible_count = 0 THEN 'empty_live' WHEN succeeded > 0 AND (failed > 0 OR skipped > 0) THEN 'partial_live' ELSE 'live' END AS data_state, visible_count = 0 AS is_empty FROM runs""",
)
def data_state(t):
    e = t.events
    n = lambda kind, floor: F.count_if((F.col("event_type") == kind) & (F.col("value") > floor))
    runs = e.groupBy((F.unix_millis(F.date_trunc("hour", "ts").cast("timestamp")) / 3600000).cast("long").alias("run")).agg(
        n("view", -1e9).alias("succeeded"), n("error", 20).alias("failed"), n("signup", 20).alias("skipped"),
        n("purchase", 10).alias("visible_count"), F.max("ts").alias("last_live_fetch_at"),
    )
    rows = runs.select(
        "*", F.when(F.col("run") % 6 == 0, "demo").when(F.col("run") % 6 == 1, "other").otherwise("live").alias("mode"),
        F.when(F.col("run") % 17 == 0, "loading").alias("state"), (F.col("run") % 5 == 0).alias("stale"),
        F.lit(None).cast("timestamp").alias("completed_at"),
    )
    return serving.data_state(rows).select("run", "data_state", "is_empty")


@query("public_source", BASE, " SELECT source_id, name, source_type, family, enabled, trust_score, language FROM sources")
def public_source(t):
    return serving.public_source(t.sources)


@query(
    "public_article",
    BASE,
    " SELECT article_id, source_id, title, excerpt, author, language, published_at, canonical_url AS original_url, coalesce(full_text_display_allowed, false) AS full_text_display_allowed FROM articles",
)
def public_article(t):
    return serving.public_article(t.articles)
