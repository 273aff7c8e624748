"""Enrichment tables over the fixed signals."""

from pyspark.sql import functions as F

from storyloom.operators import enrich

from .registry import clean, query
from .serving import _points

BASE = ("articles", "sources", "signals_fx", "links_fx")


def _clip(e, n):
    return f"(CASE WHEN length({clean(e)}) <= {n} THEN {clean(e)} ELSE trim(substr({clean(e)}, 1, {n - 3})) || '...' END)"


ROLE = "CASE family WHEN 'company_announcement' THEN 'official' WHEN 'research' THEN 'research' WHEN 'community' THEN 'community' WHEN 'product_launch' THEN 'product' ELSE 'media' END"
CTX = f"""ctx AS (SELECT l.signal_id, l.role, a.article_id, a.source_id, s.name AS source_name, s.family, {ROLE} AS source_role, a.title, coalesce({_clip('a.excerpt', 700)}, '') AS excerpt,
    coalesce({_clip('a.text_for_ai', 4500)}, '') AS text_for_ai, a.text_for_ai AS full_text, a.published_at, row_number() OVER (PARTITION BY l.signal_id ORDER BY coalesce(a.published_at, a.created_at), a.article_id) AS turn
  FROM links_fx l JOIN articles a ON a.article_id = l.article_id JOIN sources s ON s.source_id = a.source_id)"""


@query("enrichment_context", BASE, f", {CTX} SELECT signal_id, article_id, role, source_name, source_role, excerpt, sha256(text_for_ai) AS text_hash FROM ctx")
def enrichment_context(t):
    c = enrich.enrichment_context(t.signals_fx, t.links_fx, t.articles, t.sources)
    return c.select("signal_id", "article_id", "role", "source_name", "source_role", "excerpt", F.sha2("text_for_ai", 256).alias("text_hash"))


@query(
    "member_mix",
    BASE,
    f", {CTX} SELECT c.signal_id, c.article_id, c.source_id, source_name, s.source_type, c.family, c.role, a.canonical_url AS url, c.title, c.published_at FROM ctx c JOIN articles a USING (article_id) JOIN sources s ON s.source_id = c.source_id",
)
def member_mix(t):
    mix = enrich.member_mix(enrich.enrichment_context(t.signals_fx, t.links_fx, t.articles, t.sources))
    return mix.drop("place").withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("pending_enrichment", BASE, " SELECT signal_id FROM signals_fx WHERE enrichment_status = 'pending'")
def pending_enrichment(t):
    return enrich.pending_enrichment(t.signals_fx).select("signal_id")


@query(
    "pending_with_retry",
    BASE,
    """ SELECT signal_id FROM signals_fx WHERE (enrichment_status IN ('pending', 'fallback') OR (enrichment_status = 'failed' AND fallback_generated AND error_category = 'enrichment_validation_failed'))
    AND signal_id IN (SELECT signal_id FROM links_fx l JOIN articles a ON a.article_id = l.article_id WHERE a.published_at > TIMESTAMP '2024-01-20 00:00:00')""",
)
def pending_with_retry(t):
    """Waiting signals among those with an article published after a cursor."""
    new = t.articles.filter("published_at > TIMESTAMP_NTZ '2024-01-20 00:00:00'").select("article_id")
    ids = t.links_fx.join(new, "article_id", "left_semi").select("signal_id").distinct()
    return enrich.pending_enrichment(t.signals_fx, True, ids).select("signal_id")


# Articles get a marker sentence by number, so that terms, claims and names occur.
MARKERS = [
    "", "开源 GitHub SenseNova-U1 与 NEO-unify 统一表征空间", "企业 Agent 与 MoE 混合专家 foo-bar-baz", "机器人 benchmark Qwen-7B-Chat Qwen-7B-Base", "视觉推理 图像生成 AICon", "", "权限控制",
]


def _marked(t):
    n = F.substring("article_id", 5, 20).cast("long") % len(MARKERS)
    text = F.lit("")
    for i, m in enumerate(MARKERS):
        text = F.when(n == i, m).otherwise(text)
    return t.articles.withColumn("text_for_ai", F.concat_ws(" ", "text_for_ai", text))


MARK = "marked AS (SELECT *, text_for_ai || ' ' || (CASE CAST(substr(article_id, 5) AS BIGINT) % 7 " + " ".join(
    f"WHEN {i} THEN '{m}'" for i, m in enumerate(MARKERS)
) + " END) AS marked_text FROM articles)"
_T = ", ".join(f"'{x}'" for x in enrich.TERMS)


def _any(needles):
    return "(" + " OR ".join(f"contains(txt, '{x}')" for x in needles) + ")"


TERMS = f"""{MARK}, alltext AS (SELECT s.signal_id, string_agg(m.marked_text, ' ' ORDER BY coalesce(m.published_at, m.created_at), m.article_id) AS body,
    arg_min(m.excerpt, (coalesce(m.published_at, m.created_at), m.article_id)) AS excerpt, any_value(s.title) AS title
    FROM signals_fx s JOIN links_fx l ON l.signal_id = s.signal_id JOIN marked m ON m.article_id = l.article_id GROUP BY s.signal_id),
  texts AS (SELECT signal_id, {clean("concat_ws(' ', title, excerpt, body)")} AS txt FROM alltext),
  named AS (SELECT *, list_distinct([]::VARCHAR[]) AS none, list_filter([{_T}], lambda x: contains(txt, x)) AS terms,
    list_concat(list_concat(regexp_extract_all(txt, '\\bSenseNova[-\\s]?[A-Za-z0-9.-]+\\b'), regexp_extract_all(txt, '(?i)\\bNEO[-\\s]?unify\\b')),
      regexp_extract_all(txt, '\\b[A-Za-z]+-[A-Za-z0-9]+(?:-[A-Za-z0-9]+){{1,3}}\\b')) AS hits FROM texts),
  uniq AS (SELECT *, list_filter(hits, lambda x, i: list_position(hits, x) = i)[1:6] AS model_names FROM named),
  claimed AS (SELECT *, list_filter([{', '.join(
      "CASE WHEN " + (_any(needles) if i != enrich.UNIFY_CLAIM else f"({_any(needles)} OR regexp_matches(txt, '(?i)NEO[-\\s]?unify'))") + " THEN " +
      (f"(CASE WHEN len(list_filter(model_names, lambda m: NOT regexp_matches(m, '(?i)NEO[-\\s]?unify'))) > 0 THEN array_to_string(list_filter(model_names, lambda m: NOT regexp_matches(m, '(?i)NEO[-\\s]?unify'))[1:3], '、') || '{text.replace('{targets}', '')}' ELSE '{enrich.NO_TARGET_CLAIM}' END)" if '{targets}' in text
       else f"(coalesce(list_filter(model_names, lambda m: regexp_matches(m, '(?i)SenseNova'))[1], model_names[1], '{enrich.DEFAULT_MODEL}') || '{text.replace('{model}', '')}')" if '{model}' in text else f"'{text}'") + " END"
      for i, (needles, text) in enumerate(enrich.CLAIMS))}], lambda x: x IS NOT NULL)[1:6] AS raw_claims FROM uniq),
  extracted AS (SELECT signal_id, terms, model_names, CASE WHEN len(raw_claims) = 0 AND len(terms) > 0 THEN ['{enrich.ONLY_TERMS}' || array_to_string(terms[1:5], '、')] ELSE raw_claims END AS claims FROM claimed)"""


def _extracted(t):
    return enrich.extract_terms_claims(t.signals_fx, t.links_fx, _marked(t))


@query(
    "extract_terms_claims",
    BASE,
    f", {TERMS} SELECT signal_id, coalesce(array_to_string(terms, '|'), '') AS terms, coalesce(array_to_string(model_names, '|'), '') AS model_names, coalesce(array_to_string(claims, '|'), '') AS claims FROM extracted",
)
def extract_terms_claims(t):
    j = lambda c: F.array_join(c, "|").alias(c)
    return _extracted(t).select("signal_id", j("terms"), j("model_names"), j("claims"))


@query("source_role", BASE, f" SELECT source_id, {ROLE} AS role FROM sources")
def source_role(t):
    return t.sources.select("source_id", enrich.source_role(F.col("family")).alias("role"))


def _fallback(t):
    context = enrich.enrichment_context(t.signals_fx, t.links_fx, _marked(t), t.sources)
    return enrich.fallback_outputs(t.signals_fx, context, _extracted(t))


E_ = enrich


def _strip(e):
    return f"regexp_replace(coalesce({clean(e)}, ''), '[。.!?！？；;]+$', '')"


FALL = f"""{CTX}, {TERMS}, lead AS (SELECT c.*, s.title AS signal_title FROM ctx c JOIN signals_fx s USING (signal_id) WHERE turn = 1),
  names AS (SELECT signal_id, string_agg(source_name, '、' ORDER BY turn) AS names FROM ctx WHERE turn <= 3 GROUP BY signal_id),
  facts AS (SELECT l.signal_id, l.source_id, l.source_name, names, {clean("coalesce(nullif(l.signal_title, ''), l.title)")} AS subject, coalesce({clean('l.excerpt')}, names || '{E_.NO_EXCERPT}') AS line,
    array_to_string(terms[1:5], '、') AS few, terms, claims FROM lead l JOIN names USING (signal_id) JOIN extracted USING (signal_id)),
  watch AS (SELECT *, CASE WHEN len(claims) > 0 THEN '{E_.WATCH_CLAIMS[0]}' || coalesce(nullif(few, ''), array_to_string(claims[1:2], '、')) || '{E_.WATCH_CLAIMS[1]}'
    WHEN len(terms) > 0 THEN '{E_.WATCH_TERMS[0]}' || few || '{E_.WATCH_TERMS[1]}' ELSE '{E_.WATCH_PLAIN}' END AS next_watch,
    list_filter(list_concat(list_concat([source_name || ' 报道了' || {_clip('subject', 70)} || '。'], list_transform(claims[1:3], lambda c: CASE WHEN regexp_matches(c, '[。.!?！？]$') THEN c ELSE c || '。' END)),
      [CASE WHEN len(claims) = 0 THEN CASE WHEN regexp_matches(line, '[一-鿿]') THEN {_clip('line', 96)} ELSE '来源摘要提到：' || {_clip('line', 82)} END END,
       CASE WHEN len(claims) < 2 AND len(terms) > 0 THEN '后续可重点核对' || few || '的实际进展。' END]), lambda x: x IS NOT NULL) AS points FROM facts)"""


@query(
    "fallback_points",
    BASE,
    f""", {FALL} SELECT signal_id, array_to_string(points, '|') AS points, source_id, next_watch FROM watch""",
)
def fallback_points(t):
    f = _fallback(t)
    return f.select(
        "signal_id", F.array_join(F.transform("key_points", lambda p: p["text"]), "|").alias("points"),
        F.element_at("key_points", 1)["source_ids"][0].alias("source_id"), "next_watch",
    )


@query(
    "fallback_timeline",
    BASE,
    f", {CTX} SELECT signal_id, CAST(turn - 1 AS INT) AS position, source_name || ' 发布了这条相关资讯。' AS label, strftime(published_at, '%Y-%m-%dT%H:%M:%S.000Z') AS at_text, source_id FROM ctx WHERE turn <= 4",
)
def fallback_timeline(t):
    rows = _fallback(t).select("signal_id", F.posexplode("timeline").alias("position", "e"))
    return rows.select("signal_id", "position", F.col("e.label").alias("label"), F.col("e.at").alias("at_text"), F.col("e.source_ids")[0].alias("source_id"))


def _cjk(e):
    return f"length(regexp_replace({e}, '[^一-鿿]', '', 'g'))"


@query(
    "fallback_brief",
    BASE,
    f""", {FALL}, briefs AS (SELECT signal_id, {clean(f"'这条资讯聚焦' || {_clip('subject', 62)} || '。来源摘要显示，' || {_strip(_clip('line', 78))} || '。' || CASE WHEN len(claims) > 0 THEN '{E_.BRIEF_CLAIMS[0]}' || array_to_string(list_transform(claims[1:4], lambda c: regexp_replace(c, '[。.!?！？；;]+$', '')), '；') || '。' WHEN len(terms) > 0 THEN '{E_.BRIEF_TERMS[0]}' || few || '{E_.BRIEF_TERMS[1]}' ELSE '{E_.BRIEF_PLAIN}' END")} AS b FROM watch),
    padded AS (SELECT signal_id, b || repeat('{E_.PADDING}', CAST(greatest(0, ceil((100 - {_cjk('b')}) / {float(E_._PADDING_CJK)})) AS INT)) AS b FROM briefs)
    SELECT signal_id, CASE WHEN length(b) <= 280 THEN b WHEN length(regexp_extract(substr(b, 1, 279), '(?s)^(.*[。！？])', 1)) - 1 >= 173 THEN regexp_extract(substr(b, 1, 279), '(?s)^(.*[。！？])', 1)
      ELSE regexp_replace(substr(b, 1, 279), '[，。、；：\\s]+$', '') || '。' END AS ai_brief FROM padded""",
)
def fallback_brief(t):
    return _fallback(t).select("signal_id", "ai_brief")


# Model answers by signal number: sound, fenced, without points, unknown source, too long, broken.
def _answers(t):
    n = F.col("number")
    lead = t.links_fx.filter("role = 'lead'").join(t.articles.select("article_id", "source_id"), "article_id").select("signal_id", "source_id")
    rows = t.signals_fx.select("signal_id", "number").join(lead, "signal_id")
    brief = F.concat(F.repeat(F.lit("这条消息说明了模型的进展"), 10), n.cast("string"))
    source = F.when(n % 6 == 3, "src99").otherwise(F.col("source_id"))
    ids = F.array(source).alias("sourceIds")
    point = lambda text: F.struct(F.lit(text).alias("text"), ids)
    body = F.to_json(
        F.struct(
            F.when(n % 12 == 0, "短").otherwise(brief).alias("aiBrief"),
            F.when(n % 6 != 2, F.array(point("要点一。"), point("要点二"))).alias("keyPoints"),
            F.array(F.struct(F.lit("发布").alias("label"), F.lit("2024-01-01").alias("at"), ids)).alias("timeline"),
            F.array(F.struct(source.alias("sourceId"), F.lit("名").alias("sourceName"))).alias("sourceMix"),
            F.when(n % 6 == 4, F.repeat(F.lit("关注后续"), 40)).otherwise("继续关注").alias("nextWatch"),
        )
    )
    content = (
        F.when(n % 6 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(n % 6 == 5, F.when(n % 12 == 5, "no object").otherwise(F.concat(F.lit("text {bad "), body)))
        .when(n % 6 == 2, F.concat(F.lit("Here: "), body, F.lit(" done")))
        .otherwise(body)
    )
    return rows.select("signal_id", content.alias("content"))


@query(
    "parse_outputs",
    BASE,
    """ SELECT signal_id, CASE WHEN number % 12 = 5 THEN 'no_json_object' WHEN number % 6 = 5 THEN 'invalid_json' END AS parse_error,
    CASE WHEN number % 6 = 5 THEN NULL WHEN number % 12 = 0 THEN '短' ELSE repeat('这条消息说明了模型的进展', 10) || number END AS ai_brief, CASE WHEN number % 6 IN (2, 5) THEN 0 ELSE 2 END AS n_points FROM signals_fx""",
)
def parse_outputs(t):
    p = enrich.parse_outputs(_answers(t))
    return p.select("signal_id", "parse_error", "ai_brief", F.size("key_points").alias("n_points"))


VALID = """CASE WHEN number % 6 = 5 THEN 'User-facing enrichment text must use Simplified Chinese|AI brief is too short|Key points must include 1 to 6 items|Source mix is required for attribution|Next-watch text must use Simplified Chinese'
  ELSE concat_ws('|', CASE WHEN number % 12 = 0 THEN 'AI brief is too short' END, CASE WHEN number % 6 = 2 THEN 'Key points must include 1 to 6 items' END,
    CASE WHEN number % 6 = 4 THEN 'Next-watch text is too long' END, CASE WHEN number % 6 = 3 THEN 'Key points require valid source references|Timeline items require valid source references|Source mix includes unknown source references' END) END"""


@query("validate_outputs", BASE, f" SELECT signal_id, {VALID} AS errors FROM signals_fx")
def validate_outputs(t):
    context = enrich.enrichment_context(t.signals_fx, t.links_fx, t.articles, t.sources)
    v = enrich.validate_outputs(enrich.parse_outputs(_answers(t)), enrich.signal_facts(context))
    return v.select("signal_id", F.array_join("errors", "|").alias("errors"))


def _repaired(t):
    return enrich.repair_outputs(enrich.parse_outputs(_answers(t)), _fallback(t), t.signals_fx)


@query(
    "repair_outputs",
    BASE,
    f""", {FALL} SELECT s.signal_id, CASE WHEN number % 6 IN (2, 3, 5) THEN array_to_string(points, '|') ELSE '要点一。|要点二' END AS points,
    CASE WHEN number % 6 = 5 THEN w.next_watch WHEN number % 6 = 4 THEN substr(repeat('关注后续', 40), 1, 139) || '。' ELSE '继续关注' END AS next_watch,
    CASE WHEN number % 6 <> 5 AND number % 12 <> 0 THEN repeat('这条消息说明了模型的进展', 10) || number ELSE 'rebuilt' END AS ai_brief FROM signals_fx s JOIN watch w USING (signal_id)""",
)
def repair_outputs(t):
    """Rebuilt briefs are checked by the test suite; here only that they replaced the short ones."""
    given = F.col("number")
    rows = _repaired(t).join(t.signals_fx.select("signal_id", "number"), "signal_id")
    rebuilt = (given % 6 == 5) | (given % 12 == 0)
    return rows.select(
        "signal_id", F.array_join(F.transform("key_points", lambda p: p["text"]), "|").alias("points"), "next_watch",
        F.when(rebuilt & (enrich.cjk_count("ai_brief") >= 100) & (F.length("ai_brief") <= 280), "rebuilt").otherwise(F.col("ai_brief")).alias("ai_brief"),
    )


@query(
    "apply_enrichment",
    BASE,
    """ SELECT signal_id, CASE WHEN enrichment_status = 'pending' AND number % 6 = 5 THEN 'failed' WHEN enrichment_status = 'pending' THEN 'completed' ELSE enrichment_status END AS enrichment_status,
    CASE WHEN enrichment_status = 'pending' AND number % 6 = 5 THEN CASE WHEN number % 12 = 5 THEN 'no_json_object' ELSE 'invalid_json' END END AS enrichment_error,
    CASE WHEN enrichment_status = 'pending' THEN 2 ELSE enrichment_version END AS enrichment_version FROM signals_fx""",
)
def apply_enrichment(t):
    from storyloom.operators.lineage import cut

    pending = enrich.pending_enrichment(t.signals_fx)
    context = enrich.enrichment_context(pending, t.links_fx, t.articles, t.sources)
    fallback = cut(enrich.fallback_outputs(pending, context, enrich.extract_terms_claims(pending, t.links_fx, t.articles)))
    parsed = enrich.parse_outputs(_answers(t))
    repaired = enrich.repair_outputs(parsed, fallback, pending)
    checked = enrich.validate_outputs(repaired, fallback)
    results = enrich.enrichment_results(pending, fallback, checked, "table")
    return enrich.apply_enrichment(t.signals_fx, results, "table").select("signal_id", "enrichment_status", "enrichment_error", "enrichment_version")


@query(
    "enrichment_bookkeeping",
    BASE,
    f""", {CTX}, counted AS (SELECT signal_id, count(*) AS n FROM ctx GROUP BY signal_id)
    SELECT signal_id, CASE WHEN NOT failed THEN TIMESTAMP '2024-02-01 10:00:00' END AS generated_at, CASE WHEN failed THEN TIMESTAMP '2024-02-01 10:00:00' END AS failed_at,
      CASE WHEN NOT failed THEN CAST(coalesce(n, 0) AS INT) END AS source_count, TIMESTAMP '2024-02-01 10:00:00' AS updated_at
    FROM (SELECT s.*, number % 6 = 5 AS failed FROM signals_fx s WHERE enrichment_status = 'pending') p LEFT JOIN counted USING (signal_id)
    UNION ALL SELECT signal_id, NULL, NULL, NULL, updated_at FROM signals_fx WHERE enrichment_status <> 'pending'""",
)
def enrichment_bookkeeping(t):
    """When and from how many members texts were made; signals that were not asked keep their dates."""
    from storyloom.operators.lineage import cut

    pending = enrich.pending_enrichment(t.signals_fx)
    context = enrich.enrichment_context(pending, t.links_fx, t.articles, t.sources)
    fallback = cut(enrich.fallback_outputs(pending, context, enrich.extract_terms_claims(pending, t.links_fx, t.articles)))
    checked = enrich.validate_outputs(enrich.repair_outputs(enrich.parse_outputs(_answers(t)), fallback, pending), fallback)
    results = enrich.enrichment_results(pending, fallback, checked, "table")
    out = enrich.apply_enrichment(t.signals_fx, results, "table", "2024-02-01 10:00:00", enrich.member_counts(context))
    at = lambda c, name: F.col(c).cast("timestamp_ntz").alias(name)
    return out.select(
        "signal_id", at("enrichment_generated_at", "generated_at"), at("enrichment_failed_at", "failed_at"),
        F.col("enrichment_source_count").alias("source_count"), at("updated_at", "updated_at"),
    )


STALE = """flagged AS (SELECT *, CASE number % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS n_points,
    concat_ws(' ', nullif(summary, ''), nullif(ai_brief, ''), CASE WHEN number % 4 = 0 THEN '提供了该信号的基础来源信息' END) AS txt FROM signals_fx),
  staled AS (SELECT *, enrichment_status NOT IN ('pending', 'processing') AND (enrichment_version < 2 OR contains(txt, '基础来源信息') OR contains(txt, 'AI 精炼暂不可用') OR contains(txt, '提供了与该信号相关')
    OR (enrichment_status = 'completed' AND (length(trim(coalesce(ai_brief, ''))) < 80 OR n_points < 2))) AS stale FROM flagged),
  scored AS (SELECT *, coalesce(nullif(signal_score, 0), nullif(heat_score, 0), 0) AS score, coalesce(primary_published_at, updated_at, created_at) AS pub FROM staled)"""


@query("stale_enrichment", BASE, f", {STALE} SELECT signal_id FROM staled WHERE stale")
def stale_enrichment(t):
    return enrich.stale_enrichment(_points(t.signals_fx)).select("signal_id")


CAND = f"{STALE}, cand AS (SELECT * FROM scored WHERE (stale OR enrichment_status IN ('pending', 'failed', 'fallback')) AND pub >= TIMESTAMP '2024-01-04' ORDER BY score DESC, pub DESC, signal_id LIMIT 25)"


@query("backfill_candidates", BASE, f", {CAND} SELECT signal_id, stale, enrichment_status FROM cand")
def backfill_candidates(t):
    return enrich.backfill_candidates(_points(t.signals_fx), published_after="2024-01-04 00:00:00").select("signal_id", "stale", "enrichment_status")


@query("backfill_stale_only", BASE, f", {STALE} SELECT signal_id FROM scored WHERE stale AND enrichment_status IN ('completed', 'failed')")
def backfill_stale_only(t):
    return enrich.backfill_candidates(_points(t.signals_fx), None, True, ["completed", "failed"]).select("signal_id")


@query(
    "mark_backfill",
    BASE,
    f""", {CAND} SELECT s.signal_id, CASE WHEN c.signal_id IS NOT NULL THEN 'pending' ELSE s.enrichment_status END AS enrichment_status,
    CASE WHEN c.signal_id IS NOT NULL AND s.enrichment_status <> 'pending' THEN CASE WHEN c.stale THEN 'stale_enrichment' WHEN s.enrichment_status = 'failed' THEN 'failed_enrichment_retry' ELSE 'fallback_enrichment_retry' END END AS backfill_reason,
    CASE WHEN c.signal_id IS NOT NULL AND s.enrichment_status <> 'pending' THEN s.enrichment_status END AS previous_status FROM signals_fx s LEFT JOIN cand c ON c.signal_id = s.signal_id""",
)
def mark_backfill(t):
    rows = _points(t.signals_fx)
    marked = enrich.mark_backfill(rows, enrich.backfill_candidates(rows, published_after="2024-01-04 00:00:00"))
    return marked.select("signal_id", "enrichment_status", "backfill_reason", "previous_status")
