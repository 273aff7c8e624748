"""Enrichment as table jobs: context, fallback text, output checks and repair, status, backfill.

Generating text is left to an outside model; its answers arrive as a table.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (
    SPACE, ascii_word, cjk_count, clean_text, clip, clip_visible, contains_any, has_cjk, strip_terminal, visible_length,
    with_terminal, word_count,
)
from ..functions.times import millis, order_key, ts_lit

VERSION = 2
EXCERPT_LIMIT, TEXT_LIMIT = 700, 4500
TIMELINE_SIZE, NAME_COUNT, MAX_CLAIMS, MAX_NAMES = 4, 3, 6, 6

# Role shown for a source family.
ROLES = {"company_announcement": "official", "research": "research", "community": "community", "product_launch": "product"}
DEFAULT_ROLE = "media"

# Terms looked for in the texts of a signal.
TERMS = [
    "企业 Agent", "自动化行动架构", "AICon", "WinNexO", "数据到行动", "多模态数据集成", "语义模型", "Agent Runtime", "权限控制",
    "行业实践", "工程挑战", "数据与记忆", "安全可信", "落地保障", "大模型推理", "智算架构", "SenseNova U1", "NEO-unify",
    "统一表征空间", "多模态理解", "视觉推理", "图像生成", "连续性图文创作", "开源 SOTA", "GitHub", "Hugging Face",
]
# Needles of each claim, the claim text; {targets} and {model} are filled in.
CLAIMS = [
    (["开源", "GitHub", "Hugging Face"], "{targets} 已开放开源资料或部署入口"),
    (["统一表征空间", "单一模型架构", "原生统一"], "{model} 以统一表征空间整合多模态理解、推理与生成，重点在减少传统拼接式多模型链路的转换损耗"),
    (["视觉编码器", "变分自编码器", "VAE", "VE"], "报道强调该架构弱化对视觉编码器或 VAE 等独立模块拼接的依赖，试图把图像和语言放入同一套表示中处理"),
    (["8B-MoT", "A3B-MoT", "MoE", "稠密骨干网络", "混合专家"], "本次轻量版包含稠密骨干与混合专家等不同规格，便于开发者按算力和场景选择"),
    (["SOTA", "基准测试", "benchmark", "Benchmark", "图像理解", "视觉推理", "商业闭源模型"], "来源称它在图像理解、图像生成、视觉推理等测试中对标同量级开源 SOTA，并强调推理效率"),
    (["连续性图文创作", "图文交错", "单次单模型调用", "共享上下文"], "一个重点应用方向是连续性图文创作输出，用单模型调用保持文本与图像内容的一致上下文"),
    (["机器人", "具身大脑", "复杂环境感知", "任务执行"], "报道还把该路线延伸到机器人感知、逻辑推演和任务执行等具身智能场景"),
]
UNIFY = f"(?i)NEO(?:-|{SPACE})?unify"
UNIFY_CLAIM = 1
NO_TARGET_CLAIM = "来源提到项目已开放开源资料或部署入口"
DEFAULT_MODEL = "相关模型"
ONLY_TERMS = "主题线索集中在"
MODEL_NAMES = [
    ascii_word(f"SenseNova(?:-|{SPACE})?[A-Za-z0-9.-]+"),
    "(?i)" + ascii_word(f"NEO(?:-|{SPACE})?unify"),
    ascii_word("[A-Za-z]+-[A-Za-z0-9]+(?:-[A-Za-z0-9]+){1,3}"),
]
# Wording of generated text.
NO_NAMES = "已登记来源"
NO_SOURCE_NAME = "未知来源"
NO_TITLE = "这条资讯"
NO_EXCERPT = " 已提供标题、发布时间和来源归因。"
WATCH_CLAIMS = ("继续核对", "的官方说明、开源资料、实测反馈和更多独立来源。")
WATCH_TERMS = ("继续关注", "的官方说明、落地案例和更多来源确认。")
WATCH_PLAIN = "继续关注官方更新、独立报道和更多来源确认。"
WATCH_NOTHING = "继续关注后续来源确认和更新时间。"
BRIEF_CLAIMS = ("可确认的关键信息包括：", "。")
BRIEF_TERMS = ("可提取的主题线索包括", "，这些信息能帮助判断它更偏向会议议程、企业采用、技术架构还是产品落地。")
BRIEF_PLAIN = "目前可提取的主题线索仍有限，需要结合后续来源判断它对产品发布、企业采用、技术路线或行业竞争的影响。"
PADDING = " 目前信息仍以来源标题、发布时间、来源类型和后续交叉验证为准，建议关注是否出现更多独立来源、官方补充、用户反馈和可执行的产品变化。"
SEED_MISSING = " 当前已有基础来源支撑。"
NO_POINT = ("这条信号目前由", "提供支撑，核心线索集中在“", "”及相关来源标题。")
NO_WATCH = "后续应继续核对官方说明、独立报道、研究或社区反馈，判断它对产品发布、企业采用、技术路线或行业竞争格局的实际影响。"
LAST_RESORT = (
    "。这条资讯已完成来源归因整理", "，并保留 ", " 等来源的归因", "。",
    "当前可确认的是：系统记录了原始链接、发布时间、来源类型和标题证据，页面展示处理后的摘要、要点和可公开字段。",
    "后续需要继续观察官方说明、独立报道、研究或社区反馈是否增加，以判断它对产品发布、企业采用、技术路线或行业竞争格局的实际影响。",
)
STALE_PATTERNS = ["基础来源信息", "来源归因显示", "页面只展示", "AI 精炼暂不可用", "提供了与该信号相关"]

_PADDING_CJK = sum("一" <= ch <= "鿿" for ch in PADDING)
_POINT = "STRUCT<text: STRING, source_ids: ARRAY<STRING>>"


def source_role(family: Column) -> Column:
    out = F.lit(DEFAULT_ROLE)
    for name, role in ROLES.items():
        out = F.when(family == name, role).otherwise(out)
    return out


# --- context -------------------------------------------------------------------


def enrichment_context(signals: DataFrame, links: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per (signal, member article) with source facts and clipped texts, ``place`` = article order."""
    texts = articles.withColumns({"c_excerpt": clean_text("excerpt"), "c_text": clean_text("text_for_ai")})
    facts = texts.select(
        "article_id", "source_id", "title", "canonical_url", "published_at",
        F.coalesce(clip("c_excerpt", EXCERPT_LIMIT, cleaned=True), F.lit("")).alias("excerpt"),
        F.coalesce(clip("c_text", TEXT_LIMIT, cleaned=True), F.lit("")).alias("text_for_ai"),
        F.coalesce("full_text_display_allowed", F.lit(False)).alias("full_text_display_allowed"),
        order_key().alias("place"),
    )
    dims = sources.select("source_id", F.col("name").alias("source_name"), "source_type", "family", source_role(F.col("family")).alias("source_role"))
    return (
        signals.select("signal_id").join(links.select("signal_id", "article_id", "role"), "signal_id")
        .join(facts, "article_id")
        .join(dims, "source_id")
    )


def member_mix(context: DataFrame) -> DataFrame:
    """Source mix as a model is shown it: one row per member article with its source, role, URL, title and date."""
    return context.select(
        "signal_id", "article_id", "place", "source_id", "source_name", "source_type", "family", "role",
        F.col("canonical_url").alias("url"), "title", "published_at",
    )


def member_counts(context: DataFrame) -> DataFrame:
    """(signal_id, member_count): member articles with a known source."""
    return context.groupBy("signal_id").agg(F.count("*").cast("int").alias("member_count"))


def pending_enrichment(signals: DataFrame, retry: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """Signals waiting for text; ``retry`` adds fallbacks and failed validations that got fallback text."""
    status = F.col("enrichment_status")
    again = (status == "fallback") | (
        (status == "failed") & F.coalesce("fallback_generated", F.lit(False)) & (F.col("error_category") == "enrichment_validation_failed")
    )
    rows = signals.filter((status == "pending") | (F.coalesce(again, F.lit(False)) if retry else F.lit(False)))
    return rows if ids is None else rows.join(ids.select("signal_id"), "signal_id", "left_semi")


def _has(text: Column, needle: str) -> Column:
    """Whether the text has the needle, any white space standing for a space; cheap tests first."""
    parts = needle.split(" ")
    if len(parts) == 1:
        return text.contains(needle)
    both = text.contains(parts[0])
    for p in parts[1:]:
        both = both & text.contains(p)
    return both & text.rlike(SPACE.join(parts))


def _bits(text: Column) -> Column:
    tests = [_has(text, t) for t in TERMS]
    for i, (needles, _) in enumerate(CLAIMS):
        hit = _has(text, needles[0])
        for n in needles[1:]:
            hit = hit | _has(text, n)
        if i == UNIFY_CLAIM:
            hit = hit | (F.lower(text).contains("unify") & text.rlike(UNIFY))
        tests.append(hit)
    mask = F.lit(0).cast("long")
    for i, test in enumerate(tests):
        mask = mask + F.when(test, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return mask


def _texts(signals: DataFrame, links: DataFrame, articles: DataFrame) -> DataFrame:
    """(signal_id, place, text): the signal's title, its first article's excerpt, every member text."""
    body = articles.select("article_id", "excerpt", "text_for_ai", order_key().alias("place"))
    members = signals.select("signal_id").join(links.select("signal_id", "article_id"), "signal_id").join(body, "article_id")
    first = members.groupBy("signal_id").agg(F.min_by("excerpt", "place").alias("text"))
    return (
        signals.select("signal_id", F.lit("0").alias("place"), F.col("title").alias("text"))
        .unionByName(first.select("signal_id", F.lit("1").alias("place"), "text"))
        .unionByName(members.select("signal_id", F.concat(F.lit("2"), "place").alias("place"), F.col("text_for_ai").alias("text")))
        .filter("text IS NOT NULL")
    )


def extract_terms_claims(signals: DataFrame, links: DataFrame, articles: DataFrame) -> DataFrame:
    """(signal_id, terms, model_names, claims).

    Needles are matched per text and OR-ed as bits; of the model names each text
    gives its first six per pattern, which is all the first six overall can need.
    """
    texts = _texts(signals, links, articles)
    bits = texts.groupBy("signal_id").agg(F.bit_or(_bits(F.col("text"))).alias("bits"))
    found = texts.filter(F.col("text").rlike("NEO|SenseNova|neo|[A-Za-z0-9]-[A-Za-z0-9]+-")).select(
        "signal_id", "place",
        F.posexplode(
            F.array(*[F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0))), 1, MAX_NAMES) for p in MODEL_NAMES])
        ).alias("pattern", "names"),
    ).select("signal_id", "place", "pattern", F.posexplode("names").alias("pos", "name"))
    firsts = found.withColumn("name", F.regexp_replace("name", SPACE, " ")).groupBy("signal_id", "name").agg(
        F.min(F.struct("pattern", "place", "pos")).alias("seen")
    )
    turn = F.row_number().over(Window.partitionBy("signal_id").orderBy("seen"))
    names = (
        firsts.withColumn("turn", turn).filter(F.col("turn") <= MAX_NAMES)
        .groupBy("signal_id").agg(F.array_sort(F.collect_list(F.struct("turn", "name"))).alias("n"))
        .select("signal_id", F.transform("n", lambda x: x["name"]).alias("model_names"))
    )
    has = lambda i: F.col("bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0
    rows = signals.select("signal_id").join(bits, "signal_id", "left").join(names, "signal_id", "left").select(
        "signal_id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"),
        F.coalesce("model_names", F.array().cast("array<string>")).alias("model_names"),
    )
    rows = rows.withColumn("terms", F.array_compact(F.array(*[F.when(has(i), F.lit(t)) for i, t in enumerate(TERMS)])))
    model = F.coalesce(
        F.try_element_at(F.filter("model_names", lambda n: n.rlike("(?i)SenseNova")), F.lit(1)),
        F.try_element_at("model_names", F.lit(1)), F.lit(DEFAULT_MODEL),
    )
    targets = F.array_join(F.slice(F.filter("model_names", lambda n: ~n.rlike(UNIFY)), 1, 3), "、")
    texts_of = []
    for i, (_, template) in enumerate(CLAIMS):
        text: Column = F.lit(template)
        if "{targets}" in template:
            text = F.when(targets != "", F.concat(targets, F.lit(template.replace("{targets}", "")))).otherwise(NO_TARGET_CLAIM)
        if "{model}" in template:
            text = F.concat(model, F.lit(template.replace("{model}", "")))
        texts_of.append(F.when(has(len(TERMS) + i), text))
    claims = F.slice(F.array_distinct(F.array_compact(F.array(*texts_of))), 1, MAX_CLAIMS)
    only = F.array(F.concat(F.lit(ONLY_TERMS), F.array_join(F.slice("terms", 1, 5), "、")))
    return rows.select(
        "signal_id", "terms", "model_names", F.when((F.size(claims) == 0) & (F.size("terms") > 0), only).otherwise(claims).alias("claims")
    )


def _pad(c: Column) -> Column:
    """At least a hundred CJK letters, by whole padding sentences."""
    short = F.greatest(F.lit(0), F.ceil((F.lit(100) - cjk_count(c)) / F.lit(float(_PADDING_CJK)))).cast("int")
    return F.concat(c, F.repeat(F.lit(PADDING), short))


def signal_facts(context: DataFrame) -> DataFrame:
    """Per signal: first article, first four for the timeline, source names, known source ids and mix.

    Lists are bounded: four articles, or one entry per source.
    """
    turn = F.row_number().over(Window.partitionBy("signal_id").orderBy("place", "article_id"))
    head = (
        context.select("signal_id", "place", "article_id", "source_id", "source_name", "title", "excerpt", "published_at")
        .withColumn("turn", turn)
        .filter(F.col("turn") <= TIMELINE_SIZE)
        .groupBy("signal_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "source_id", "source_name", "title", "excerpt", "published_at"))).alias("head"))
    )
    mix = (
        context.groupBy("signal_id", "source_id")
        .agg(F.min("place").alias("place"), F.first("source_name").alias("source_name"), F.first("source_role").alias("role"))
        .groupBy("signal_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", "source_id", "source_name", "role"))).alias("mix"))
    )
    return head.join(mix, "signal_id").select(
        "signal_id", "head",
        F.transform("mix", lambda m: m["source_id"]).alias("source_ids"),
        F.transform("mix", lambda m: F.struct(m["source_id"].alias("source_id"), m["source_name"].alias("source_name"), m["role"].alias("role"))).alias("mix"),
    )


def _point(text: Column, source: Column) -> Column:
    return F.struct(text.alias("text"), F.array(source).alias("source_ids"))


def fallback_outputs(signals: DataFrame, context: DataFrame, extracted: DataFrame) -> DataFrame:
    """Text built from titles, excerpts, terms and claims alone."""
    rows = (
        signals.select("signal_id", F.col("title").alias("signal_title"))
        .join(signal_facts(context), "signal_id", "left")
        .join(extracted, "signal_id", "left")
    )
    lead = F.try_element_at("head", F.lit(1))
    names = F.array_join(F.filter(F.transform(F.slice("head", 1, NAME_COUNT), lambda h: h["source_name"]), lambda n: F.coalesce(n, F.lit("")) != ""), "、")
    rows = rows.withColumns(
        {
            "names": F.coalesce(F.nullif(names, F.lit("")), F.lit(NO_NAMES)),
            "subject": F.coalesce(clean_text(F.coalesce(F.nullif("signal_title", F.lit("")), lead["title"])), F.lit(NO_TITLE)),
            "lead_source": lead["source_id"],
            "lead_name": F.coalesce(F.nullif(lead["source_name"], F.lit("")), F.lit(NO_SOURCE_NAME)),
            "few_terms": F.array_join(F.slice("terms", 1, 5), "、"),
            "given": clean_text(lead["excerpt"]),
        }
    ).withColumn("line", F.coalesce("given", F.concat("names", F.lit(NO_EXCERPT))))
    terms, claims = F.col("few_terms"), F.col("claims")
    about = F.coalesce(F.nullif(terms, F.lit("")), F.array_join(F.slice(claims, 1, 2), "、"))
    watch = (
        F.when(F.size(claims) > 0, F.concat(F.lit(WATCH_CLAIMS[0]), about, F.lit(WATCH_CLAIMS[1])))
        .when(terms != "", F.concat(F.lit(WATCH_TERMS[0]), terms, F.lit(WATCH_TERMS[1])))
        .otherwise(WATCH_PLAIN)
    )
    source = F.col("lead_source")
    said = F.transform(F.slice(claims, 1, 3), lambda c: _point(with_terminal(c), source))
    # The wording of hint, first point, terms point and brief.
    hint = F.when(has_cjk("line"), clip("line", 96)).otherwise(F.concat(F.lit("来源摘要提到："), clip("line", 82)))
    first = _point(F.concat("lead_name", F.lit(" 报道了"), clip("subject", 70), F.lit("。")), source)
    points = F.concat(
        F.array(first), said,
        F.array_compact(
            F.array(
                F.when(F.size(claims) == 0, _point(hint, source)),
                F.when((F.size(claims) < 2) & (terms != ""), _point(F.concat(F.lit("后续可重点核对"), terms, F.lit("的实际进展。")), source)),
            )
        ),
    )
    told = F.array_join(F.transform(F.slice(claims, 1, 4), strip_terminal), "；")
    third = (
        F.when(F.size(claims) > 0, F.concat(F.lit(BRIEF_CLAIMS[0]), told, F.lit(BRIEF_CLAIMS[1])))
        .when(terms != "", F.concat(F.lit(BRIEF_TERMS[0]), terms, F.lit(BRIEF_TERMS[1])))
        .otherwise(BRIEF_PLAIN)
    )
    brief = F.concat(
        F.lit("这条资讯聚焦"), clip("subject", 62), F.lit("。来源摘要显示，"), strip_terminal(clip("line", 78)), F.lit("。"), third
    )
    has_articles = F.col("head").isNotNull()
    nothing = F.array().cast(f"array<{_POINT}>")
    timeline = F.transform(
        "head",
        lambda h: F.struct(
            F.concat(F.coalesce(F.nullif(h["source_name"], F.lit("")), F.lit(NO_SOURCE_NAME)), F.lit(" 发布了这条相关资讯。")).alias("label"),
            F.date_format(h["published_at"], "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at"),
            F.array(h["source_id"]).alias("source_ids"),
        ),
    )
    return rows.select(
        "signal_id", "names", "source_ids",
        clip_visible(_pad(clean_text(brief)), 280).alias("ai_brief"),
        F.when(has_articles, points).otherwise(nothing).alias("key_points"),
        timeline.alias("timeline"),
        F.col("mix").alias("source_mix"),
        F.when(has_articles, watch).otherwise(WATCH_NOTHING).alias("next_watch"),
        F.array().cast("array<string>").alias("related_signal_ids"),
    )


# --- model outputs ----------------------------------------------------------------


def _listed(raw: Column) -> Column:
    """A JSON list, or a single value, as an array of JSON texts."""
    return F.when(raw.isNull() | (raw == ""), F.array().cast("array<string>")).when(
        F.ltrim(raw).startswith("["), F.from_json(raw, "ARRAY<STRING>")
    ).otherwise(F.array(raw))


def _ids(raw: Column) -> Column:
    return F.filter(_listed(raw), lambda x: F.coalesce(x, F.lit("")) != "")


def parse_outputs(outputs: DataFrame) -> DataFrame:
    """Model answers (signal_id, content) as columns; ``parse_error`` where there is no JSON object."""
    text = F.trim(F.coalesce("content", F.lit("")))
    inner = F.regexp_extract(text, "(?is)^```(?:json)?\\s*(.*?)\\s*```$", 1)
    bare = F.trim(F.when(inner != "", inner).otherwise(text))
    cut = F.when(bare.startswith("{"), bare).otherwise(F.regexp_extract(bare, "(?s)(\\{.*\\})", 1))
    valid = F.try_parse_json(cut).isNotNull() & cut.startswith("{")
    fields = "aiBrief STRING, keyPoints STRING, timeline STRING, sourceMix STRING, nextWatch STRING, relatedSignalIds STRING"
    rows = outputs.select(*[c for c in outputs.columns if c != "content"], cut.alias("cut"), valid.alias("valid")).withColumn(
        "j", F.when(F.col("valid"), F.from_json("cut", fields))
    )
    part = lambda x, f: F.get_json_object(x, f"$.{f}")
    is_object = lambda x: F.ltrim(x).startswith("{")
    points = F.transform(
        _listed(F.col("j.keyPoints")),
        lambda x: F.struct(F.when(is_object(x), part(x, "text")).otherwise(x).alias("text"), F.when(is_object(x), _ids(part(x, "sourceIds"))).otherwise(F.array().cast("array<string>")).alias("source_ids")),
    )
    timeline = F.transform(
        _listed(F.col("j.timeline")),
        lambda x: F.struct(
            F.when(is_object(x), part(x, "label")).otherwise(x).alias("label"), F.when(is_object(x), part(x, "at")).alias("at"),
            F.when(is_object(x), _ids(part(x, "sourceIds"))).otherwise(F.array().cast("array<string>")).alias("source_ids"),
        ),
    )
    mix = F.transform(
        _listed(F.col("j.sourceMix")),
        lambda x: F.struct(part(x, "sourceId").alias("source_id"), part(x, "sourceName").alias("source_name"), part(x, "role").alias("role")),
    )
    return rows.select(
        *[c for c in outputs.columns if c != "content"],
        F.col("j.aiBrief").alias("ai_brief"), points.alias("key_points"), timeline.alias("timeline"), mix.alias("source_mix"),
        F.col("j.nextWatch").alias("next_watch"), _ids(F.col("j.relatedSignalIds")).alias("related_signal_ids"),
        F.when(F.col("cut") == "", "no_json_object").when(~F.coalesce("valid", F.lit(False)), "invalid_json").alias("parse_error"),
    )


def normalize_outputs(rows: DataFrame) -> DataFrame:
    """Cleaned texts, empty items dropped."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    blank = lambda c: F.coalesce(clean_text(c), F.lit(""))
    return rows.withColumns(
        {
            "ai_brief": blank("ai_brief"),
            "next_watch": blank("next_watch"),
            "key_points": F.filter(F.transform("key_points", lambda p: F.struct(blank(p["text"]).alias("text"), F.filter(p["source_ids"], some).alias("source_ids"))), lambda p: p["text"] != ""),
            "timeline": F.filter(
                F.transform("timeline", lambda p: F.struct(blank(p["label"]).alias("label"), p["at"].alias("at"), F.filter(p["source_ids"], some).alias("source_ids"))),
                lambda p: p["label"] != "",
            ),
            "source_mix": F.filter(
                F.transform(
                    "source_mix",
                    lambda m: F.struct(m["source_id"].alias("source_id"), blank(m["source_name"]).alias("source_name"), F.coalesce(clean_text(m["role"]), F.lit("supporting")).alias("role")),
                ),
                lambda m: some(m["source_id"]),
            ),
            "related_signal_ids": F.filter("related_signal_ids", some),
        }
    )


def _known(ids: Column, known: Column) -> Column:
    return (F.size(ids) > 0) & (F.size(F.array_except(ids, known)) == 0)


def validate_outputs(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Normalized outputs with ``errors`` (distinct messages in fixed order); ``facts`` has signal_id, source_ids."""
    base = normalize_outputs(rows).drop("source_ids").join(facts.select("signal_id", "source_ids"), "signal_id", "left")
    known = F.coalesce("source_ids", F.array().cast("array<string>"))
    long_item = lambda c: (word_count(c) > 45) | (visible_length(c) > 100)
    points, timeline = F.col("key_points"), F.col("timeline")
    # The messages.
    checks = [
        (~has_cjk("ai_brief"), "User-facing enrichment text must use Simplified Chinese"),
        (cjk_count("ai_brief") < 100, "AI brief is too short"),
        ((word_count("ai_brief") > 90) | (visible_length("ai_brief") > 280), "AI brief is too long"),
        ((F.size(points) == 0) | (F.size(points) > 6), "Key points must include 1 to 6 items"),
        (F.size(timeline) > 8, "Timeline must include at most 8 items"),
        (F.size("source_mix") == 0, "Source mix is required for attribution"),
        (~has_cjk("next_watch"), "Next-watch text must use Simplified Chinese"),
        ((word_count("next_watch") > 60) | (visible_length("next_watch") > 140), "Next-watch text is too long"),
        (F.exists(points, lambda p: ~has_cjk(p["text"])), "Key points must use Simplified Chinese"),
        (F.exists(points, lambda p: long_item(p["text"])), "Key point is too long"),
        (F.exists(points, lambda p: ~_known(p["source_ids"], known)), "Key points require valid source references"),
        (F.exists(timeline, lambda p: ~has_cjk(p["label"])), "Timeline items must use Simplified Chinese"),
        (F.exists(timeline, lambda p: long_item(p["label"])), "Timeline item is too long"),
        (F.exists(timeline, lambda p: ~_known(p["source_ids"], known)), "Timeline items require valid source references"),
        (F.exists("source_mix", lambda m: ~F.array_contains(known, m["source_id"])), "Source mix includes unknown source references"),
    ]
    return base.withColumn("errors", F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in checks])))


def repair_outputs(rows: DataFrame, fallback: DataFrame, signals: DataFrame) -> DataFrame:
    """Parsed outputs with unusable parts replaced by fallback text, long parts cut, a short brief rebuilt."""
    f = fallback.select(
        "signal_id", F.col("source_ids").alias("known"), "names", F.col("key_points").alias("f_points"), F.col("timeline").alias("f_timeline"),
        F.col("source_mix").alias("f_mix"), F.col("next_watch").alias("f_watch"),
    )
    base = rows.join(f, "signal_id").join(signals.select("signal_id", F.col("title").alias("signal_title")), "signal_id")
    empty = F.array().cast("array<string>")
    known = F.coalesce("known", empty)
    usable = lambda ids: _known(F.filter(F.coalesce(ids, empty), lambda i: F.coalesce(i, F.lit("")) != ""), known)
    points, timeline, mix = F.col("key_points"), F.col("timeline"), F.col("source_mix")
    good_points = F.size(points).between(1, 6) & F.forall(points, lambda p: has_cjk(p["text"]) & usable(p["source_ids"]))
    good_timeline = (F.size(timeline) <= 8) & F.forall(timeline, lambda p: has_cjk(p["label"]) & usable(p["source_ids"]))
    good_mix = (F.size(mix) > 0) & F.forall(mix, lambda m: F.coalesce(F.array_contains(known, m["source_id"]), F.lit(False)))
    fixed = base.withColumns(
        {
            "key_points": F.when(
                F.coalesce(good_points, F.lit(False)),
                F.transform(points, lambda p: F.struct(clip_visible(p["text"], 100).alias("text"), p["source_ids"].alias("source_ids"))),
            ).otherwise(F.col("f_points")),
            "timeline": F.when(
                F.coalesce(good_timeline, F.lit(False)),
                F.transform(timeline, lambda p: F.struct(clip_visible(p["label"], 100).alias("label"), p["at"].alias("at"), p["source_ids"].alias("source_ids"))),
            ).otherwise(F.col("f_timeline")),
            "source_mix": F.when(F.coalesce(good_mix, F.lit(False)), mix).otherwise(F.col("f_mix")),
            "next_watch": F.when(has_cjk("next_watch"), clip_visible("next_watch", 140)).otherwise(F.col("f_watch")),
        }
    )
    seed = clean_text("ai_brief")
    title = F.coalesce(clip("signal_title", 72), F.lit(""))
    opening = F.coalesce(seed, F.concat(title, F.lit(SEED_MISSING)))
    told = strip_terminal(F.try_element_at(F.filter(F.transform("key_points", lambda p: p["text"]), lambda p: strip_terminal(p) != ""), F.lit(1)))
    watch = strip_terminal("next_watch")
    # The wording between the parts.
    rebuilt = F.concat(
        opening,
        F.when((cjk_count(opening) < 20) & ~opening.contains(F.substring(title, 1, 12)), F.concat(F.lit("相关标题是"), title, F.lit("。"))).otherwise(""),
        F.when(told != "", F.concat(F.lit("要点显示："), told, F.lit("。"))).otherwise(
            F.concat(F.lit(NO_POINT[0]), "names", F.lit(NO_POINT[1]), title, F.lit(NO_POINT[2]))
        ),
        F.when(watch != "", F.concat(F.lit("后续观察："), watch, F.lit("。"))).otherwise(NO_WATCH),
    )
    filled = clip_visible(_pad(clean_text(rebuilt)), 280)
    last = clip_visible(
        F.concat(
            clip(F.coalesce(seed, title), 60), F.lit(LAST_RESORT[0]), F.lit(LAST_RESORT[1]), clip("names", 42), F.lit(LAST_RESORT[2]),
            F.lit(LAST_RESORT[3]), F.lit(LAST_RESORT[4]), F.lit(LAST_RESORT[5]),
        ),
        280,
    )
    brief = F.when(cjk_count("ai_brief") >= 100, F.col("ai_brief")).when(cjk_count("filled") >= 100, F.col("filled")).otherwise(last)
    return fixed.withColumn("filled", filled).withColumn("ai_brief", brief).select(*rows.columns)


# --- status ---------------------------------------------------------------------------


def enrichment_results(signals: DataFrame, fallback: DataFrame, checked: DataFrame | None, provider: str | None) -> DataFrame:
    """(signal_id, status, error, category, text columns) for signals being enriched.

    Without a provider every signal gets fallback text; with one, sound outputs
    complete and everything else (missing, unparsable, invalid) fails over to
    fallback text.
    """
    text = ["ai_brief", "key_points", "timeline", "source_mix", "next_watch", "related_signal_ids"]
    base = signals.select("signal_id").join(fallback.select("signal_id", *[F.col(c).alias(f"f_{c}") for c in text]), "signal_id", "left")
    if provider is None or checked is None:
        return base.select(
            "signal_id", F.lit("fallback").alias("status"), F.lit(None).cast("string").alias("error"), F.lit("provider_unavailable").alias("category"),
            *[F.col(f"f_{c}").alias(c) for c in text],
        )
    joined = base.join(checked.select("signal_id", "parse_error", "errors", *text), "signal_id", "left")
    sound = F.col("errors").isNotNull() & (F.size("errors") == 0) & F.col("parse_error").isNull()
    error = F.coalesce("parse_error", F.array_join("errors", "; "), F.lit("no_output"))
    category = F.when(F.col("parse_error").isNotNull() | F.col("errors").isNull(), "enrichment_failed").otherwise("enrichment_validation_failed")
    return joined.select(
        "signal_id", F.when(sound, "completed").otherwise("failed").alias("status"), F.when(~F.coalesce(sound, F.lit(False)), error).alias("error"),
        F.when(~F.coalesce(sound, F.lit(False)), category).alias("category"),
        *[F.when(sound, F.col(c)).otherwise(F.col(f"f_{c}")).alias(c) for c in text],
    )


def apply_enrichment(
    signals: DataFrame, results: DataFrame, provider: str | None = None, now: datetime | str | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """Signals with the new text, status and bookkeeping; signals without a result stay as they are.

    With ``now`` a made text has generated_at and, from ``counts``
    (``member_counts``), source_count; a failure has failed_at; both set updated_at.
    """
    text = ["ai_brief", "key_points", "timeline", "source_mix", "next_watch", "related_signal_ids"]
    r = results.select("signal_id", F.col("status").alias("r_status"), F.col("error").alias("r_error"), F.col("category").alias("r_category"), *[F.col(c).alias(f"r_{c}") for c in text])
    done = F.col("r_status").isNotNull()
    new = {
        "enrichment_status": F.col("r_status"),
        "enrichment_error": F.when(F.col("r_status") == "failed", F.col("r_error")),
        "error_category": F.col("r_category"),
        "fallback_generated": F.col("r_status") == "failed",
        "enrichment_version": F.lit(VERSION),
        "enrichment_provider": F.lit(provider or "fallback"),
        "summary": F.col("r_ai_brief"),
        **{c: F.col(f"r_{c}") for c in text},
    }
    joined = signals.join(r, "signal_id", "left")
    if now is not None:
        joined = joined.join(counts, "signal_id", "left") if counts is not None else joined.withColumn("member_count", F.lit(None).cast("int"))
        made = F.col("r_status") != "failed"
        new |= {
            "enrichment_generated_at": F.when(made, ts_lit(now)),
            "enrichment_failed_at": F.when(~made, ts_lit(now)),
            "enrichment_source_count": F.when(made, F.coalesce("member_count", F.lit(0))),
            "updated_at": ts_lit(now),
        }
    old = lambda c: F.col(c) if c in signals.columns else F.lit(None)
    return joined.select(
        *[c for c in signals.columns if c not in new],
        *[F.when(done, v).otherwise(old(c)).alias(c) for c, v in new.items()],
    )


# --- backfill ----------------------------------------------------------------------------


def is_stale() -> Column:
    status = F.col("enrichment_status")
    text = F.concat_ws(" ", F.nullif("summary", F.lit("")), F.nullif("ai_brief", F.lit("")), F.array_join(F.transform("key_points", lambda p: p["text"]), " "))
    thin = (F.length(F.trim(F.coalesce("ai_brief", F.lit("")))) < 80) | (F.size(F.coalesce("key_points", F.array().cast(f"array<{_POINT}>"))) < 2)
    stale = (
        (F.coalesce("enrichment_version", F.lit(0)) < VERSION)
        | contains_any(text, STALE_PATTERNS)
        | ((status == "completed") & thin)
    )
    return ~F.coalesce(status, F.lit("")).isin("pending", "processing") & stale


def stale_enrichment(signals: DataFrame) -> DataFrame:
    return signals.filter(is_stale())


def _effective_date() -> Column:
    return F.coalesce("primary_published_at", "updated_at", "created_at")


def backfill_candidates(
    signals: DataFrame, limit: int | None = 25, stale_only: bool = False, statuses: list[str] | None = None,
    published_after: datetime | str | None = None,
) -> DataFrame:
    """Signals whose text should be made again, most valuable first (``limit`` None = all)."""
    rows = signals.withColumn("stale", is_stale())
    if published_after is not None:
        rows = rows.filter(_effective_date() >= ts_lit(published_after))
    if statuses:
        rows = rows.filter(F.col("enrichment_status").isin(*statuses))
    waiting = F.lit(False) if stale_only else F.col("enrichment_status").isin("pending", "failed", "fallback")
    score = F.coalesce(F.nullif("signal_score", F.lit(0.0)), F.nullif("heat_score", F.lit(0.0)), F.lit(0.0))
    ordered = rows.filter(F.col("stale") | waiting).orderBy(
        score.desc(), F.coalesce(millis(_effective_date()), F.lit(0).cast("long")).desc(), "signal_id"
    )
    return ordered if limit is None else ordered.limit(limit)


def mark_backfill(signals: DataFrame, candidates: DataFrame, dry_run: bool = False, now: datetime | str | None = None) -> DataFrame:
    """Signals with the candidates set back to pending, with reason and previous status; ``now`` becomes their updated_at."""
    if dry_run:
        return signals
    marks = candidates.select("signal_id", F.col("stale").alias("_stale"))
    joined = signals.join(marks, "signal_id", "left")
    hit = F.col("_stale").isNotNull() & (F.col("enrichment_status") != "pending")
    reason = (
        F.when(F.col("_stale"), "stale_enrichment")
        .when(F.col("enrichment_status") == "failed", "failed_enrichment_retry")
        .otherwise("fallback_enrichment_retry")
    )
    old = lambda c: F.col(c) if c in signals.columns else F.lit(None).cast("string")
    if now is not None:
        joined = joined.withColumn("updated_at", F.when(hit, ts_lit(now)).otherwise(F.col("updated_at")))
    return joined.select(
        *[c for c in signals.columns if c not in ("enrichment_status", "enrichment_error", "backfill_reason", "previous_status")],
        F.when(hit, "pending").otherwise(F.col("enrichment_status")).alias("enrichment_status"),
        F.when(hit, F.lit(None).cast("string")).otherwise(old("enrichment_error")).alias("enrichment_error"),
        F.when(hit, reason).otherwise(old("backfill_reason")).alias("backfill_reason"),
        F.when(hit, F.col("enrichment_status")).otherwise(old("previous_status")).alias("previous_status"),
    )
