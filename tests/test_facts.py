"""Single facts on hand-made rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from test_dedupe import T0, frame, row

from storyloom.operators import dedupe, enrich, ingest, quality, topics
from storyloom.sources import readers, tables


def decided(spark, a, b):
    rows = frame(spark, [a, b])
    pairs = spark.createDataFrame([(a["article_id"], b["article_id"])], "first_id STRING, second_id STRING")
    return dedupe.pair_decision(dedupe.pair_evidence(pairs, rows)).first()


def test_pair_rules(spark):
    url = "https://x.com/a"
    r = decided(spark, row(1, "a", url, "one two"), row(2, "b", url + "?q=1", "three four"))
    assert r.confirmed and r.reasons == ["canonical_url"] and r.confidence == 0.98
    assert decided(spark, row(1, "a", "https://x.com/1", h="h"), row(2, "b", "https://x.com/2", h="h")).confirmed
    assert not decided(spark, row(1, "a", "https://x.com/1", h="h"), row(2, "a", "https://x.com/2", h="h")).confirmed
    assert not decided(spark, row(1, "a", url, "one two"), row(2, "a", url, "three four")).confirmed
    assert not decided(spark, row(1, "a", None, "one two three"), row(2, "a", None, "one two three")).confirmed
    far = decided(spark, row(1, "a", None, "one two three"), row(2, "b", None, "one two three", T0 + timedelta(days=20)))
    assert not far.confirmed and far.possible and far.confidence == 0.65


def test_stale_relation_goes(spark):
    rows = frame(spark, [row(1, "a", None, "one two"), row(2, "b", None, "three four")])
    rel = spark.createDataFrame(
        [("duplicate_confirmed", "b", "art_0002", None, "art_0001")],
        "relation_type STRING, source_id STRING, article_id STRING, signal_id STRING, target_article_id STRING",
    )
    assert dedupe.stale_relations(rel, rows).count() == 1
    assert dedupe.retract_stale(rel, rows).count() == 0


def test_release_wording_needs_the_official_family(spark):
    one = lambda fam: spark.createDataFrame([("s", 0, [fam], ["rss"])], "signal_id STRING, x INT, source_families ARRAY<STRING>, source_types ARRAY<STRING>")
    for family, want in (("community", False), ("company_announcement", True)):
        ctx = one(family).withColumn("title", F.lit("Team releases a tool")).withColumn("bits", topics.keyword_mask("title"))
        got = {r.topic_slug for r in topics.resolve_topics(ctx, topics.family_topics(ctx), topics.keyword_topics(ctx)).collect()}
        assert ("company-announcements" in got) is want


def test_verdict_answers_fail_open(spark):
    batches = spark.createDataFrame([("a", 0, 0), ("b", 0, 1), ("c", 1, 0)], "article_id STRING, batch_no BIGINT, position INT")
    answers = spark.createDataFrame([(0, "```json\n[true, false]\n```"), (1, "[true, false]")], "batch_no BIGINT, content STRING")
    got = {r.article_id: r.relevant for r in quality.parse_verdicts(answers, batches).collect()}
    assert got == {"a": True, "b": False, "c": True}


def test_refetch_counts_once_per_fetch(spark):
    rec = spark.createDataFrame(
        [("s", "e", '{"b": 1, "a": 2}', "m1", T0), ("s", "e", "{}", None, T0 + timedelta(hours=1)), ("s", "e", "{}", "m3", T0 + timedelta(hours=2))],
        "source_id STRING, external_id STRING, payload STRING, response_meta STRING, fetched_at TIMESTAMP",
    )
    from storyloom.schemas import RAW_ITEMS

    once = ingest.upsert_raw_items(spark.createDataFrame([], RAW_ITEMS), rec)
    r = once.first()
    assert (r.duplicate_fetch_count, r.response_meta, r.payload) == (2, "m3", '{"b": 1, "a": 2}')
    assert r.content_hash == spark.range(1).select(F.sha2(F.lit('{"a":2,"b":1}'), 256).alias("h")).first().h
    assert ingest.upsert_raw_items(once, rec).first().duplicate_fetch_count == 5


def test_rebuilt_brief_is_long_enough(spark):
    signal = spark.createDataFrame([("s1", "Model launch")], "signal_id STRING, title STRING")
    context = spark.createDataFrame(
        [("s1", "p", "a1", "src1", "Paper", "media", "Model launch", "short", "", T0)],
        "signal_id STRING, place STRING, article_id STRING, source_id STRING, source_name STRING, source_role STRING, title STRING, excerpt STRING, text_for_ai STRING, published_at TIMESTAMP",
    )
    extracted = spark.createDataFrame([("s1", [], [], [])], "signal_id STRING, terms ARRAY<STRING>, model_names ARRAY<STRING>, claims ARRAY<STRING>")
    fallback = enrich.fallback_outputs(signal, context, extracted)
    parsed = enrich.parse_outputs(spark.createDataFrame([("s1", '{"aiBrief": "短"}')], "signal_id STRING, content STRING"))
    checked = enrich.validate_outputs(enrich.repair_outputs(parsed, fallback, signal), fallback).first()
    assert checked.errors == [] and checked.ai_brief.startswith("短相关标题是Model launch。要点显示：Paper 报道了Model launch。后续观察：继续关注")


def test_rss_file(spark, tmp_path):
    folder = tmp_path / "rss" / "source_id=s1"
    folder.mkdir(parents=True)
    (folder / "feed.xml").write_text(
        '<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><item><guid isPermaLink="false">g1</guid>'
        "<title> A   title </title><link>https://x.com/1</link><pubDate>Mon, 20 Apr 2026 10:00:00 GMT</pubDate>"
        "<dc:creator>Ann</dc:creator><category>c1</category><description><![CDATA[<p>Some <b>AI</b> text</p>]]></description></item>"
        "<item><title>No id</title><description>none</description></item></channel></rss>"
    )
    sources = spark.createDataFrame([("s1", "rss", "en", ["ai"])], "source_id STRING, source_type STRING, language STRING, filter_keywords ARRAY<STRING>")
    got = readers.read_rss(spark, str(tmp_path / "rss"), sources, "2026-04-21 00:00:00").collect()
    assert len(got) == 1
    r = got[0]
    assert (r.external_id, r.title, r.author, r.summary, r.categories) == ("g1", "A title", "Ann", "Some AI text", ["c1"])
    assert r.published_at == datetime(2026, 4, 20, 10)


def test_versions_switch_at_once(spark, tmp_path):
    root = str(tmp_path)
    a = spark.createDataFrame([(1, "x")], "k INT, v STRING")
    tables.write_version(a, root, "t", "1")
    merged = tables.upsert(tables.read_version(spark, root, "t"), spark.createDataFrame([(1, "y"), (2, "z")], "k INT, v STRING"), ["k"], ["v"])
    tables.write_version(merged, root, "t", "2")
    assert sorted(map(tuple, tables.read_version(spark, root, "t").collect())) == [(1, "y"), (2, "z")]
