"""Registered queries against DuckDB at the smallest scale."""

import os

import pytest
from compare import compare, connect

SF = "/root/testdata/sf0.001"
SOME = ["top_signals", "score_components", "resolve_topics", "search", "home", "upsert_raw_items", "read_crossref", "title_similarity_possible", "topic_velocity"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SOME)
def test_matches_the_sql(spark, con, name):
    rows, ok, diff = compare(spark, con, name, SF)
    assert rows > 0 and ok, diff


def test_every_query_is_named_once():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_derived_tables_read_what_is_landed(spark):
    """No base table is read again for a table whose inputs have been written."""
    from storyloom.plans import derive

    articles = spark.sql(
        "SELECT * FROM VALUES ('art_000000003', 's1', 'T', TIMESTAMP_NTZ '2024-01-02 00:00:00', TIMESTAMP_NTZ '2024-01-31 00:00:00', 'text'), "
        "('art_000000004', 's2', 'U', NULL, TIMESTAMP_NTZ '2024-01-31 00:00:00', '') AS a(article_id, source_id, title, published_at, created_at, text_for_ai)"
    )
    sources = spark.sql("SELECT * FROM VALUES ('s1', 'research', 0.5D), ('s2', 'policy', 0.7D) AS s(source_id, family, trust_score)")
    rows = derive.table(spark, "/no/such/folder", "links_ranked", {"articles": articles, "sources": sources}).collect()
    assert {(r.signal_id, r.article_id, r.lead_rank) for r in rows} == {("sig_000000001", "art_000000004", 1), ("sig_000000001", "art_000000003", 2)}


def test_landed_texts_move_once(spark, tmp_path):
    spark.range(1000).selectExpr("id AS doc_id", "concat('Title ', id, '. text') AS text", "'en' AS lang", "concat('src', id % 20) AS source", "12 AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(200).selectExpr("id AS page_id", "concat('https://p.example.com/', id) AS url", "'' AS html").write.parquet(f"{tmp_path}/pages.parquet")
    from catalog.registry import Tables
    from storyloom.plans import derive

    got = Tables(spark, str(tmp_path)).articles
    want = derive.table(spark, str(tmp_path), "articles")
    assert got.count() == 1000 and got.exceptAll(want).isEmpty()


def test_a_landed_feed_holds_many_items(spark):
    """2,000 items of 20 sources are 20 files, not one for every 25 items; none is lost."""
    from catalog import sources

    landed = sources._land_feeds(spark.range(2000).selectExpr("concat('s', id % 20) AS source_id", "id AS n", "concat('<item>', id, '</item>') AS value"), "<rss>", "</rss>")
    wrote = spark.read.text(landed)
    assert len(wrote.inputFiles()) == 20 and wrote.filter("value LIKE '<item>%'").count() == 2000


def test_landed_answers_share_files(spark, tmp_path):
    """2,000 articles of 20 sources: 20 files of 400 answers, each article read once by batch and by stream."""
    articles = spark.range(2000).selectExpr(
        "concat('art_', lpad(CAST(id AS STRING), 9, '0')) AS article_id", "concat('src', id % 20) AS source_id", "concat('Title ', id) AS title",
        "concat('some text ', id) AS text_for_ai", "TIMESTAMP_NTZ '2024-01-02 00:00:00' AS published_at",
    )
    from catalog import registry, sources
    from storyloom.operators.lineage import shared_folder
    from storyloom.plans import derive

    articles.selectExpr("CAST(substr(article_id, 5) AS BIGINT) AS doc_id", "source_id AS source").write.parquet(f"{tmp_path}/documents.parquet")
    t = registry.Tables(spark, str(tmp_path))
    key = lambda name: (spark.sparkContext.applicationId, str(tmp_path), name)
    registry._LANDED[key("articles")] = articles
    registry._LANDED[key("sources")] = derive.table(spark, str(tmp_path), "sources")
    before = set(os.listdir(shared_folder(spark)))
    rows = sources.read_landing(t).groupBy("way", "kind").count().collect()
    assert {(r.way, r.kind): r["count"] for r in rows} == {(w, k): 2000 for w in ("batch", "stream") for k in ("lines", "newsapi")}
    (landing,) = [x for x in set(os.listdir(shared_folder(spark))) - before if x.startswith("landing-")]
    assert len(spark.read.text(f"{shared_folder(spark)}/{landing}/newsapi").inputFiles()) == 20
