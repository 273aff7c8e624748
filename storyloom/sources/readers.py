"""Landed feed and API payloads as records of one shape.

Landing folders are partitioned by ``source_id``.  Schemas are explicit, so no
file is read twice to infer one.  XML comes through Spark's own XML source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_summary, clean_text, first_text
from ..functions.times import to_ts, ts_lit
from ..operators.ingest import filter_keywords
from ..schemas import RECORDS

# Paths of the public item pages.
DOI_URL = "https://doi.org/"
ARXIV_URL = "https://arxiv.org/abs/"
HN_ITEM_URL = "https://news.ycombinator.com/item?id="
ARXIV_ID_PREFIX = "^https?://(export\\.)?arxiv\\.org/abs/"

_LINKS = "link ARRAY<STRUCT<_VALUE STRING, _href STRING, _rel STRING, _type STRING, _title STRING>>"
_TERMS = "category ARRAY<STRUCT<_VALUE STRING, _term STRING>>"
RSS_ITEM = (
    "title STRING, link STRING, pubDate STRING, date STRING, creator STRING, author STRING, description STRING, "
    "summary STRING, category ARRAY<STRING>, guid STRUCT<_VALUE STRING, _isPermaLink STRING>, encoded STRING"
)
ATOM_ENTRY = (
    f"id STRING, title STRING, {_LINKS}, published STRING, updated STRING, author ARRAY<STRUCT<name STRING>>, "
    f"{_TERMS}, summary STRING, content STRING"
)
ARXIV_ENTRY = (
    f"id STRING, title STRING, {_LINKS}, published STRING, updated STRING, author ARRAY<STRUCT<name STRING>>, "
    f"{_TERMS}, summary STRING, comment STRING, journal_ref STRING, primary_category STRUCT<_term STRING>"
)
_DATE_PARTS = "STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>"
CROSSREF = (
    "message STRUCT<`total-results`: BIGINT, items: ARRAY<STRUCT<DOI: STRING, URL: STRING, title: ARRAY<STRING>, "
    "subtitle: ARRAY<STRING>, abstract: STRING, author: ARRAY<STRUCT<given: STRING, family: STRING, name: STRING>>, "
    "subject: ARRAY<STRING>, `container-title`: ARRAY<STRING>, type: STRING, `is-referenced-by-count`: BIGINT, "
    f"published: {_DATE_PARTS}, `published-print`: {_DATE_PARTS}, `published-online`: {_DATE_PARTS}, "
    "created: STRUCT<`date-parts`: ARRAY<ARRAY<INT>>, `date-time`: STRING>>>>"
)
SEMANTIC_SCHOLAR = (
    "total BIGINT, `offset` BIGINT, data ARRAY<STRUCT<paperId: STRING, externalIds: STRUCT<DOI: STRING, ArXiv: STRING>, "
    "url: STRING, title: STRING, abstract: STRING, year: STRING, publicationDate: STRING, "
    "authors: ARRAY<STRUCT<authorId: STRING, name: STRING>>, venue: STRING, fieldsOfStudy: ARRAY<STRING>, "
    "s2FieldsOfStudy: ARRAY<STRUCT<category: STRING, source: STRING>>, citationCount: BIGINT, "
    "openAccessPdf: STRUCT<url: STRING, status: STRING>, tldr: STRUCT<model: STRING, text: STRING>>>"
)
NEWSAPI = (
    "status STRING, totalResults BIGINT, articles ARRAY<STRUCT<source: STRUCT<id: STRING, name: STRING>, author: STRING, "
    "title: STRING, description: STRING, url: STRING, urlToImage: STRING, publishedAt: STRING, content: STRING>>"
)
HACKER_NEWS = (
    "id BIGINT, type STRING, `by` STRING, time BIGINT, title STRING, url STRING, text STRING, score BIGINT, "
    "descendants BIGINT, deleted BOOLEAN, dead BOOLEAN, position BIGINT"
)
PRODUCT_HUNT = (
    "data STRUCT<posts: STRUCT<totalCount: BIGINT, edges: ARRAY<STRUCT<node: STRUCT<id: STRING, name: STRING, tagline: STRING, "
    "description: STRING, slug: STRING, url: STRING, website: STRING, createdAt: STRING, featuredAt: STRING, "
    "votesCount: BIGINT, commentsCount: BIGINT, reviewsCount: BIGINT, dailyRank: BIGINT, "
    "topics: STRUCT<edges: ARRAY<STRUCT<node: STRUCT<name: STRING, slug: STRING>>>>, "
    "makers: ARRAY<STRUCT<name: STRING, username: STRING, url: STRING>>>>>>>"
)



def _xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return (
        spark.read.format("xml")
        .option("rowTag", row_tag)
        .option("ignoreNamespace", True)
        .schema(f"{schema}, source_id STRING")
        .load(path)
        .select(*_names(schema), "source_id")
    )


def _names(schema: str) -> list[str]:
    return [f.name for f in T.StructType.fromDDL(schema).fields]


def _json(spark: SparkSession, path: str, schema: str, multi_line: bool) -> DataFrame:
    return spark.read.schema(f"{schema}, source_id STRING").option("multiLine", multi_line).json(path)


def _joined(names: Column) -> Column:
    return F.nullif(F.array_join(names, ", "), F.lit(""))


def _clean_list(items: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.filter(F.coalesce(F.transform(items, lambda x: clean_text(x)), empty), lambda x: x.isNotNull())


def records(rows: DataFrame, sources: DataFrame, fetched_at, meta: Column | None = None, **cols: Column) -> DataFrame:
    """Rows in the record shape.  ``payload`` keeps the mapped fields and the raw item."""
    kinds = sources.select("source_id", "source_type", F.col("language").alias("source_language"))
    none = F.lit(None).cast("string")
    mapped = rows.select(
        "source_id",
        cols["external_id"].alias("external_id"),
        cols["title"].alias("title"),
        cols["url"].alias("url"),
        cols["published_at"].alias("published_at"),
        cols.get("updated_at", F.lit(None).cast("timestamp")).alias("updated_at"),
        cols.get("author", none).alias("author"),
        cols.get("authors", F.lit(None).cast("array<string>")).alias("authors"),
        cols["summary"].alias("summary"),
        cols.get("categories", F.array().cast("array<string>")).alias("categories"),
        cols["raw"].alias("raw"),
        (meta if meta is not None else F.struct(none.alias("adapter"))).alias("meta"),
    )
    joined = mapped.join(kinds, "source_id")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    payload = F.to_json(
        F.struct(
            "title", "url", iso("published_at").alias("publishedAt"), iso("updated_at").alias("updatedAt"),
            "author", "authors", "summary", "categories", F.col("raw").alias("rawPayload"),
        )
    )
    response = F.to_json(F.struct("meta.*", F.col("source_language").alias("sourceLanguage")))
    return joined.withColumns(
        {"payload": payload, "response_meta": response, "fetched_at": ts_lit(fetched_at)}
    ).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORDS.fields])


def _adapter(name: str) -> Column:
    return F.struct(F.lit(name).alias("adapter"))


def fallback_external_id(title: Column, url: Column, published: Column) -> Column:
    stamp = F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.sha2(F.concat_ws("|", title, url, stamp), 256)


def read_rss(spark: SparkSession, path: str, sources: DataFrame, fetched_at) -> DataFrame:
    rows = _xml(spark, path, "item", RSS_ITEM)
    title, url = clean_text("title"), clean_text("link")
    published = to_ts(F.coalesce(F.nullif("pubDate", F.lit("")), F.col("date")))
    out = records(
        rows, sources, fetched_at, F.struct(F.lit("rss").alias("feedFormat")),
        external_id=F.coalesce(clean_text("guid._VALUE"), url, fallback_external_id(title, url, published)),
        title=title, url=url, published_at=published,
        author=first_text("creator", "author"),
        summary=clean_summary(F.coalesce(F.nullif("description", F.lit("")), F.col("summary"))),
        categories=_clean_list(F.col("category")),
        raw=F.struct(*[c for c in rows.columns if c != "source_id"]),
    )
    return filter_keywords(out, sources)


def _alternate() -> Column:
    link = F.coalesce(
        F.try_element_at(F.filter("link", lambda x: x["_rel"] == "alternate"), F.lit(1)), F.try_element_at("link", F.lit(1))
    )
    return clean_text(F.coalesce(F.nullif(link["_href"], F.lit("")), link["_VALUE"]))


def _terms() -> Column:
    return _clean_list(F.transform("category", lambda c: F.coalesce(F.nullif(c["_term"], F.lit("")), c["_VALUE"])))


def read_atom(spark: SparkSession, path: str, sources: DataFrame, fetched_at) -> DataFrame:
    rows = _xml(spark, path, "entry", ATOM_ENTRY)
    title, url = clean_text("title"), _alternate()
    published = to_ts(F.coalesce(F.nullif("published", F.lit("")), F.col("updated")))
    out = records(
        rows, sources, fetched_at, F.struct(F.lit("atom").alias("feedFormat")),
        external_id=F.coalesce(clean_text("id"), url, fallback_external_id(title, url, published)),
        title=title, url=url, published_at=published, updated_at=to_ts("updated"),
        author=clean_text(F.try_element_at("author", F.lit(1))["name"]),
        summary=clean_summary(F.coalesce(F.nullif("summary", F.lit("")), F.col("content"))),
        categories=_terms(),
        raw=F.struct(*[c for c in rows.columns if c != "source_id"]),
    )
    return filter_keywords(out, sources)


def read_arxiv(spark: SparkSession, path: str, sources: DataFrame, fetched_at) -> DataFrame:
    rows = _xml(spark, path, "entry", ARXIV_ENTRY)
    link = lambda cond: F.try_element_at(F.filter("link", cond), F.lit(1))["_href"]
    url = F.coalesce(F.nullif(link(lambda x: x["_rel"] == "alternate"), F.lit("")), F.col("id"))
    pdf = link(lambda x: (x["_rel"] == "related") & (x["_type"] == "application/pdf"))
    ident = F.regexp_replace(clean_text(F.coalesce(F.nullif("id", F.lit("")), url)), ARXIV_ID_PREFIX, "")
    authors = _clean_list(F.transform("author", lambda a: a["name"]))
    summary = clean_summary("summary")
    return records(
        rows, sources, fetched_at, _adapter("arxiv"),
        external_id=ident, title=clean_text("title"), url=url, published_at=to_ts("published"), updated_at=to_ts("updated"),
        author=_joined(authors), authors=authors, summary=summary, categories=_terms(),
        raw=F.struct(
            ident.alias("arxivId"), summary.alias("abstract"), authors.alias("authors"), _terms().alias("categories"),
            F.col("primary_category._term").alias("primaryCategory"), F.col("comment"), F.col("journal_ref").alias("journalRef"),
            pdf.alias("pdfUrl"),
        ),
    )


def read_crossref(spark: SparkSession, path: str, sources: DataFrame, fetched_at, multi_line: bool = True) -> DataFrame:
    rows = _json(spark, path, CROSSREF, multi_line).select(
        "source_id", F.col("message.`total-results`").alias("total"), F.explode("message.items").alias("w")
    )
    parts = F.coalesce(
        *[F.try_element_at(F.col(f"w.{f}.`date-parts`"), F.lit(1)) for f in ("published", "`published-print`", "`published-online`", "created")]
    )
    part = lambda i: F.try_element_at(parts, F.lit(i))
    day = F.to_timestamp(
        F.try_to_date(
            F.concat_ws("-", part(1), F.lpad(F.coalesce(part(2), F.lit(1)).cast("string"), 2, "0"), F.lpad(F.coalesce(part(3), F.lit(1)).cast("string"), 2, "0"))
        )
    )
    authors = _clean_list(
        F.transform("w.author", lambda a: F.coalesce(F.nullif(F.concat_ws(" ", F.nullif(a["given"], F.lit("")), F.nullif(a["family"], F.lit(""))), F.lit("")), a["name"]))
    )
    texts = lambda c: F.try_element_at(_clean_list(F.col(c)), F.lit(1))
    doi = F.nullif("w.DOI", F.lit(""))
    url = F.coalesce(F.nullif("w.URL", F.lit("")), F.concat(F.lit(DOI_URL), doi))
    return records(
        rows, sources, fetched_at, F.struct(F.lit("crossref").alias("adapter"), F.col("total").alias("totalResults")),
        external_id=F.coalesce(doi, F.col("w.URL")), title=F.coalesce(texts("w.title"), texts("w.subtitle")), url=url,
        published_at=day, updated_at=to_ts("w.created.`date-time`"), author=_joined(authors), authors=authors,
        summary=clean_summary("w.abstract"), categories=_clean_list(F.col("w.subject")), raw=F.col("w"),
    )


def read_semantic_scholar(spark: SparkSession, path: str, sources: DataFrame, fetched_at, multi_line: bool = True) -> DataFrame:
    rows = _json(spark, path, SEMANTIC_SCHOLAR, multi_line).select("source_id", "total", "offset", F.explode("data").alias("p"))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    doi = some("p.externalIds.DOI")
    authors = _clean_list(F.transform("p.authors", lambda a: a["name"]))
    fields = F.concat(_clean_list(F.col("p.fieldsOfStudy")), _clean_list(F.transform("p.s2FieldsOfStudy", lambda f: f["category"])))
    return records(
        rows, sources, fetched_at,
        F.struct(F.lit("semantic_scholar").alias("adapter"), F.col("total").alias("totalResults"), F.col("offset")),
        external_id=F.coalesce(some("p.paperId"), doi, F.col("p.url")), title=clean_text("p.title"),
        url=F.coalesce(some("p.url"), F.concat(F.lit(DOI_URL), doi), F.concat(F.lit(ARXIV_URL), some("p.externalIds.ArXiv"))),
        published_at=to_ts(F.coalesce(some("p.publicationDate"), F.col("p.year"))), author=_joined(authors), authors=authors,
        summary=clean_summary(F.coalesce(some("p.abstract"), F.col("p.tldr.text"))), categories=F.array_distinct(fields), raw=F.col("p"),
    )


def read_newsapi(spark: SparkSession, path: str, sources: DataFrame, fetched_at, multi_line: bool = True) -> DataFrame:
    rows = _json(spark, path, NEWSAPI, multi_line).select("source_id", "totalResults", F.explode("articles").alias("a"))
    return records(
        rows, sources, fetched_at, F.struct(F.lit("newsapi").alias("adapter"), "totalResults"),
        external_id=F.col("a.url"), title=clean_text("a.title"), url=F.col("a.url"), published_at=to_ts("a.publishedAt"),
        author=clean_text("a.author"), summary=clean_summary(F.coalesce(F.nullif("a.description", F.lit("")), F.col("a.content"))),
        categories=F.filter(F.array(F.col("a.source.name")), lambda x: F.coalesce(x, F.lit("")) != ""), raw=F.col("a"),
    )


def read_hacker_news(spark: SparkSession, path: str, sources: DataFrame, fetched_at, multi_line: bool = False) -> DataFrame:
    """Item dump, one object per line; ``position`` is the place in the fetched id list.

    Only the first ``fetch_limit`` places count, before stories are picked; an item without a place stays.
    """
    plan = sources.select("source_id", F.col("fetch_limit"), F.lower("query").alias("needle"))
    text = F.lower(F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif("url", F.lit("")), F.nullif("text", F.lit(""))))
    rows = (
        _json(spark, path, HACKER_NEWS, multi_line)
        .join(plan, "source_id")
        .filter(F.col("fetch_limit").isNull() | (F.col("fetch_limit") <= 0) | F.col("position").isNull() | (F.col("position") < F.col("fetch_limit")))
        .filter((F.col("type") == "story") & ~F.coalesce("deleted", F.lit(False)) & ~F.coalesce("dead", F.lit(False)))
        .filter((F.coalesce("needle", F.lit("")) == "") | F.contains(text, F.col("needle")))
    )
    page = F.concat(F.lit(HN_ITEM_URL), F.col("id").cast("string"))
    item = [c for c in ("id", "type", "by", "time", "title", "url", "text", "score", "descendants")]
    return records(
        rows, sources, fetched_at, _adapter("hacker_news"),
        external_id=F.col("id").cast("string"), title=clean_text("title"), url=F.coalesce(F.nullif("url", F.lit("")), page),
        published_at=F.timestamp_seconds("time"), author=clean_text("by"), summary=clean_summary("text"),
        categories=F.array(F.lit("hacker_news")),
        raw=F.struct(*item, F.coalesce("descendants", F.lit(0)).alias("commentsCount"), page.alias("discussionUrl")),
    )


def read_product_hunt(spark: SparkSession, path: str, sources: DataFrame, fetched_at, multi_line: bool = True) -> DataFrame:
    rows = _json(spark, path, PRODUCT_HUNT, multi_line).select(
        "source_id", F.col("data.posts.totalCount").alias("total"), F.explode("data.posts.edges").alias("e")
    ).select("source_id", "total", F.col("e.node").alias("n")).filter("n IS NOT NULL")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    makers = _clean_list(F.transform("n.makers", lambda m: F.coalesce(F.nullif(m["name"], F.lit("")), m["username"])))
    return records(
        rows, sources, fetched_at, F.struct(F.lit("product_hunt").alias("adapter"), F.col("total").alias("totalResults")),
        external_id=F.coalesce(some("n.id"), some("n.slug"), F.col("n.url")), title=clean_text("n.name"), url=F.col("n.url"),
        published_at=to_ts(F.coalesce(some("n.featuredAt"), F.col("n.createdAt"))), author=_joined(makers), authors=makers,
        summary=clean_text(F.coalesce(some("n.tagline"), F.col("n.description"))),
        categories=_clean_list(F.transform("n.topics.edges", lambda e: e["node"]["name"])), raw=F.col("n"),
    )


Reader = Callable[..., DataFrame]

READERS: dict[str, Reader] = {
    "rss": read_rss,
    "atom": read_atom,
    "arxiv": read_arxiv,
    "crossref": read_crossref,
    "semantic_scholar": read_semantic_scholar,
    "newsapi": read_newsapi,
    "hacker_news": read_hacker_news,
    "product_hunt": read_product_hunt,
}


def register_reader(source_type: str, reader: Reader) -> None:
    """Plug in a reader ``(spark, path, sources, fetched_at) -> records``."""
    READERS[source_type] = reader


class _Stream:
    """A session whose ``read`` makes streams; readers need no more of it."""

    def __init__(self, spark: SparkSession):
        self.read = spark.readStream


def read_landing(spark: SparkSession, root: str, sources: DataFrame, fetched_at, kinds: list[str], stream: bool = False) -> DataFrame:
    """Records of all landing folders ``root/<source type>`` named in ``kinds``.

    With ``stream`` the same readers run over new files as they land; a reader
    that only maps, filters and explodes its rows can be used either way.
    """
    united = None
    for kind in kinds:
        reader = _Stream(spark) if stream else spark
        part = READERS[kind](reader, f"{root}/{kind}", sources.filter(F.col("source_type") == kind), fetched_at)
        united = part if united is None else united.unionByName(part)
    return united
