"""Readers over landing files written from the document table, pages, and normalizers."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from storyloom.operators import normalize
from storyloom.operators.lineage import shared_folder
from storyloom.sources import pages as page_ops
from storyloom.sources import readers, registry, tables

from .registry import NOW, clean, query

BASE = ("articles", "sources")


def _safe(c):
    return F.regexp_replace(c, "[^A-Za-z0-9 ]", " ")


def _items(t):
    n = F.substring("article_id", 5, 20).cast("long")
    return t.articles.select(
        "source_id", n.alias("n"), _safe("title").alias("title"), _safe("text_for_ai").alias("excerpt"), "published_at",
        F.concat(F.lit("https://items.example.com/"), n.cast("string")).alias("url"),
    )


ITEMS = """items AS (SELECT source_id, CAST(substr(article_id, 5) AS BIGINT) AS n, regexp_replace(title, '[^A-Za-z0-9 ]', ' ', 'g') AS title,
    regexp_replace(text_for_ai, '[^A-Za-z0-9 ]', ' ', 'g') AS excerpt, published_at, 'https://items.example.com/' || CAST(substr(article_id, 5) AS BIGINT) AS url FROM articles)"""
TITLE, BODY = clean("title"), clean("excerpt || ' tail'")


def _land(rows):
    """Write (source_id, value) lines as landing files; returns the folder."""
    path = f"{shared_folder(rows.sparkSession)}/landing-{uuid.uuid4().hex}"
    rows.select("value", "source_id").write.partitionBy("source_id").text(path)
    return path


def _land_feeds(rows, head, tail):
    """The same as whole feed documents, one per source and 10,000 ids: a source holds a share of them only."""
    feeds = rows.withColumn("feed", F.floor(F.col("n") / 10_000)).withColumn("n", F.col("n").cast("double"))
    ends = feeds.select("source_id", "feed").distinct()
    whole = (
        feeds.select("source_id", "feed", "n", "value")
        .unionByName(ends.select("source_id", "feed", F.lit(-1.0).alias("n"), F.lit(head).alias("value")))
        .unionByName(ends.select("source_id", "feed", F.lit(float("inf")).alias("n"), F.lit(tail).alias("value")))
    )
    path = f"{shared_folder(rows.sparkSession)}/landing-{uuid.uuid4().hex}"
    ordered = whole.repartition("source_id", "feed").sortWithinPartitions("source_id", "feed", "n")
    ordered.select("value", "source_id", "feed").write.partitionBy("source_id", "feed").text(path)
    return path


RSS = ('<rss version="2.0"><channel>', "</channel></rss>")
ATOM = ('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">', "</feed>")


def _xml(tag, value):
    return F.when(value.isNotNull(), F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>"))).otherwise("")


def _html(c):
    return F.concat(F.lit("&lt;p&gt;"), c, F.lit("&lt;/p&gt; &lt;b&gt;tail&lt;/b&gt;"))


def _flat(records, *extra):
    return records.select(
        "source_id", "external_id", "title", "url", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "summary",
        F.array_join("categories", "|").alias("categories"), *extra,
    )


def _no_keywords(t):
    return t.sources.withColumn("filter_keywords", F.lit(None).cast("array<string>")).withColumns(
        {"fetch_limit": F.lit(None).cast("int"), "query": F.lit(None).cast("string")}
    )


@query(
    "read_rss",
    BASE,
    f""", {ITEMS} SELECT source_id, CASE WHEN n % 3 = 0 THEN url ELSE 'guid-' || n END AS external_id, {TITLE} AS title, url, published_at, {BODY} AS summary, 'one|two ' || n AS categories FROM items""",
)
def read_rss(t):
    i = _items(t)
    lines = i.select(
        "source_id", "n",
        F.concat(
            F.lit("<item>"), _xml("title", F.col("title")), _xml("link", F.col("url")),
            F.when(F.col("n") % 3 != 0, F.concat(F.lit('<guid isPermaLink="false">guid-'), F.col("n").cast("string"), F.lit("</guid>"))).otherwise(""),
            _xml("pubDate", F.concat(F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))),
            _xml("description", _html(F.col("excerpt"))), F.lit("<category>one</category><category> two  "), F.col("n").cast("string"),
            F.lit("</category></item>"),
        ).alias("value"),
    )
    return _flat(readers.read_rss(t.spark, _land_feeds(lines, *RSS), _no_keywords(t), NOW))


@query(
    "read_atom",
    BASE,
    f""", {ITEMS} SELECT source_id, 'tag:' || n AS external_id, {TITLE} AS title, url, published_at, {BODY} AS summary, 'term' || (n % 7) AS categories, 'Writer ' || (n % 5) AS author FROM items""",
)
def read_atom(t):
    i = _items(t)
    stamp = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    s = lambda c: c.cast("string")
    lines = i.select(
        "source_id", "n",
        F.concat(
            F.lit("<entry>"), _xml("id", F.concat(F.lit("tag:"), s(F.col("n")))), _xml("title", F.col("title")),
            F.lit('<link rel="self" href="https://no.example.com/"/><link rel="alternate" href="'), F.col("url"), F.lit('"/>'),
            F.when(F.col("n") % 2 == 0, _xml("published", stamp)).otherwise(""), _xml("updated", stamp), F.lit("<author><name>Writer "), s(F.col("n") % 5),
            F.lit('</name></author><category term="term'), s(F.col("n") % 7), F.lit('"/>'), _xml("summary", _html(F.col("excerpt"))), F.lit("</entry>"),
        ).alias("value"),
    )
    return _flat(readers.read_atom(t.spark, _land_feeds(lines, *ATOM), _no_keywords(t), NOW), "author")


@query(
    "read_arxiv",
    BASE,
    f""", {ITEMS} SELECT source_id, '2401.' || n || 'v1' AS external_id, {TITLE} AS title, 'http://arxiv.org/abs/2401.' || n || 'v1' AS url, published_at, {BODY} AS summary, 'cs.AI|cs.LG' AS categories,
    'A. Writer, B. Writer' AS author, 'http://arxiv.org/pdf/' || n AS pdf_url, 'cs.AI' AS primary_category FROM items""",
)
def read_arxiv(t):
    n = F.col("n").cast("string")
    lines = _items(t).select(
        "source_id", F.col("n").alias("n"),
        F.concat(
            F.lit("<entry><id>http://arxiv.org/abs/2401."), n, F.lit("v1</id>"), _xml("title", F.col("title")),
            _xml("published", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")), _xml("summary", _html(F.col("excerpt"))),
            F.lit("<author><name>A. Writer</name></author><author><name>B.  Writer</name></author><category term=\"cs.AI\"/><category term=\"cs.LG\"/>"),
            F.lit('<arxiv:primary_category xmlns:arxiv="http://arxiv.org/schemas/atom" term="cs.AI"/>'),
            F.lit('<link rel="related" type="application/pdf" href="http://arxiv.org/pdf/'), n, F.lit('"/></entry>'),
        ).alias("value"),
    )
    path = lambda p: F.get_json_object("payload", f"$.rawPayload.{p}")
    r = readers.read_arxiv(t.spark, _land_feeds(lines, *ATOM), _no_keywords(t), NOW)
    return _flat(r, "author", path("pdfUrl").alias("pdf_url"), path("primaryCategory").alias("primary_category"))


def _json_lines(rows, body):
    return rows.select("source_id", F.to_json(body).alias("value"))


@query(
    "read_crossref",
    BASE,
    f""", {ITEMS} SELECT source_id, CASE WHEN n % 4 = 0 THEN 'https://work.example.com/' || n ELSE '10.1/' || n END AS external_id, {TITLE} AS title,
    CASE WHEN n % 4 < 2 THEN 'https://work.example.com/' || n ELSE 'https://doi.org/10.1/' || n END AS url,
    CASE n % 3 WHEN 0 THEN TIMESTAMP '2023-01-01' WHEN 1 THEN TIMESTAMP '2023-05-01' ELSE TIMESTAMP '2023-05-17' END AS published_at, {BODY} AS summary, 'Computing' AS categories, 'Ada L, Anon' AS author FROM items""",
)
def read_crossref(t):
    n = F.col("n")
    doi = F.concat(F.lit("10.1/"), n.cast("string"))
    page = F.concat(F.lit("https://work.example.com/"), n.cast("string"))
    parts = F.when(n % 3 == 0, F.array(F.lit(2023))).when(n % 3 == 1, F.array(F.lit(2023), F.lit(5))).otherwise(F.array(F.lit(2023), F.lit(5), F.lit(17)))
    person = lambda g, f, x: F.struct(F.lit(g).alias("given"), F.lit(f).alias("family"), F.lit(x).alias("name"))
    item = F.struct(
        F.when(n % 4 != 0, doi).alias("DOI"), F.when(n % 4 < 2, page).alias("URL"), F.array("title").alias("title"),
        F.concat(F.lit("<p>"), "excerpt", F.lit("</p> <b>tail</b>")).alias("abstract"), F.array(person("Ada", "L", None), person(None, None, "Anon")).alias("author"),
        F.array(F.lit("Computing")).alias("subject"), F.struct(F.array(parts).alias("date-parts")).alias("published-print"),
    )
    lines = _json_lines(_items(t), F.struct(F.struct(F.lit(9).alias("total-results"), F.array(item).alias("items")).alias("message")))
    return _flat(readers.read_crossref(t.spark, _land(lines), _no_keywords(t), NOW, multi_line=False), "author")


@query(
    "read_semantic_scholar",
    BASE,
    f""", {ITEMS} SELECT source_id, CASE WHEN n % 3 = 0 THEN '10.2/' || n ELSE 'paper' || n END AS external_id, {TITLE} AS title, 'https://doi.org/10.2/' || n AS url,
    CASE WHEN n % 2 = 0 THEN TIMESTAMP '2022-01-01' ELSE TIMESTAMP '2022-03-04' END AS published_at, CASE WHEN n % 5 = 0 THEN 'short note' ELSE {BODY} END AS summary, 'CS|Math' AS categories FROM items""",
)
def read_semantic_scholar(t):
    n = F.col("n")
    paper = F.struct(
        F.when(n % 3 != 0, F.concat(F.lit("paper"), n.cast("string"))).alias("paperId"),
        F.struct(F.concat(F.lit("10.2/"), n.cast("string")).alias("DOI")).alias("externalIds"), F.col("title"), F.lit(2022).alias("year"),
        F.when(n % 2 == 1, "2022-03-04").alias("publicationDate"),
        F.when(n % 5 != 0, F.concat(F.lit("<p>"), "excerpt", F.lit("</p> <b>tail</b>"))).alias("abstract"),
        F.struct(F.lit("short note").alias("text")).alias("tldr"), F.array(F.lit("CS")).alias("fieldsOfStudy"),
        F.array(F.struct(F.lit("Math").alias("category")), F.struct(F.lit("CS").alias("category"))).alias("s2FieldsOfStudy"),
    )
    lines = _json_lines(_items(t), F.struct(F.lit(1).alias("total"), F.array(paper).alias("data")))
    return _flat(readers.read_semantic_scholar(t.spark, _land(lines), _no_keywords(t), NOW, multi_line=False))


@query(
    "read_newsapi",
    BASE,
    f""", {ITEMS} SELECT source_id, url AS external_id, {TITLE} AS title, url, published_at, CASE WHEN n % 2 = 0 THEN {BODY} ELSE 'body text' END AS summary, 'Paper ' || (n % 3) AS categories FROM items""",
)
def read_newsapi(t):
    n = F.col("n")
    article = F.struct(
        F.struct(F.concat(F.lit("Paper "), (n % 3).cast("string")).alias("name")).alias("source"), "title", "url",
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
        F.when(n % 2 == 0, F.concat(F.lit("<p>"), "excerpt", F.lit("</p> <b>tail</b>"))).otherwise("").alias("description"), F.lit(" body  text ").alias("content"),
    )
    lines = _json_lines(_items(t), F.struct(F.lit("ok").alias("status"), F.array(article).alias("articles")))
    return _flat(readers.read_newsapi(t.spark, _land(lines), _no_keywords(t), NOW, multi_line=False))


@query(
    "read_hacker_news",
    BASE,
    f""", {ITEMS} SELECT source_id, CAST(n AS VARCHAR) AS external_id, {TITLE} AS title, CASE WHEN n % 2 = 0 THEN url ELSE 'https://news.ycombinator.com/item?id=' || n END AS url, published_at,
    {BODY} AS summary, 'hacker_news' AS categories, n % 40 AS comments FROM items WHERE n % 90 < 60 AND n % 7 <> 3 AND n % 11 <> 5 AND n % 13 <> 2
    AND contains(lower(concat_ws(' ', title, CASE WHEN n % 2 = 0 THEN url END, excerpt)), 'e')""",
)
def read_hacker_news(t):
    n = F.col("n")
    item = F.struct(
        n.alias("id"), F.when(n % 7 == 3, "job").otherwise("story").alias("type"), (n % 11 == 5).alias("deleted"), (n % 13 == 2).alias("dead"),
        F.unix_timestamp(F.col("published_at").cast("timestamp")).alias("time"), "title", F.when(n % 2 == 0, F.col("url")).alias("url"),
        F.concat(F.lit("<p>"), "excerpt", F.lit("</p> <b>tail</b>")).alias("text"), (n % 40).alias("descendants"), (n % 90).alias("position"),
    )
    lines = _json_lines(_items(t), item)
    plan = _no_keywords(t).withColumns({"fetch_limit": F.lit(60), "query": F.lit("E")})
    r = readers.read_hacker_news(t.spark, _land(lines), plan, NOW)
    return _flat(r, F.get_json_object("payload", "$.rawPayload.commentsCount").cast("long").alias("comments"))


@query(
    "read_product_hunt",
    BASE,
    f""", {ITEMS} SELECT source_id, CASE WHEN n % 3 = 0 THEN 'slug-' || n ELSE 'post' || n END AS external_id, {TITLE} AS title, url, published_at, {clean("excerpt")} AS summary, 'Tools|AI' AS categories, 'Mia, joe' AS author FROM items""",
)
def read_product_hunt(t):
    n = F.col("n").cast("string")
    stamp = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    node = lambda name: F.struct(F.struct(F.lit(name).alias("name")).alias("node"))
    maker = lambda name, user: F.struct(F.lit(name).alias("name"), F.lit(user).alias("username"))
    post = F.struct(
        F.when(F.col("n") % 3 != 0, F.concat(F.lit("post"), n)).alias("id"), F.concat(F.lit("slug-"), n).alias("slug"), F.col("title").alias("name"),
        F.col("excerpt").alias("tagline"), "url", F.when(F.col("n") % 2 == 0, stamp).alias("featuredAt"), stamp.alias("createdAt"),
        (F.col("n") % 9).alias("votesCount"), F.struct(F.array(node("Tools"), node(" AI ")).alias("edges")).alias("topics"),
        F.array(maker("Mia", "m"), maker("", "joe")).alias("makers"),
    )
    posts = F.struct(F.struct(F.lit(1).alias("totalCount"), F.array(F.struct(post.alias("node"))).alias("edges")).alias("posts"))
    lines = _json_lines(_items(t), F.struct(posts.alias("data")))
    return _flat(readers.read_product_hunt(t.spark, _land(lines), _no_keywords(t), NOW, multi_line=False), "author")


# --- pages ----------------------------------------------------------------------------

_B = "html"
for _e in page_ops.SKIPPED:
    _B = f"regexp_replace({_B}, '(?is)<{_e}[\\s>].*?</{_e}\\s*>', ' ', 'g')"
_B = _B.replace("(html,", "(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'),", 1)


def _unescape(e):
    for name, char in [("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("#39", "''"), ("amp", "&")]:
        e = f"replace({e}, '&{name};', '{char}')"
    return e


def _plain(e):
    return clean(_unescape(f"regexp_replace({e}, '(?s)<[^>]*>', ' ', 'g')"))


PAGES = f"""visible AS (SELECT page_id, url, html, {_B} AS body FROM pages),
  parts AS (SELECT *, regexp_extract(body, '(?is)<article[^>]*>(.*?)</article\\s*>', 1) AS art, regexp_extract(body, '(?is)<body[^>]*>(.*?)</body\\s*>', 1) AS whole FROM visible),
  extracted AS (SELECT page_id, url, {clean(_unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title,
    nullif(regexp_extract(regexp_extract(html, '(?is)(<html\\s[^>]*>)', 1), '(?is)\\slang\\s*=\\s*"([^"]*)"', 1), '') AS language,
    coalesce({_plain('art')}, {_plain('whole')}) AS page_text, CASE WHEN {_plain('art')} IS NOT NULL THEN 'article' ELSE 'body' END AS extractor FROM parts)"""


@query("extract_pages", (), f"WITH {PAGES} SELECT * FROM extracted")
def extract_pages(t):
    return page_ops.extract_pages(t.pages).select("page_id", "url", "title", "language", "page_text", "extractor")


# Pages of other builds: an article inside the article, blocks instead of articles, a list of links inside the text, links only.
def _rebuilt(t):
    html, k = F.col("html"), F.col("page_id") % 4
    quote = F.lit("</h1><article class='q'><p>Quoted words here.</p></article>")
    links = F.lit("</h1><div><a href='/1'>more</a> <a href='/2'>and more</a></div>")
    block = lambda inside: F.replace(F.replace(F.replace(html, F.lit("<article>"), F.lit("<div class='x'><section>")), F.lit("</article>"), F.lit("</section></div>")), F.lit("</h1>"), inside)
    listed = F.concat(F.lit("<html><body><div><a href='/a'>"), F.regexp_extract(html, "<title>([^<]*)</title>", 1), F.lit("</a></div><div><a href='/b'>b</a></div></body></html>"))
    return t.pages.withColumn(
        "html",
        F.when(k == 0, F.replace(html, F.lit("</h1>"), quote)).when(k == 1, block(F.lit("</h1>"))).when(k == 2, block(links)).otherwise(listed),
    )


@query(
    "extract_rebuilt_pages",
    (),
    f"""WITH {PAGES}, given AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN regexp_replace(art, '</h1>', ' </h1> Quoted words here. ') WHEN page_id % 4 = 3 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) || ' b' ELSE art END AS raw FROM parts)
    SELECT page_id, {_plain('raw')} AS page_text, CASE page_id % 4 WHEN 0 THEN 'article' WHEN 3 THEN 'body' ELSE 'block' END AS extractor FROM given""",
)
def extract_rebuilt_pages(t):
    return page_ops.extract_pages(_rebuilt(t)).select("page_id", "page_text", "extractor")


# --- normalizers: the record of each document under the type of its source ------------------


def _raw(t):
    """Raw items of the research, product and page-backed sources from landed payloads."""
    n = F.col("n")
    i = t.articles.select(
        "source_id", F.substring("article_id", 5, 20).cast("long").alias("n"), _safe("title").alias("title"), _safe("text_for_ai").alias("excerpt"), "published_at"
    ).join(t.sources.select("source_id", "source_type"), "source_id")
    inner = F.struct(
        F.when(n % 2 == 0, F.concat(F.lit("10.9/"), n.cast("string"))).alias("DOI"), (n % 100).alias("citationCount"), (n % 50).alias("votesCount"),
        (n % 20).alias("commentsCount"), F.lit("https://site.example.com/").alias("website"), F.concat(F.lit("About "), "excerpt").alias("description"),
        F.struct(F.concat(F.lit("https://pdf.example.com/"), n.cast("string")).alias("url")).alias("openAccessPdf"), (n % 300).alias("score"),
    )
    payload = F.to_json(
        F.struct(
            "title", F.when(n % 3 != 0, F.concat(F.lit("https://papers.example.com/"), n.cast("string"))).alias("url"),
            F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("publishedAt"), F.array(F.lit("Ada L"), F.lit("Bo M")).alias("authors"),
            F.when(n % 5 != 0, F.col("excerpt")).alias("summary"), F.array(F.lit("c1"), F.lit("c2")).alias("categories"), inner.alias("rawPayload"),
        )
    )
    at = F.lit(NOW).cast("timestamp")
    return i.select(
        "source_id", F.concat(F.lit("x"), n.cast("string")).alias("external_id"), payload.alias("payload"), F.lit("h").alias("content_hash"),
        F.lit("{}").alias("response_meta"), at.alias("first_fetched_at"), at.alias("last_fetched_at"), F.lit(0).cast("bigint").alias("duplicate_fetch_count"),
    )


RAWS = f"""{ITEMS}, raws AS (SELECT i.*, s.source_type, s.name, s.language AS lang, {clean('title')} AS t, CASE WHEN n % 5 <> 0 THEN {clean('excerpt')} END AS a,
    {clean("'About ' || excerpt")} AS d, CASE WHEN n % 3 <> 0 THEN 'https://papers.example.com/' || n END AS u, strftime(published_at, '%Y-%m-%dT%H:%M:%S.000Z') AS p
  FROM items i JOIN sources s ON s.source_id = i.source_id)"""


@query(
    "normalize_research",
    BASE,
    f""", {RAWS} SELECT source_id, coalesce(u, 'https://pdf.example.com/' || n) AS canonical_url, t AS title, lang AS language,
    CASE WHEN length(coalesce(a, d)) <= 320 THEN coalesce(a, d) ELSE trim(substr(coalesce(a, d), 1, 319)) || '...' END AS excerpt, 'Ada L, Bo M' AS author, published_at,
    concat_ws(chr(10), 'Source type: ' || source_type, 'Source name: ' || name, 'Title: ' || t, 'Authors: Ada L, Bo M', 'Published: ' || p, 'Categories: c1, c2', 'DOI: ' || CASE WHEN n % 2 = 0 THEN '10.9/' || n END,
      CASE WHEN source_type = 'arxiv' THEN 'arXiv ID: x' || n END, 'PDF: https://pdf.example.com/' || n, 'Canonical URL: ' || coalesce(u, 'https://pdf.example.com/' || n),
      'Citation count: ' || (n % 100), 'Abstract:' || chr(10) || coalesce(a, d), 'Raw item external ID: x' || n) AS text_for_ai
    FROM raws WHERE source_type IN ('arxiv', 'semantic_scholar', 'crossref')""",
)
def normalize_research(t):
    out = normalize.normalize_research(_raw(t), t.sources)
    return out.select(
        "source_id", "canonical_url", "title", "language", "excerpt", "author", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "text_for_ai"
    )


@query(
    "normalize_product",
    BASE,
    f""", {RAWS} SELECT source_id, coalesce(u, 'https://site.example.com/') AS canonical_url, t AS title, coalesce(a, CASE WHEN length(d) <= 320 THEN d ELSE trim(substr(d, 1, 319)) || '...' END) AS excerpt, published_at,
    concat_ws(chr(10), 'Source type: ' || source_type, 'Source name: ' || name, 'Product: ' || t, 'Tagline: ' || a, 'Description: ' || d, 'Makers: Ada L, Bo M', 'Topics: c1, c2', 'Launched: ' || p,
      'Product Hunt URL: ' || coalesce(u, 'https://site.example.com/'), 'Website: https://site.example.com/', 'Votes: ' || (n % 50), 'Comments: ' || (n % 20), 'Raw item external ID: x' || n) AS text_for_ai,
    n % 20 AS community_comments, n % 50 AS community_votes FROM raws WHERE source_type = 'product_hunt'""",
)
def normalize_product(t):
    out = normalize.normalize_product(_raw(t), t.sources)
    return out.select(
        "source_id", "canonical_url", "title", "excerpt", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "text_for_ai", "community_comments", "community_votes"
    )


def _paged(t):
    """Raw items that point at the pages of the page table."""
    kinds = t.sources.filter(F.col("source_type").isin(*normalize.PAGE_TYPES)).agg(F.min("source_id").alias("source_id"))
    raw = t.pages.join(F.broadcast(kinds), F.lit(True)).select(  # one row
        "source_id", F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("external_id"),
        F.to_json(F.struct("url", F.lit("given").alias("title"), F.lit("given summary").alias("summary"), F.lit("2024-01-02T03:04:05Z").alias("publishedAt"))).alias("payload"),
    )
    at = F.lit(NOW).cast("timestamp")
    return raw.withColumns({"content_hash": F.lit("h"), "response_meta": F.lit("{}"), "first_fetched_at": at, "last_fetched_at": at, "duplicate_fetch_count": F.lit(0)})


@query(
    "normalize_article",
    BASE,
    f""", {PAGES} SELECT 'page' || e.page_id AS external_id, coalesce(title, 'given') AS title, coalesce(e.language, s.language) AS language, 'given summary' AS excerpt,
    coalesce(page_text, 'given summary') AS text_for_ai, TIMESTAMP '2024-01-02 03:04:05' AS published_at, sha256(coalesce(page_text, 'given summary')) AS content_hash
    FROM extracted e, (SELECT language FROM sources WHERE source_type IN ('rss', 'atom', 'newsapi', 'hacker_news') ORDER BY source_id LIMIT 1) s""",
)
def normalize_article(t):
    raw = _paged(t)
    out = normalize.normalize_article(raw, page_ops.extract_pages(t.pages), t.sources)
    names = raw.select(normalize.raw_item_id().alias("raw_item_id"), "external_id")
    return out.join(names, "raw_item_id").select(
        "external_id", "title", "language", "excerpt", "text_for_ai", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "content_hash"
    )


@query(
    "normalize_errors",
    BASE,
    f""", {RAWS} SELECT source_id, 'x' || n AS external_id, 'process_failed' AS error_category FROM raws WHERE source_type IN ('rss', 'atom', 'newsapi', 'hacker_news')""",
)
def normalize_errors(t):
    _, errors = normalize.normalize(_raw(t), t.sources, page_ops.extract_pages(t.pages))
    return errors.select("source_id", "external_id", "error_category")


@query(
    "normalize_error_kinds",
    BASE,
    f""", {RAWS}, known AS (SELECT source_id, CASE WHEN family = 'policy' THEN 'podcast' ELSE source_type END AS kind FROM sources WHERE family <> 'funding')
    SELECT r.source_id, 'x' || n AS external_id, CASE WHEN k.source_id IS NULL THEN 'source_not_found' WHEN kind = 'podcast' THEN 'unsupported_source_type' ELSE 'process_failed' END AS error_category
    FROM raws r LEFT JOIN known k ON k.source_id = r.source_id WHERE k.source_id IS NULL OR kind IN ('podcast', 'rss', 'atom', 'newsapi', 'hacker_news')""",
)
def normalize_error_kinds(t):
    """Raw items of sources that were removed, of a type nobody reads, and without a page."""
    known = t.sources.filter("family <> 'funding'").withColumn("source_type", F.when(F.col("family") == "policy", "podcast").otherwise(F.col("source_type")))
    _, errors = normalize.normalize(_raw(t), known, page_ops.extract_pages(t.pages))
    return errors.select("source_id", "external_id", "error_category")


@query(
    "seeded_sources",
    ("sources",),
    """ SELECT family, CAST(sum(n) AS BIGINT) AS sources, CAST(sum(enabled) AS BIGINT) AS enabled, CAST(sum(trust) AS BIGINT) AS trust, CAST(sum(minutes) AS BIGINT) AS minutes FROM (
      SELECT family, 1 AS n, CASE WHEN enabled THEN 1 ELSE 0 END AS enabled, round(trust_score * 100) AS trust, fetch_interval_minutes AS minutes FROM sources
      UNION ALL SELECT * FROM (VALUES ('company_announcement', 3, 2, 277, 300), ('research', 4, 2, 340, 1320), ('technology_media', 16, 15, 1156, 3120),
        ('product_launch', 2, 1, 144, 900), ('community', 1, 1, 58, 30)) v(family, n, enabled, trust, minutes)) GROUP BY family""",
)
def seeded_sources(t):
    """The starting list put into the stored sources; a second time changes nothing."""
    from storyloom.plans.batch import conform
    from storyloom.schemas import SOURCES

    seeds, rest = registry.seed_sources(t.spark), [f.name for f in SOURCES.fields if f.name != "source_id"]
    once = tables.upsert(conform(t.sources, SOURCES), seeds, ["source_id"], rest)
    stored = tables.upsert(once, seeds, ["source_id"], rest)
    return stored.groupBy("family").agg(
        F.count("*").alias("sources"), F.count_if("enabled").alias("enabled"), F.sum(F.round(F.col("trust_score") * 100).cast("long")).alias("trust"),
        F.sum("fetch_interval_minutes").alias("minutes"),
    )


# Landed lines of a plugged-in format, and the same items as a news payload; read as a batch and as a stream.
@query(
    "read_landing",
    BASE,
    f""", {ITEMS}, kinds AS (SELECT * FROM (VALUES ('lines'), ('newsapi')) k(kind)), ways AS (SELECT * FROM (VALUES ('batch'), ('stream')) w(way))
    SELECT way, kind, source_id, CASE kind WHEN 'lines' THEN 'line-' || n ELSE url END AS external_id, {TITLE} AS title, url, published_at FROM items, kinds, ways""",
)
def read_landing(t):
    i = _items(t)
    root = f"{shared_folder(t.spark)}/landing-{uuid.uuid4().hex}"
    at = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = i.select("source_id", F.to_json(F.struct(F.concat(F.lit("line-"), F.col("n").cast("string")).alias("key"), F.col("title").alias("headline"), F.col("url").alias("link"), at.alias("time"))).alias("value"))
    lines.write.partitionBy("source_id").text(f"{root}/lines")
    article = F.struct("title", "url", at.alias("publishedAt"), F.col("excerpt").alias("description"))
    # Answers of at most 100 articles, up to 100 of them a file, written line by line: a file an answer would be one for every few articles.
    answers = i.select("source_id", F.floor(F.col("n") / 10_000).alias("file"), F.floor(F.col("n") / 100).alias("page"), "n", F.to_json(article).alias("article"))
    w = Window.partitionBy("source_id", "file").orderBy("page", "n")
    placed = answers.withColumn("before", F.lag("page").over(w)).withColumn("after", F.lead("page").over(w))
    opens = F.when(F.col("before").isNull(), "[{").when(F.col("before") != F.col("page"), "]},{")
    ends = F.when(F.col("after").isNull(), "]}]").otherwise("")
    value = F.concat(F.coalesce(F.concat(opens, F.lit('"status":"ok","articles":[')), F.lit(",")), "article", ends)
    placed.select(value.alias("value"), "source_id", "file").write.partitionBy("source_id", "file").text(f"{root}/newsapi")

    def read_lines(spark, path, sources, fetched_at):
        rows = spark.read.schema("key STRING, headline STRING, link STRING, time STRING, source_id STRING").json(path)
        return readers.records(
            rows, sources, fetched_at, external_id=F.col("key"), title=readers.clean_text("headline"), url=F.col("link"),
            published_at=readers.to_ts("time"), summary=F.lit(None).cast("string"), raw=F.struct("key"),
        )

    readers.register_reader("lines", read_lines)
    kinds = ["lines", "newsapi"]
    every = _no_keywords(t)
    sources = {k: every.withColumn("source_type", F.lit(k)) for k in kinds}
    out = None
    for kind in kinds:
        once = readers.read_landing(t.spark, root, sources[kind], NOW, [kind])
        path, ckpt = (f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}" for name in ("records", "ckpt"))
        flow = readers.read_landing(t.spark, root, sources[kind], NOW, [kind], stream=True)
        flow.writeStream.format("parquet").option("path", path).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
        for way, rows in (("batch", once), ("stream", t.spark.read.schema(once.schema).parquet(path))):
            part = rows.select(
                F.lit(way).alias("way"), F.lit(kind).alias("kind"), "source_id", "external_id", "title", "url", F.col("published_at").cast("timestamp_ntz").alias("published_at")
            )
            out = part if out is None else out.unionByName(part)
    return out


@query(
    "article_candidates",
    BASE,
    """ SELECT article_id FROM articles WHERE coalesce(canonical_url, '') <> '' AND coalesce(title, '') <> '' AND coalesce(text_for_ai, '') <> '' AND coalesce(published_at >= TIMESTAMP '2024-01-05 00:00:00', true)""",
)
def article_candidates(t):
    known = t.articles.filter("published_at < TIMESTAMP_NTZ '2024-01-05 00:00:00'").select("raw_item_id")  # made by an earlier run
    return normalize.article_candidates(t.articles, known).select("article_id")


# --- tables ------------------------------------------------------------------------------


@query(
    "upsert",
    ("signal_topics_fx", "suggestions_fx"),
    """ SELECT coalesce(s.signal_id, o.signal_id) AS signal_id, coalesce(s.topic_slug, o.topic_slug) AS topic_slug, o.method, CASE WHEN s.signal_id IS NOT NULL THEN s.confidence ELSE o.confidence END AS confidence
    FROM signal_topics_fx o FULL JOIN suggestions_fx s ON s.signal_id = o.signal_id AND s.topic_slug = o.topic_slug""",
)
def upsert(t):
    return tables.upsert(t.signal_topics_fx, t.suggestions_fx, ["signal_id", "topic_slug"], ["confidence"])


@query(
    "retract",
    ("relations_fx", "sources"),
    " SELECT relation_type, article_id, target_article_id FROM relations_fx WHERE relation_type <> 'duplicate_candidate'",
)
def retract(t):
    r = t.relations_fx
    keys = ["relation_type", "source_id", "article_id", "signal_id", "target_article_id"]
    return tables.retract(r, r.filter("relation_type = 'duplicate_candidate'").select(*keys), keys).select("relation_type", "article_id", "target_article_id")


@query("load_sources", BASE, " SELECT source_id, name, source_type, family, language, trust_score, enabled FROM sources")
def load_sources(t):
    path = f"{shared_folder(t.spark)}/sources-{uuid.uuid4().hex}"
    t.sources.write.json(path)
    return registry.load_sources(t.spark, path).select("source_id", "name", "source_type", "family", "language", "trust_score", "enabled")


@query("write_documents", ("links_fx",), " SELECT signal_id, article_id, role FROM links_fx")
def write_documents(t):
    path = f"{shared_folder(t.spark)}/documents-{uuid.uuid4().hex}"
    tables.write_documents(t.links_fx, path)
    return t.spark.read.schema("signal_id STRING, article_id STRING, role STRING").json(path)


# --- address and name helpers over the page and article tables ---------------------------------


@query(
    "strip_tracking",
    (),
    r"""SELECT page_id, CASE WHEN q = '' THEN base ELSE base || '?' || q END AS clean_url
    FROM (SELECT page_id, base, array_to_string(list_filter(string_split(query, '&'), lambda p: NOT starts_with(p, 'utm_')), '&') AS q
      FROM (SELECT page_id, CASE WHEN contains(u, '/') THEN head || u ELSE head || u || '/' END AS base, query
        FROM (SELECT page_id, split_part(url, '://', 1) || '://' AS head,
            regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') AS u, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages)))""",
)
def strip_tracking(t):
    from storyloom.functions.urls import strip_tracking as strip

    return t.pages.select("page_id", strip("url").alias("clean_url"))


@query(
    "slugify",
    BASE,
    """ SELECT article_id, coalesce(nullif(substr(trim(regexp_replace(lower(title), '[^a-z0-9一-鿿]+', '-', 'g'), '-'), 1, 72), ''), 'signal') || '-' || right(article_id, 4) AS slug FROM articles""",
)
def slugify(t):
    from storyloom.functions.text import slugify as slug

    return t.articles.select("article_id", slug("title", F.substring("article_id", -4, 4)).alias("slug"))


@query(
    "fallback_external_id",
    BASE,
    """ SELECT article_id, sha256(concat_ws('|', title, canonical_url, strftime(published_at, '%Y-%m-%dT%H:%M:%S.000Z'))) AS external_id FROM articles""",
)
def fallback_external_id(t):
    return t.articles.select("article_id", readers.fallback_external_id(F.col("title"), F.col("canonical_url"), F.col("published_at")).alias("external_id"))
