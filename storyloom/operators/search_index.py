"""An inverted index of article texts: which articles hold which white-space separated token.

Query terms hold no white space, so a term that stands anywhere in a text stands
inside one of its tokens: a search for substrings looks through the vocabulary,
reads the postings of the tokens that hold a term, and never a text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import STR, shape
from ..sources.keyed import KeyedTable
from .lineage import cut

TEXTS = ("title", "excerpt", "text_for_ai")
POSTINGS = shape((STR, "token article_id"))


def postings(articles: DataFrame) -> DataFrame:
    """Distinct (token, article_id) of all texts, lower-cased."""
    parts = [F.split(F.lower(F.coalesce(c, F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+") for c in TEXTS]
    tokens = F.array_distinct(F.concat(*parts))
    return articles.select(F.explode(tokens).alias("token"), "article_id").filter("token <> ''")


@dataclass
class SearchIndex:
    """Postings and the distinct tokens they are filed under."""

    postings: DataFrame
    vocabulary: DataFrame

    @staticmethod
    def of(articles: DataFrame) -> SearchIndex:
        """An index written once for the session, filed by token."""
        rows = cut(postings(articles).repartition("token").sortWithinPartitions("token"))
        return SearchIndex(rows, cut(rows.select("token").distinct()))

    def matches(self, terms: list[str]) -> DataFrame:
        """(article_id, mask): bit i is set if a token of the article holds term i; at most 60 terms."""
        mask = F.lit(0).cast("long")
        for i, term in enumerate(terms):
            mask = mask + F.when(F.col("token").contains(term), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        found = self.vocabulary.withColumn("mask", mask).filter("mask <> 0")
        return self.postings.join(found, "token").groupBy("article_id").agg(F.bit_or("mask").alias("mask"))


class StoredIndex:
    """Postings kept in a keyed table, filed by article, so that a change of articles rewrites their parts only."""

    def __init__(self, spark: SparkSession, name: str, path: str, parts: int = 64):
        self.table = KeyedTable(spark, name, path, POSTINGS, ["article_id", "token"], parts=parts, part_by=["article_id"])

    def update(self, changed: DataFrame, gone: DataFrame | None = None) -> list[int]:
        """Replace the postings of ``changed`` articles and drop those of ``gone`` ones (article_id); the parts written."""
        return self.table.replace(cut(postings(changed)), changed.select("article_id") if gone is None else changed.select("article_id").unionByName(gone.select("article_id")))

    def read(self) -> SearchIndex:
        rows = self.table.read()
        return SearchIndex(rows, cut(rows.select("token").distinct()))


def hit_columns(index: SearchIndex, ids: DataFrame, parts: list[list[str]], names: list[str]) -> DataFrame:
    """(signal_id, members_<name>...) bits of the terms that the members in ``ids`` (signal_id, article_id) hold."""
    out = None
    for name, terms in zip(names, parts, strict=True):
        hits = ids.join(index.matches(terms), "article_id").groupBy("signal_id").agg(F.bit_or("mask").alias(f"members_{name}"))
        out = hits if out is None else out.join(hits, "signal_id", "full")
    return out

