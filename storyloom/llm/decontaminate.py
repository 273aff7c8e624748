"""Benchmark decontamination with a distributed positional inverted index.

The index stores one posting (word, document, position) per document word that
test items use, in segments of documents.  A phrase is found from its rarest
words: the postings of the rarest give (document, start) candidates by taking
off the word's place in the phrase, the next rarest words' postings are
intersected at their own offsets, and what remains is compared with the
document's words.  With a slack the same intersection gives proximity matches.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, key_join, small, text_of

WINDOW = 10  # words of a phrase
ANCHORS = 2  # rarest words of a phrase whose postings are intersected before the exact check
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same on text that is not yet lower-cased.
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
DOC_END = "\u0000end"  # the posting that every document has once; its position is the number of words
DOC = ["doc_id", "text_hash"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def phrases(items: DataFrame, window: int = WINDOW, id_column: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Distinct phrases (phrase, words, n) of all items and (phrase, item_id) of those that have them.

    An item of fewer words than ``window``, but not none, is one phrase.
    """
    tokens = items.select(F.col(id_column).alias("item_id"), words(text_of()).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = tokens.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), window).alias("words"))
    each = cut(each.select("item_id", F.concat_ws(" ", "words").alias("phrase"), "words"))
    distinct = each.select("phrase", "words").distinct().withColumn("n", F.size("words"))
    return cut(distinct), cut(each.select("phrase", "item_id").distinct())


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (word, doc_id, text_hash, pos) of the words in ``terms`` over whole documents, written once.

    Words no item asks for are left out.  Every document has the posting
    DOC_END, with its number of words as position.
    """
    raw = F.array_append(F.array_remove(F.split(text_of(), RAW_SEPARATORS), ""), F.lit(DOC_END))
    tokens = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), F.posexplode(raw).alias("pos", "raw"))
    # Only words that lower() changes need the exact A-Z mapping.
    lowered = F.when(F.lower("raw") == F.col("raw"), F.col("raw")).otherwise(ascii_lower(F.col("raw")))
    wanted = cut(terms.select("word").unionByName(docs.sparkSession.range(1).select(F.lit(DOC_END).alias("word"))).distinct())
    return cut(tokens.select(lowered.alias("word"), *DOC, "pos").join(small(wanted), "word"))


def anchors(index: DataFrame, asked: DataFrame, count: int = ANCHORS) -> DataFrame:
    """(phrase, n, rank, word, off): the ``count`` rarest words of each phrase, rarest first.

    Phrases with a word that no document has are left out.
    """
    counts = cut(index.groupBy("word").agg(F.count("*").alias("freq")))
    each = asked.select("phrase", "n", F.posexplode("words").alias("off", "word")).join(small(counts), "word", "left")
    found = each.groupBy("phrase", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "off", "word"))).alias("w"))
    found = found.filter(F.col("w")[0]["freq"] > 0)
    return cut(found.select("phrase", "n", F.posexplode(F.slice("w", 1, count)).alias("rank", "w")).select("phrase", "n", "rank", "w.word", "w.off"))


def intersect(index: DataFrame, rarest: DataFrame, count: int = ANCHORS, slack: int = 0) -> DataFrame:
    """Distinct (doc_id, text_hash, phrase, n, start) at which all of a phrase's anchors stand.

    With ``slack`` the other anchors may stand that many words off their place.
    """
    first = rarest.filter("rank = 0").select("phrase", "n", "word", "off")
    found = (
        index.join(small(first), "word")
        .select(*DOC, "phrase", "n", (F.col("pos") - F.col("off")).alias("start"))
        .filter("start >= 0" if not slack else "true")
        .distinct()
    )
    for rank in range(1, count):
        step = rarest.filter(F.col("rank") == rank).select("phrase", "word", "off")
        postings = index.join(small(cut(step.select("word").distinct())), "word", "left_semi")
        # Phrases of fewer words have no anchor of this rank and pass.
        asked = cut(found.join(small(step), "phrase", "left"))
        shifts = F.sequence(F.lit(-slack), F.lit(slack))
        places = asked.filter("word is not null").withColumn("shift", F.explode(shifts))
        places = places.withColumn("pos", F.col("start") + F.col("off") + F.col("shift"))
        held = key_join(places, postings.toDF(*postings.columns), ["word", *DOC, "pos"], "left_semi")
        kept = [*DOC, "phrase", "n", "start"]
        found = held.select(*kept).distinct().unionByName(asked.filter("word is null").select(*kept))
    return found


def exact(docs: DataFrame, asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates (doc_id, text_hash, phrase, n, start) whose words are those of the phrase."""
    per_doc = (
        candidates.join(small(asked.select("phrase", "words")), "phrase")
        .groupBy(*DOC)  # a document's own candidates
        .agg(F.collect_list(F.struct("phrase", "n", "start", "words")).alias("asked"))
    )
    texts = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    both = key_join(texts, cut(per_doc), DOC).withColumn("w", words(F.col("text")))
    right = F.filter("asked", lambda c: F.slice("w", c["start"] + 1, c["n"]) == c["words"])
    return both.select(*DOC, F.explode(right).alias("c")).select(*DOC, "c.phrase", "c.n", "c.start").distinct()


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = 0) -> dict[str, DataFrame | None]:
    """``index``, ``exact`` and ``near`` matches (doc_id, text_hash, phrase, n, start) and ``members`` (phrase, item_id).

    ``near`` (None without slack) has the places where a phrase's anchors stand
    within ``slack`` words of their order; it contains the exact ones.
    """
    asked, members = phrases(items, window)
    index = build_index(docs, asked.select(F.explode("words").alias("word")))
    rarest = anchors(index, asked)
    found = cut(exact(docs, asked, intersect(index, rarest)))
    near = cut(intersect(index, rarest, slack=slack)) if slack else None
    return {"index": index, "exact": found, "near": near, "members": members}


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated), one row per input row.

    A word inside any occurrence of a phrase is hit.  Null texts have no words;
    null ids are kept; rows that repeat an id are judged each by its own text;
    extra columns are ignored; without items nothing is hit.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    parts = matches(docs, items, window)
    spans = parts["exact"].groupBy(*DOC, "start").agg((F.col("start") + F.max("n")).alias("stop"))
    before = Window.partitionBy(*DOC).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("stop").over(before), F.lit(0))
    fresh = spans.select(*DOC, F.greatest(F.col("stop") - F.greatest("start", seen), F.lit(0)).alias("fresh"))
    hit = fresh.groupBy(*DOC).agg(F.sum("fresh").alias("n_hit"))
    phrases_hit = parts["exact"].select(*DOC, "phrase").distinct()
    item_rows = phrases_hit.join(small(parts["members"]), "phrase").select(*DOC, F.col("item_id").cast("string").alias("item")).distinct()
    listed = item_rows.groupBy(*DOC).agg(F.sort_array(F.collect_set("item")).alias("items"))
    base = parts["index"].filter(F.col("word") == DOC_END).select(*DOC, F.col("pos").cast("long").alias("n_words"))
    out = key_join(key_join(base, hit, DOC, "left"), listed, DOC, "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        *DOC, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_of), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no phrase of an item occurs; columns stay as they are."""
    hit = cut(decontaminate(docs, items, window).filter("contaminated").select(*DOC).distinct())
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(text_of()).alias("text_hash"))
    return key_join(rows, small(hit), DOC, "left_anti").select("row.*")
