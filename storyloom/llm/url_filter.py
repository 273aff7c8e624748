"""URL filter: host and path rules, and a character language-model ratio for the rest.

URLs that a rule allows train one variable-order Markov model over characters,
URLs that a rule blocks another.  Orders are interpolated after Witten and Bell,
so a context that was never seen hands all its weight to the next shorter one.
The mean log-likelihood difference per character, with a threshold calibrated
on rule-labelled URLs that took no part in training, decides the others.
DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, small

MAX_ORDER = 3
FOLDS = 5  # one of these many parts of the labelled URLs calibrates, the others train
UNIT = 1_000_000  # log ratios are whole millionths, so sums don't depend on their order
BIN = 0.01  # width of a calibration bin, in nats a character
REACH = 20.0  # calibration looks at thresholds within +-REACH
ALPHABET = 65_536  # characters over which the order below 0 is uniform
START, END = "\u0002", "\u0003"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest (verdict, host, path) rule that fits; null where none does.

    A rule fits its host and all subdomains if the path starts with the rule's.
    ``rules`` is a short list; of equally long rules the first in text order wins.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(start))
        text, verdict = F.when(fits, F.lit(at + start)).otherwise(text), F.when(fits, F.lit(action)).otherwise(verdict)
    return text, verdict


def grams(rows: DataFrame, order: int) -> DataFrame:
    """One row per character of ``host + path`` and its end, with the ``order`` characters before it."""
    chars = F.split(F.concat(F.lit(START * order), F.col("host"), F.col("path"), F.lit(END)), "")
    chars = F.filter(chars, lambda c: c != "")
    each = F.transform(
        F.sequence(F.lit(1), F.size("chars") - order), lambda i: F.array_join(F.slice("chars", i, order + 1), "")
    )
    return rows.withColumn("chars", chars).select(*[c for c in rows.columns if c not in ("host", "path")], F.explode(each).alias("gram"))


def gram_ratios(train: DataFrame, asked: DataFrame, order: int = MAX_ORDER) -> DataFrame:
    """(gram, ratio): millionths of ln P(allow) - ln P(block) of a gram's last character after the others.

    ``train`` has verdict, host and path.  ``asked`` has the distinct grams to answer.
    """
    counts = cut(
        grams(train.select("verdict", "host", "path"), order)
        .groupBy("gram")
        .agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
    )
    out = asked.select("gram", F.lit(1.0 / ALPHABET).alias("pa"), F.lit(1.0 / ALPHABET).alias("pb"))
    for j in range(order + 1):
        # Full grams of which the last j + 1 characters are the same are one gram of order j.
        suffix = F.substr("gram", F.lit(order - j + 1), F.lit(j + 1))
        by_gram = counts.groupBy(suffix.alias("g")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        by_context = by_gram.groupBy(F.substr("g", F.lit(1), F.lit(j)).alias("h")).agg(
            F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("b") > 0).alias("tb")
        )
        out = (
            out.withColumns({"g": suffix, "h": F.substr("gram", F.lit(order - j + 1), F.lit(j))})
            .join(small(cut(by_gram)), "g", "left")
            .join(small(cut(by_context)), "h", "left")
        )
        for c in "ab":
            n, total, kinds = (F.coalesce(F.col(x), F.lit(0)) for x in (c, f"n{c}", f"t{c}"))
            p = F.when(total > 0, (n + kinds * F.col(f"p{c}")) / (total + kinds)).otherwise(F.col(f"p{c}"))
            out = out.withColumn(f"p{c}", p)
        out = out.select("gram", "pa", "pb")
    return out.select("gram", F.round((F.log("pa") - F.log("pb")) * UNIT).cast("long").alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """The score from which on a URL is allowed: the middle between two neighbouring bins with the
    largest share of allowed URLs above it less that of blocked ones; of equals the one nearest to 0.

    ``scored`` has verdict, score and times (how often the URL occurs) of held-out
    labelled URLs.  0 if one kind is missing.
    """
    place = F.floor(F.greatest(F.least("score", F.lit(REACH)), F.lit(-REACH)) / BIN).cast("int")
    bins = scored.groupBy(place.alias("place")).agg(
        F.sum(F.when(F.col("verdict") == "allow", F.col("times")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("verdict") == "block", F.col("times")).otherwise(0)).alias("b"),
    )
    rest = Window.orderBy(F.desc("place"))  # at most 2 * REACH / BIN rows
    whole = Window.partitionBy(F.lit(0))
    share = lambda c: F.try_divide(F.sum(c).over(rest), F.sum(c).over(whole))
    gain = share("a") - share("b")
    edge = (F.col("place") + F.coalesce(F.lead("place").over(Window.orderBy(F.desc("place"))) + 1, F.col("place"))) / 2
    best = bins.select(edge.alias("edge"), gain.alias("gain")).filter(F.col("gain").isNotNull()).orderBy(F.desc("gain"), F.abs("edge"), "edge").first()
    return best.edge * BIN if best else 0.0


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], order: int = MAX_ORDER, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score, threshold), one row per input row.

    A null or malformed URL has empty host and path, fits no rule and is judged
    by the model on its end mark alone.  Rows that repeat a page_id are judged
    each for itself.  Where one kind of training URLs is missing there is no
    ratio: score is 0 and the verdict is allow.
    """
    host, path = host_and_path(F.col(url_column))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = cut(
        pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
        .select("*", rule.alias("rule"), verdict.alias("verdict"))
    )
    texts = urls.groupBy("host", "path", "verdict").agg(F.count("*").alias("times"))  # equal URLs are scored once
    held = F.pmod(F.crc32(F.concat("host", "path")), F.lit(FOLDS)) == 0
    train = urls.filter(F.col("verdict").isNotNull() & ~held)
    kinds = train.agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b")).first()
    if not kinds.a or not kinds.b:
        return urls.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"), F.lit(0.0).alias("threshold"))
    each = grams(texts.select("host", "path", F.struct("host", "path", "verdict", "times").alias("key")), order)
    ratios = cut(gram_ratios(train, each.select("gram").distinct(), order))
    scored = cut(
        each.join(small(ratios), "gram")
        .groupBy("key")
        .agg((F.sum("ratio") / F.count("*") / UNIT).alias("score"))
        .select("key.*", "score")
    )
    at = threshold(scored.filter(F.col("verdict").isNotNull() & held))
    scores = scored.select("host", "path", "score")
    return urls.join(scores, ["host", "path"]).select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("score") >= at, "allow").otherwise("block")).alias("verdict"),
        "score", F.lit(at).alias("threshold"),
    )
