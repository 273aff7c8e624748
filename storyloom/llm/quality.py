"""Quality classifier from weak labels.

Heuristic labellers vote junk, good or nothing.  Expectation-maximisation over
the counts of vote patterns estimates how each labeller votes on junk and on
good documents (its accuracies) and the share of junk; the posterior of each
pattern labels documents.  A linear scorer over hashed token shapes, fitted to
those posteriors, gives every document its score.  Shapes say nothing of words:
looped phrases and abuse are found in the words of each text and score 1.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, key_join, small, text_of

DIMS = 1_024  # hash buckets of the scorer
SAMPLE = 5_000  # documents that fit the scorer (bound); everything else covers all documents
ROUNDS = 50
NEUTRAL = 5  # tokens without weight that are added to every text, so a few words don't decide alone
THRESHOLD = 0.5
# Letters but capitals, and marks; ASCII is told by ranges, so most characters need no look-up of their class.
SMALL = r"[a-z[[\x{80}-\x{10FFFF}]&&[\p{L}\p{M}]&&[^\p{Lu}]]]+"
WINDOW = 1_000  # tokens over which variety is taken; a text's is the mean of its windows
GRAM, LOOPED = 4, 0.5  # words of a phrase; share of a text's phrases that are different, below which it is looped
ABUSIVE = 0.005  # share of abuse terms, two of them different, from which on a text is abusive
ABUSE = (
    "arschloch asshole asqueroso asquerosa abschaum bastard bastards basura cabrón clown clowns connard connards crétin crétins débile dégoûtant "
    "disgusting dreckskerl dumbass dummkopf dumm erbärmlich escoria estúpida estúpido estúpidos idiot idiota idiotas idiote idioten idiotes idiots "
    "imbecile imbeciles imbécil imbécile imbéciles loser losers minable moron morons ordure patética patético pathetic pathétique payaso payasos "
    "perdedor salaud salauds scum stupid stupide trash trottel versager wertlos widerlich worthless"
)
NAMES = ("symbols", "capitals", "bars", "repeats", "variety", "marks", "sentences", "letters", "plain")


def shaped(docs: DataFrame) -> DataFrame:
    """Adds ``tokens`` (white-space words) and ``shapes``: A for capitals, a for other letters, 0 for
    digits, other characters as they are, runs as one; ``=`` follows where a word repeats the one before.
    Letters are those of Unicode, with their marks; symbols beyond ASCII are none."""
    text = F.regexp_replace(F.regexp_replace(text_of(), r"\p{Lu}+", "A"), SMALL, "a")
    text = F.regexp_replace(F.regexp_replace(text, r"[0-9]+", "0"), r"([^\sAa0])\1+", "$1")
    blank = r"[\s\x{A0}]+"
    rows = docs.withColumns({"tokens": F.array_remove(F.split(text_of(), blank), ""), "plain": F.array_remove(F.split(text, blank), "")})
    again = lambda s, i: F.when((i > 0) & (F.get("tokens", i) == F.get("tokens", i - 1)), F.concat(s, F.lit("="))).otherwise(s)
    return rows.withColumn("shapes", F.transform("plain", again)).drop("plain")


def with_votes(rows: DataFrame) -> DataFrame:
    """``shaped`` rows with ``votes``: one digit per labeller of NAMES, 2 junk, 1 good, 0 no vote.

    Most labellers look for one kind of junk and have nothing to say on texts
    without it; ``letters`` and ``plain`` overlap with all of them, and only
    ``plain`` also votes good.  Shares are of the tokens, counted on the shapes
    written one after the other.
    """
    rows = rows.withColumn("line", F.concat(F.lit(" "), F.array_join("shapes", " "), F.lit(" ")))
    n = F.greatest(F.size("shapes"), F.lit(1))
    size = F.char_length("line")
    without = lambda *what: F.char_length(_stripped(F.col("line"), what))
    marked = lambda pattern: F.regexp_replace("line", pattern, "\u0001")
    share = lambda pattern: (F.char_length(marked(pattern)) - F.char_length(_stripped(marked(pattern), ["\u0001"]))) / n

    def vote(junk: Column, good: Column, least: int = 1) -> Column:
        return F.when(F.size("shapes") < least, "0").when(junk, "2").when(good, "1").otherwise("0")

    rows = rows.withColumns(
        {
            "_symbols": share(r"[^ ]*[^Aa0.,;:!?'’\"()\-=| ][^ ]*"),
            "_capitals": share(r" [^a ]*A[^a ]*(?= )"),
            "_bars": share(r" [^Aa0 ]+(?= )"),
            "_repeats": (size - without("= ")) / 2 / n,
            "_variety": variety() / n,
            "_marks": share(r"[!?]=? "),
            "_ends": share(r"[.!?]=? "),
            "_letters": (size - without("A", "a", "0")) / F.greatest(size - n, F.lit(1)),
            "_plain": share(r" A?a?[.,;:]?(?= )"),
        }
    )
    never = F.lit(False)
    each = [
        vote(F.col("_symbols") > 0.3, never),
        vote(F.col("_capitals") > 0.5, never, 5),
        vote(F.col("_bars") > 0.2, never, 5),
        vote(F.col("_repeats") > 0.3, never, 5),
        vote(F.col("_variety") < 0.2, never, 30),
        vote(F.col("_marks") > 0.5, never, 5),
        vote((F.col("_ends") > 0.6) | (F.col("_ends") < 0.005), never, 30),
        vote(F.col("_letters") < 0.72, never, 5),
        vote(F.col("_plain") < 0.7, F.col("_plain") > 0.85, 5),
    ]
    return rows.withColumn("votes", F.concat(*each)).drop("line", *[f"_{name}" for name in NAMES if name != "sentences"], "_ends")


def variety() -> Column:
    """Different ``tokens`` of each WINDOW, added up, so long texts don't look poor in words."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("tokens"), F.lit(1)), F.lit(WINDOW))
    return F.aggregate(starts, F.lit(0), lambda a, i: a + F.size(F.array_distinct(F.slice("tokens", i, WINDOW))))


def looped() -> Column:
    """Whether most phrases of GRAM ``tokens`` stand in the text before; texts under 30 tokens are not judged."""
    n = F.greatest(F.size("tokens") - GRAM + 1, F.lit(0))
    grams = F.transform(F.slice("tokens", F.lit(1), n), lambda t, i: F.xxhash64(t, *[F.get("tokens", i + k) for k in range(1, GRAM)]))
    return F.when(F.size("tokens") < 30, False).otherwise(F.size(F.array_distinct(grams)) < n * LOOPED)


def abusive() -> Column:
    """Whether ABUSE terms, at least two different ones, reach their share of the ``tokens``."""
    whole = rf"(?<![\p{{L}}\p{{M}}])(?:{'|'.join(ABUSE.split())})(?![\p{{L}}\p{{M}}])"
    terms = F.regexp_extract_all(F.lower(text_of()), F.lit(whole), F.lit(0))
    return (F.size(F.array_distinct(terms)) > 1) & (F.size(terms) >= F.size("tokens") * ABUSIVE)


def _stripped(text: Column, what) -> Column:
    return reduce(lambda t, x: F.replace(t, F.lit(x), F.lit("")), what, text)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of junk per pattern, P(vote | class) [labeller, class, vote], share of junk).

    ``patterns`` has votes 0, 1, 2 per labeller; at most 3 ** labellers rows.
    """
    n = counts / max(counts.sum(), 1)
    # Start: labellers look for one kind of junk each, so any junk vote is strong evidence and a good vote weak.
    odds = ((patterns == 2) * 4.0 - (patterns == 1) * 0.5).sum(1) - 1.0
    post = 1 / (1 + np.exp(-odds))
    table, prior = np.full((patterns.shape[1], 2, 3), 1 / 3), 0.5
    for _ in range(rounds):
        prior = float(np.clip((n * post).sum(), 1e-4, 1 - 1e-4))
        for v in range(3):
            hit = patterns == v
            for c, w in ((0, n * (1 - post)), (1, n * post)):
                table[:, c, v] = (w @ hit + 1e-4) / (w.sum() + 3e-4)
        for v, better in ((2, 1), (1, 0)):  # no labeller is worse than chance: such votes count as no evidence
            worse = table[:, better, v] < table[:, 1 - better, v]
            table[worse, :, v] = table[worse, :, v].mean(1, keepdims=True)
        table /= table.sum(2, keepdims=True)
        logs = np.log([1 - prior, prior]) + sum(np.log(table[k][:, patterns[:, k]]).T for k in range(patterns.shape[1]))
        post = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
    return post, table, prior


def fit(features: np.ndarray, target: np.ndarray, bias: float, rounds: int = 400, rate: float = 0.05, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic scorer for soft targets.

    ``bias`` is given (the log odds of junk), so a text of few words stays near the prior.
    """
    w, m, v = np.zeros(features.shape[1]), np.zeros(features.shape[1]), np.zeros(features.shape[1])
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(features @ w + bias, -30, 30)))
        g = features.T @ (p - target) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def bucket(shape: Column) -> Column:
    return F.pmod(F.xxhash64(shape), F.lit(DIMS)).cast("int")


def weak_labels(docs: DataFrame) -> tuple[DataFrame, dict[str, float], float]:
    """(text_hash, votes) of all rows, the posterior of junk by vote pattern, and the share of junk."""
    seen = cut(with_votes(shaped(docs)).select(F.xxhash64(text_of()).alias("text_hash"), "votes"))
    counts = seen.groupBy("votes").count().orderBy("votes").collect()  # at most 3 ** labellers rows
    patterns = np.array([[int(c) for c in r.votes] for r in counts], dtype=int).reshape(-1, len(NAMES))
    posterior, _, prior = expectation_maximisation(patterns, np.array([r["count"] for r in counts], dtype=float))
    return seen, {r.votes: float(p) for r, p in zip(counts, posterior, strict=True)}, prior


def classify(docs: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with n_words, score (of junk) and keep.

    Looped and abusive texts score 1, the others what the scorer says.
    All rows come back, repeated ones each for itself.  A null or empty text has
    no words, gets no votes and the prior as score; it is kept unless junk is the
    rule.  Equal texts get equal scores.  An empty table gives no rows.
    """
    seen, known, prior = weak_labels(docs.select("text"))
    # The scorer's documents: those with the smallest hashes, a fixed choice of at most ``sample``.
    chosen = cut(seen.distinct().orderBy("text_hash").limit(sample))
    last = chosen.agg(F.max("text_hash")).first()[0]
    fit_on = docs.select("text").filter(F.xxhash64(text_of()) <= F.lit(last))
    cells = (
        shaped(fit_on).select(F.xxhash64(text_of()).alias("text_hash"), "shapes")
        .dropDuplicates(["text_hash"])
        .select("text_hash", F.size("shapes").alias("n"), F.explode("shapes").alias("shape"))
        .groupBy("text_hash", "n", bucket(F.col("shape")).alias("b"))
        .agg((F.count("*") / (F.col("n") + NEUTRAL)).alias("share"))
        .join(F.broadcast(chosen), "text_hash")
        .toPandas()
    )
    texts = {h: i for i, h in enumerate(cells["text_hash"].unique())}
    features, target = np.zeros((len(texts), DIMS)), np.zeros(len(texts))
    at = cells["text_hash"].map(texts).to_numpy(dtype=int)
    np.add.at(features, (at, cells["b"].to_numpy(dtype=int)), cells["share"].to_numpy(dtype=float))
    target[at] = cells["votes"].map(known).to_numpy(dtype=float)
    bias = float(round(np.log(prior / (1 - prior)), 6))
    weights = fit(features, target, bias)

    learned = F.lit([float(round(w, 6)) for w in weights])
    total = F.aggregate("shapes", F.lit(0.0), lambda a, s: a + F.element_at(learned, bucket(s) + 1))
    n = F.size("shapes")
    z = total / (n + NEUTRAL) + F.lit(bias)
    out = shaped(docs).withColumns({"n_words": n.cast("long"), "score": F.when(looped() | abusive(), 1.0).otherwise(F.round(1 / (1 + F.exp(-z)), 6))})
    return out.withColumn("keep", F.col("score") < threshold).drop("tokens", "shapes")


def good(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept; columns stay as they are."""
    key = ["doc_id", "text_hash"]
    scored = classify(docs.select("doc_id", "text"), threshold).select("doc_id", F.xxhash64(text_of()).alias("text_hash"), "keep")
    rejected = cut(cut(scored).filter("NOT keep").select(*key).distinct())
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(text_of()).alias("text_hash"))
    return key_join(rows, small(rejected), key, "left_anti").select("row.*")
