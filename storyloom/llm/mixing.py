"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell (source, language, topic).  Raking scales the cells'
weights in turn so that the source, language and topic shares meet their
targets; inclusion probabilities proportional to the raked over the observed
tokens are calibrated so that the expected sample has the wanted size, and a
hash of each document decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, small, text_of

ROUNDS = 12
TOLERANCE = 1e-5  # relative change of a margin at which fitting ends
TRIES, SEARCH = 30, 7  # scales tried in a pass, and passes
MARGINS = ("source", "lang", "topic")

# Topics by the first pattern that a text has, else prose.
TOPICS = [("contact", r"[A-Za-z0-9]@[A-Za-z0-9]"), ("license", r"(?i)licen[sc]ed? under|copyright"), ("numbers", r"[0-9]{4,}")]


def topic_of(text: Column, topics: list[tuple[str, str]] = TOPICS) -> Column:
    return reduce(lambda rest, t: F.when(text.rlike(t[1]), t[0]).otherwise(rest), reversed(topics), F.lit("prose"))


def n_tokens(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"\s+"), "")).cast("long")


def draw(*columns: Column) -> Column:
    """A fixed number in [0, 1) from the columns."""
    key = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substr(F.md5(key), F.lit(1), F.lit(13)), 16, 10).cast("long") / F.lit(float(2**52))


def targets(cells: DataFrame, column: str, wanted: dict[str, float] | None, power: float = 1.0) -> DataFrame:
    """(column, target): shares of one margin over the values that have tokens.

    Listed values get their share; the others divide the rest as their observed
    tokens to the ``power``.  Shares are scaled to 1, so a listed value without
    tokens leaves its share to the others.
    """
    observed = cells.groupBy(column).agg(F.sum("tokens").alias("n"))
    wanted = wanted or {}
    listed = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv]) if wanted else F.create_map().cast("map<string,double>")
    given = F.try_element_at(listed, F.coalesce(F.col(column), F.lit("")))
    rows = cut(observed.select(column, given.alias("given"), F.pow(F.col("n").cast("double"), F.lit(power)).alias("size")))
    sums = rows.agg(F.sum(F.when(F.col("given").isNull(), F.col("size"))).alias("rest"), F.sum("given").alias("given")).first()
    left = max(0.0, 1.0 - sum(wanted.values()))
    share = F.coalesce("given", F.col("size") / (sums.rest or 1.0) * left)
    whole = (sums.given or 0.0) + (left if sums.rest else 0.0)
    return cut(rows.select(column, (share / (whole or 1.0)).alias("target")))


def rake(cells: DataFrame, margins: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with ``raked``, the share of each cell after fitting all margins in turn.

    Each value of a margin has a factor, and a cell's share is its observed one
    times its factors.  A step sums the shares by one margin and scales that
    margin's factors; fitting ends after ``rounds`` or when the first margin
    needs no more change than ``tolerance``.  Null values are a value like any other.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    keys = {name: F.coalesce(F.col(name), F.lit("\u0000null")) for name in margins}
    base = cut(cells.select("*", (F.col("tokens") / F.lit(float(total))).alias("_share"), *[k.alias(f"_{name}") for name, k in keys.items()]))
    want = {name: cut(t.select(keys[name].alias(f"_{name}"), "target")) for name, t in margins.items()}
    few = {name: t.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS for name, t in want.items()}  # a margin's values stay the same
    hint = lambda name, df: F.broadcast(df) if few[name] else df
    factors = {name: t.select(f"_{name}", F.lit(1.0).alias(f"_by_{name}")) for name, t in want.items()}

    def shares() -> DataFrame:
        rows = base
        for name, factor in factors.items():
            rows = rows.join(hint(name, factor), f"_{name}")
        return rows.withColumn("raked", reduce(lambda a, b: a * b, [F.col(f"_by_{name}") for name in factors], F.col("_share")))

    for _ in range(rounds):
        changed = None
        for name in margins:
            sums = shares().groupBy(f"_{name}").agg(F.sum("raked").alias("now"))
            step = sums.join(hint(name, want[name]), f"_{name}").join(hint(name, factors[name]), f"_{name}")
            ratio = F.when(F.col("now") > 0, F.col("target") / F.col("now")).otherwise(0.0)
            fresh = cut(step.select(f"_{name}", (F.col(f"_by_{name}") * ratio).alias(f"_by_{name}"), F.abs(ratio - 1).alias("change")))
            changed = fresh.agg(F.max("change")).first()[0] if changed is None else changed
            factors[name] = fresh.drop("change")
        if (changed or 0.0) <= tolerance:
            break
    return cut(shares().select(*cells.columns, "raked"))


def calibrate(cells: DataFrame, tokens: float) -> DataFrame:
    """``cells`` with ``probability``: min(1, scale * raked / observed tokens), expecting ``tokens`` tokens.

    If more are wanted than the cells hold, every probability is 1.
    """
    ratio = F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).otherwise(0.0)
    cells = cut(cells.withColumn("ratio", ratio))
    whole = cells.agg(F.sum("tokens").alias("n"), F.min(F.when(F.col("ratio") > 0, F.col("ratio"))).alias("low")).first()
    if not whole.n or not whole.low or tokens >= whole.n:
        return cells.withColumn("probability", F.lit(1.0)).drop("ratio")
    # A pass over the cells tries TRIES scales at once and keeps the gap in which the wanted one lies.
    low, high = 0.0, 1.0 / whole.low
    for _ in range(SEARCH):
        tries = [low + (high - low) * k / (TRIES + 1) for k in range(1, TRIES + 1)]
        each = cells.select("ratio", "tokens", F.posexplode(F.lit(tries)).alias("k", "scale"))
        sums = each.groupBy("k").agg(F.sum(F.least(F.col("ratio") * F.col("scale"), F.lit(1.0)) * F.col("tokens")).alias("n")).collect()
        low = max([low, *[tries[r.k] for r in sums if r.n < tokens]])
        high = min([high, *[tries[r.k] for r in sums if r.n >= tokens]])
    return cells.withColumn("probability", F.least(F.col("ratio") * high, F.lit(1.0))).drop("ratio")


def mix_sources(
    docs: DataFrame,
    source: dict[str, float] | None = None,
    lang: dict[str, float] | None = None,
    topic: dict[str, float] | None = None,
    power: float = 0.5,
    share: float = 0.5,
    seed: str = "mix",
) -> DataFrame:
    """The sampled rows of ``docs`` with topic, n_tokens and probability; all its columns stay.

    Unlisted sources divide what the listed leave by their tokens to the
    ``power``; languages and topics by their tokens.  ``share`` is the expected
    part of all tokens that is kept.  A row is kept if its number, drawn from
    ``seed``, doc_id and text, is below its cell's probability: equal rows meet
    the same fate, and a rerun draws alike.  Rows without tokens (null, empty)
    weigh nothing and are left out unless everything is kept.  Null source or
    language is a value of its own.
    """
    marked = docs.withColumns({"topic": topic_of(text_of()), "n_tokens": n_tokens(text_of())})
    cells = cut(marked.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    goals = {"source": targets(cells, "source", source, power), "lang": targets(cells, "lang", lang), "topic": targets(cells, "topic", topic)}
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    rates = cut(calibrate(rake(cells.filter("tokens > 0"), goals), total * share).select(*MARGINS, "probability"))
    safe = {m: F.coalesce(F.col(m), F.lit("\u0000null")) for m in MARGINS}
    rates = rates.select(*[safe[m].alias(f"_{m}") for m in MARGINS], "probability")
    joined = marked.withColumns({f"_{m}": safe[m] for m in MARGINS}).join(small(rates), [f"_{m}" for m in MARGINS], "inner")
    u = draw(F.lit(seed), F.col("doc_id"), F.xxhash64(text_of()))
    return joined.filter(u < F.col("probability")).drop(*[f"_{m}" for m in MARGINS])
