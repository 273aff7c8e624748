"""Exact and near duplicates of articles.

Every article that is not a duplicate is a *lead*; a lead claims all later
articles it confirms as duplicates, in article order.  So the leads are the
greedy independent set of the "confirmed" graph, and a duplicate belongs to its
earliest neighbouring lead.

The graph is never written out as article pairs.  Articles that compare alike
(same URL, hash, source, title words and date) form one *slot*.  A slot sits in
a few *groups* - its hash, its URL, its title in a 72 h block - and all edges
inside a group follow one rule (mostly: "another source").  Whether a slot has
an earlier lead or an earlier undecided neighbour is read off small per-group
aggregates, so a group of copies costs its size, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round3
from ..functions.text import title_key, title_tokens
from ..functions.times import hours_between, millis, order_key, ts_lit
from ..functions.urls import has_specific_path, normalize_url
from .components import connected_components
from .lineage import cut
from .simjoin import HALF_UNIT, earliest_similar, similarity, title_similarity_join
from .skew import hot_keys, salted_lookup
from .summaries import measure

# Fixed values.
CONFIRMED = 0.82
POSSIBLE = 0.5
RELATED = 0.62  # of stories, which use the same pairs
WINDOW_HOURS = 72
OUTSIDE_FACTOR = 0.65
EXACT_CONFIDENCE = 0.98
HEAT_SHARE, CREDIBILITY_SHARE = 0.2, 0.12

# Rounds over the cluster before the chains that are left are walked.
PARALLEL = 2

_WINDOW_MS = WINDOW_HOURS * 3600 * 1000
_HOUR_MS = 3600 * 1000
_UNDATED = "u"


# --- exact groups -----------------------------------------------------------


def _groups(articles: DataFrame, key: Column) -> DataFrame:
    """Each article next to the first article of its group and the first one of another source.

    Linear in the group: aggregates of one row per source, no pairs and no lists.
    """
    rows = articles.select("article_id", "source_id", order_key().alias("okey"), key.alias("k")).filter(
        "k IS NOT NULL AND k <> ''"
    )
    per_source = rows.groupBy("k", "source_id").agg(F.min("okey").alias("first_key"), F.count("*").alias("n"))
    groups = (
        per_source.groupBy("k")
        .agg(F.sum("n").alias("group_size"), F.count("*").alias("n_sources"), F.min(F.struct("first_key", "source_id")).alias("m1"))
        .filter("group_size > 1")
    )
    second = (
        per_source.join(groups.select("k", F.col("m1.source_id").alias("best")), "k")
        .filter("source_id <> best")
        .groupBy("k")
        .agg(F.min("first_key").alias("second_key"))
    )
    groups = groups.join(second, "k", "left")
    other = F.when(F.col("m1.source_id") != F.col("source_id"), F.col("m1.first_key")).otherwise(F.col("second_key"))
    ident = lambda c: F.substring_index(c, "|", -1)
    return rows.join(groups, "k").select(
        "article_id", "k", "group_size", "n_sources",
        F.when(F.col("m1.first_key") < F.col("okey"), ident(F.col("m1.first_key"))).alias("first_article_id"),
        F.when(other < F.col("okey"), ident(other)).alias("first_other_article_id"),
    )


def url_pairs(articles: DataFrame) -> DataFrame:
    """Articles sharing a normalized URL, tied to the group's first article (star form)."""
    return _groups(articles, normalize_url("canonical_url")).withColumnRenamed("k", "normalized_url")


def hash_pairs(articles: DataFrame) -> DataFrame:
    """Articles sharing a content hash, tied to the group's first article (star form)."""
    return _groups(articles, F.col("content_hash")).withColumnRenamed("k", "hash")


# --- evidence of given pairs --------------------------------------------------


def _side(articles: DataFrame, prefix: str) -> DataFrame:
    return articles.select(
        F.col("article_id").alias(f"{prefix}_id"),
        F.col("source_id").alias(f"{prefix}_source"),
        normalize_url("canonical_url").alias(f"{prefix}_url"),
        F.nullif("content_hash", F.lit("")).alias(f"{prefix}_hash"),
        title_tokens("title").alias(f"{prefix}_words"),
        F.col("published_at").alias(f"{prefix}_at"),
    )


def pair_evidence(pairs: DataFrame, articles: DataFrame) -> DataFrame:
    """Similarity, hours apart, reasons and confidence of (first_id, second_id) rows."""
    joined = pairs.join(_side(articles, "first"), "first_id").join(_side(articles, "second"), "second_id")
    raw = similarity(F.col("first_words"), F.col("second_words"))
    hours = hours_between("first_at", "second_at")
    e = joined.withColumn("raw", raw).withColumn("hours_apart", hours)
    inside = F.col("hours_apart").isNull() | (F.col("hours_apart") <= WINDOW_HOURS)
    diverse = F.col("first_source") != F.col("second_source")
    same_url = F.coalesce((F.col("first_url") != "") & (F.col("first_url") == F.col("second_url")), F.lit(False))
    same_hash = F.coalesce(F.col("first_hash") == F.col("second_hash"), F.lit(False))
    specific = has_specific_path("first_url")
    trusted = (
        (same_hash & (diverse | (same_url & specific)))
        | (same_url & diverse)
        | (same_url & ~diverse & (F.col("raw") >= CONFIRMED) & specific)
    )
    all_reasons = F.array_compact(
        F.array(
            F.when(same_url, "canonical_url"),
            F.when(same_hash, "content_hash"),
            F.when((F.col("raw") >= POSSIBLE) & ~trusted, "title_similarity"),
            F.when(inside & ~trusted, "time_window"),
            F.when(diverse & ~trusted, "source_diversity"),
        )
    )
    return e.select(
        *[c for c in pairs.columns],
        F.col("second_source").alias("source_id"),
        round3(F.when(trusted, F.lit(EXACT_CONFIDENCE)).otherwise(F.col("raw") * F.when(inside, 1.0).otherwise(OUTSIDE_FACTOR))).alias("confidence"),
        round3(F.col("raw")).alias("title_similarity"),
        "hours_apart",
        all_reasons.alias("reasons"),
        diverse.alias("other_source"),
        (same_url & specific).alias("same_specific_url"),
    )


def pair_decision(evidence: DataFrame) -> DataFrame:
    """``confirmed`` and ``possible`` per evidence row."""
    has = lambda r: F.array_contains("reasons", r)
    confirmed = (
        F.when(has("content_hash"), F.col("other_source") | F.col("same_specific_url"))
        .when(
            has("canonical_url"),
            F.col("other_source") | ((F.col("title_similarity") >= CONFIRMED) & F.col("same_specific_url")),
        )
        .otherwise(F.col("other_source") & (F.col("confidence") >= CONFIRMED))
    )
    return evidence.withColumn("confirmed", confirmed).withColumn(
        "possible", ~F.col("confirmed") & (F.col("confidence") >= POSSIBLE)
    )


# --- slots and groups -----------------------------------------------------------


def article_keys(articles: DataFrame) -> DataFrame:
    """The columns an article is compared by, plus its place in article order."""
    return articles.select(
        "article_id",
        "source_id",
        order_key().alias("okey"),
        F.nullif(normalize_url("canonical_url"), F.lit("")).alias("url"),
        F.nullif("content_hash", F.lit("")).alias("hash"),
        title_key("title").alias("tkey"),
        millis("published_at").alias("t"),
    ).withColumn("specific", has_specific_path("url"))


_SLOT_BY = ["source_id", "url", "hash", "tkey", "t", "specific"]


def _slots(keys: DataFrame) -> DataFrame:
    return keys.groupBy(*_SLOT_BY).agg(F.min("okey").alias("slot"), F.count("*").alias("members"))


def _block(t: Column) -> Column:
    return F.floor(t / _WINDOW_MS).cast("string")


def _key(kind: str, *parts: Column) -> Column:
    return F.concat_ws("\u0001", F.lit(kind), *parts)


def _memberships(slots: DataFrame) -> DataFrame:
    """(slot, source_id, t, gkey, cross): the groups a slot belongs to.

    ``cross`` says that only slots of different sources are neighbours there.
    """
    cross, any_source = F.lit(True), F.lit(False)
    titled = F.col("tkey") != ""
    exact = F.col("specific") & F.col("url").isNotNull()
    entry = lambda cond, key, c: F.when(cond, F.struct(key.alias("gkey"), c.alias("cross")))
    groups = F.array_compact(
        F.array(
            entry(F.col("hash").isNotNull(), _key("h", F.col("hash")), cross),
            entry(F.col("url").isNotNull(), _key("u", F.col("url")), cross),
            entry(exact & F.col("hash").isNotNull(), _key("x", F.col("hash"), F.col("url"), F.col("source_id")), any_source),
            entry(exact & titled, _key("v", F.col("url"), F.col("source_id"), F.col("tkey")), any_source),
            entry(titled, _key("t", F.col("tkey"), F.coalesce(_block(F.col("t")), F.lit(_UNDATED))), cross),
            entry(titled, _key("a", F.col("tkey")), cross),
        )
    )
    return slots.select("slot", "source_id", "t", F.inline(groups))


def _look_ups(slots: DataFrame, pairs: DataFrame) -> DataFrame:
    """(slot, source_id, gkey, cross, since): the groups whose earlier members may claim a slot.

    ``since`` (ms) limits the look-up to members published then or later.
    """
    since_none = F.lit(None).cast("long")
    own = _memberships(slots).filter(
        ~F.substring("gkey", 1, 1).isin("t", "a")
    ).select("slot", "source_id", "gkey", "cross", since_none.alias("since"))

    strong = pairs.filter(F.col("similarity") >= CONFIRMED)
    timeless = round3(F.col("raw") * OUTSIDE_FACTOR) >= CONFIRMED
    linked = slots.filter("tkey <> ''").join(
        strong.select(F.col("second_key").alias("tkey"), "first_key", timeless.alias("timeless")), "tkey"
    )
    itself = slots.filter("tkey <> ''").withColumn("first_key", F.col("tkey")).withColumn("timeless", F.lit(False))
    titles = linked.select(*itself.columns).unionByName(itself)

    block = F.floor(F.col("t") / _WINDOW_MS)
    key_at = lambda b: _key("t", F.col("first_key"), b.cast("string"))
    entry = lambda key, since: F.struct(key.alias("gkey"), since.alias("since"))
    whole = F.array(entry(_key("a", F.col("first_key")), since_none))
    windowed = F.array(
        entry(key_at(block), since_none),
        entry(key_at(block - 1), F.col("t") - _WINDOW_MS),
        entry(_key("t", F.col("first_key"), F.lit(_UNDATED)), since_none),
    )
    by_title = titles.select(
        "slot", "source_id",
        F.inline(F.when(F.col("t").isNull() | F.col("timeless"), whole).otherwise(windowed)),
    ).select("slot", "source_id", "gkey", F.lit(True).alias("cross"), "since")
    same_page = linked.filter("specific AND url IS NOT NULL").select(
        "slot", "source_id", _key("v", F.col("url"), F.col("source_id"), F.col("first_key")).alias("gkey"),
        F.lit(False).alias("cross"), since_none.alias("since"),
    )
    return own.unionByName(by_title).unionByName(same_page)


def _useful(reads: DataFrame, memberships: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Look-ups that can find somebody else, and the hot groups."""
    counts = memberships.groupBy("gkey").agg(
        F.count("*").alias("n"), F.min("source_id").alias("s1"), F.max("source_id").alias("s2"), F.min("slot").alias("m")
    )
    hot = cut(hot_keys(counts, "gkey", total))
    kept = salted_lookup(reads, counts, "gkey", F.col("slot"), hot).filter(
        (F.col("m") < F.col("slot"))
        & (~F.col("cross") | (F.col("s1") != F.col("s2")) | (F.col("s1") != F.col("source_id")))
    )
    return kept.select("slot", "source_id", "gkey", "cross", "since"), hot


def _two_best(per_source: DataFrame, columns: dict[str, tuple[str, bool]]) -> DataFrame:
    """Per group the two best sources of each measure: enough to answer "best of another source".

    ``columns``: output -> (input, larger_is_better).  The best of all sources,
    then the best of the others: two aggregates.
    """
    pick = lambda larger: F.max if larger else F.min
    entry = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("source_id").alias("s")))
    best = per_source.groupBy("gkey").agg(*[pick(larger)(entry(c)).alias(f"_{out}") for out, (c, larger) in columns.items()])
    others = per_source.join(best, "gkey").groupBy("gkey").agg(
        *[F.first(f"_{out}").alias(f"_{out}") for out in columns],
        *[
            pick(larger)(F.when(F.col("source_id") != F.col(f"_{out}.s"), entry(c))).alias(f"_{out}_2")
            for out, (c, larger) in columns.items()
        ],
    )
    return others.select("gkey", *[F.array_compact(F.array(f"_{out}", f"_{out}_2")).alias(out) for out in columns])


def _other(best: str) -> Column:
    """Best value of a source other than ``source_id`` where ``cross``, else the best value."""
    one, two = F.try_element_at(best, F.lit(1)), F.try_element_at(best, F.lit(2))
    return F.when(F.col("cross") & (one["s"] == F.col("source_id")), two["v"]).otherwise(one["v"])


def _group_state(memberships: DataFrame, state: DataFrame) -> DataFrame:
    alive = memberships.join(state.filter("status <> 'D'").select("slot", "status"), "slot")
    lead = F.col("status") == "L"
    per_source = alive.groupBy("gkey", "source_id").agg(
        F.min(F.when(lead, F.col("slot"))).alias("lead_min"),
        F.max(F.when(lead, F.col("t"))).alias("lead_t"),
        F.min("slot").alias("any_min"),
        F.max("t").alias("any_t"),
    )
    return _two_best(
        per_source,
        {"lead_min": ("lead_min", False), "lead_t": ("lead_t", True), "any_min": ("any_min", False), "any_t": ("any_t", True)},
    )


def solve_slots(slots: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, look-ups, memberships): status L (lead) or D (duplicate) for every slot.

    PARALLEL rounds decide every slot whose earlier neighbours allow it, whatever
    the size of its groups; what then is open are chains, in which one decision
    waits for the other, and those are walked in slot order, component by
    component.  ``slots`` is a written table.
    """
    memberships = cut(_memberships(slots))
    reads, hot = _useful(_look_ups(slots, pairs), memberships, slots.count())
    reads = cut(reads)
    readers = reads.select("slot").distinct()
    state = cut(
        slots.select("slot")
        .join(readers.withColumn("reads", F.lit(True)), "slot", "left")
        .select("slot", F.when(F.col("reads"), "U").otherwise("L").alias("status"))
    )
    # Groups nobody looks up play no part.
    open_reads = reads
    for _ in range(PARALLEL):
        if open_reads.isEmpty():
            return state, reads, memberships
        asked = memberships.join(open_reads.select("gkey").distinct(), "gkey", "left_semi")
        state = cut(_round(state, open_reads, asked, hot))
        open_reads = cut(open_reads.join(state.filter("status = 'U'").select("slot"), "slot", "left_semi"))
    if not open_reads.isEmpty():
        walked = _walk_chains(state, open_reads, memberships, hot)
        state = cut(state.join(walked, "slot", "left").select("slot", F.coalesce("walked", "status").alias("status")))
    return state, reads, memberships


def _walk_chains(state: DataFrame, open_reads: DataFrame, memberships: DataFrame, hot: DataFrame) -> DataFrame:
    """(slot, walked): L or D for every open slot, decided in slot order inside each component of open slots and groups."""
    asked = cut(memberships.join(open_reads.select("gkey").distinct(), "gkey", "left_semi"))
    decided = asked.join(state.filter("status = 'L'").select("slot"), "slot", "left_semi")
    per_source = decided.groupBy("gkey", "source_id").agg(F.min("slot").alias("lead_min"), F.max("t").alias("lead_t"))
    leads = _two_best(per_source, {"lead_min": ("lead_min", False), "lead_t": ("lead_t", True)})
    claimed = salted_lookup(open_reads, leads, "gkey", F.col("slot"), hot).filter(
        F.when(F.col("since").isNull(), _other("lead_min") < F.col("slot")).otherwise(_other("lead_t") >= F.col("since"))
    ).select("slot").distinct().withColumn("claimed", F.lit(True))

    waiting = state.filter("status = 'U'").select("slot")
    members = cut(asked.join(waiting, "slot", "left_semi"))
    chained = cut(open_reads.join(members.select("gkey").distinct(), "gkey", "left_semi"))
    ties = chained.select(F.col("slot").alias("a"), F.col("gkey").alias("b")).unionByName(members.select(F.col("slot").alias("a"), F.col("gkey").alias("b")))
    components = connected_components(ties).select(F.col("id").alias("slot"), "component")
    look_ups = chained.groupBy("slot").agg(F.collect_list(F.struct("gkey", "cross", "since")).alias("look_ups"))  # a slot's own
    own = members.groupBy("slot").agg(F.first("source_id").alias("source_id"), F.first("t").alias("t"), F.collect_list("gkey").alias("groups"))
    rows = (
        waiting.join(components, "slot", "left").join(claimed, "slot", "left").join(look_ups, "slot", "left").join(own, "slot", "left")
        .select(F.coalesce("component", "slot").alias("component"), "slot", "source_id", "t", F.coalesce("claimed", F.lit(False)).alias("claimed"), "look_ups", "groups")
    )
    ordered = rows.repartition("component").sortWithinPartitions("component", "slot")
    return ordered.mapInArrow(_walked, "slot STRING, walked STRING")


class _Leads:
    """The leads a group has so far: all that matters is the latest date of two different sources."""

    __slots__ = ("latest",)

    def __init__(self) -> None:
        self.latest: list[tuple[str | None, int | None]] = []

    def add(self, source: str | None, t: int | None) -> None:
        self.latest = [(source, t)] + [x for x in self.latest if x[0] != source][:1]

    def claims(self, source: str | None, cross: bool, since: int | None) -> bool:
        return any((not cross or s != source) and (since is None or (t is not None and t >= since)) for s, t in self.latest)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """L or D of rows sorted by component, then slot."""
    now, groups = None, {}
    for batch in batches:
        slots, status = batch.column(batch.schema.get_field_index("slot")), []
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("component", "source_id", "t", "claimed", "look_ups", "groups")]
        for component, source, t, claimed, look_ups, own in zip(*columns, strict=True):
            if component != now:
                now, groups = component, {}
            found = claimed or any(
                x["gkey"] in groups and groups[x["gkey"]].claims(source, x["cross"], x["since"]) for x in look_ups or []
            )
            status.append("D" if found else "L")
            if not found:
                for key in own or []:
                    groups.setdefault(key, _Leads()).add(source, t)
        yield pa.RecordBatch.from_arrays([slots, pa.array(status, pa.string())], ["slot", "walked"])


def _round(state: DataFrame, open_reads: DataFrame, asked: DataFrame, hot: DataFrame) -> DataFrame:
    """Mark slots with an earlier lead D, and slots without open earlier neighbours L."""
    seen = salted_lookup(open_reads, _group_state(asked, state), "gkey", F.col("slot"), hot)
    earlier = lambda low, latest: F.coalesce(
        F.when(F.col("since").isNull(), _other(low) < F.col("slot")).otherwise(_other(latest) >= F.col("since")),
        F.lit(False),
    )
    verdict = seen.groupBy("slot").agg(
        F.bool_or(earlier("lead_min", "lead_t")).alias("has_lead"), F.bool_or(earlier("any_min", "any_t")).alias("has_any")
    )
    undecided = F.col("status") == "U"
    status = F.when(undecided & F.coalesce("has_lead", F.lit(False)), "D").when(undecided & ~F.coalesce("has_any", F.lit(False)), "L")
    return state.join(verdict, "slot", "left").select("slot", status.otherwise(F.col("status")).alias("status"))


def first_since(leads: DataFrame, asks: DataFrame) -> DataFrame:
    """For (gkey, since) rows the earliest lead of the group published at ``since`` or later.

    ``leads`` has gkey, slot, t, source_id.  Running minima inside one hour plus
    the minimum of the later hours of the group; a group spans one 72 h block,
    so no partition outgrows the distinct instants of an hour.
    """
    lead_rows = leads.groupBy("gkey", F.col("t").alias("at")).agg(F.min(F.struct("slot", "source_id")).alias("best"))
    ask_rows = asks.select("gkey", "since").distinct()
    hour = lambda c: F.floor(F.col(c) / _HOUR_MS)
    line = lead_rows.select("gkey", "at", "best", hour("at").alias("hour"), F.lit(0).alias("ask")).unionByName(
        ask_rows.select(
            "gkey", F.col("since").alias("at"), F.lit(None).cast("struct<slot:string,source_id:string>").alias("best"),
            hour("since").alias("hour"), F.lit(1).alias("ask"),
        )
    )
    in_hour = Window.partitionBy("gkey", "hour").orderBy(F.desc("at"), "ask").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("gkey").orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)
    hours = line.groupBy("gkey", "hour").agg(F.min("best").alias("best")).withColumn("after", F.min("best").over(later))
    return (
        line.withColumn("near", F.min("best").over(in_hour))
        .filter("ask = 1")
        .join(hours.select("gkey", "hour", "after"), ["gkey", "hour"])
        .select("gkey", F.col("at").alias("since"), F.coalesce("near", "after").alias("best"))
        .filter("best IS NOT NULL")
        .select("gkey", "since", F.col("best.slot").alias("lead_slot"), F.col("best.source_id").alias("lead_source"))
    )


def _claims(state: DataFrame, reads: DataFrame, memberships: DataFrame) -> DataFrame:
    """(slot, lead_slot): earliest neighbouring lead of every duplicate slot."""
    leads = memberships.join(state.filter("status = 'L'").select("slot"), "slot", "left_semi")
    asks = reads.join(state.filter("status = 'D'").select("slot"), "slot", "left_semi")
    per_source = leads.groupBy("gkey", "source_id").agg(F.min("slot").alias("low"))
    best = _two_best(per_source, {"low": ("low", False)})
    plain = (
        asks.filter("since IS NULL")
        .join(best, "gkey")
        .select("slot", _other("low").alias("lead_slot"))
        .filter(F.col("lead_slot") < F.col("slot"))
    )
    # Leads of one title in one block share their source (two sources would confirm each other).
    timed = asks.filter("since IS NOT NULL")
    reached = first_since(leads.filter("t IS NOT NULL").join(timed.select("gkey").distinct(), "gkey", "left_semi"), timed)
    windowed = (
        timed.join(reached, ["gkey", "since"])
        .filter(F.col("lead_source") != F.col("source_id"))
        .select("slot", "lead_slot")
        .filter(F.col("lead_slot") < F.col("slot"))
    )
    return plain.unionByName(windowed).groupBy("slot").agg(F.min("lead_slot").alias("lead_slot"))


def _possible(slots: DataFrame, state: DataFrame) -> DataFrame:
    """(tkey, t, lead_slot): earliest lead whose title makes it a possible duplicate of such an article.

    Dated titles meet dated leads from 72 h before them on (later ones than the
    article are no use to it and are left out by the caller) and, at the outside
    factor, leads of any date; where one side has no date, dates don't matter.
    An article asks by ``since``: its own, that of its title, that of undated ones.
    """
    ever, undated_ask = -(2**62), 1 - 2**62
    titled = slots.filter("tkey <> ''")
    leads = titled.join(state.filter("status = 'L'").select("slot"), "slot", "left_semi").select(F.col("tkey").alias("title_key"), "t", "slot")
    block, since = F.floor(F.col("t") / _WINDOW_MS), F.col("t") - _WINDOW_MS
    side = lambda df, name, factor=1.0: df.groupBy("title_key").agg(F.min("slot").alias("slot")).select(
        F.lit(name).alias("block"), "title_key", F.lit(0).cast("long").alias("at"), "slot", F.lit(factor).alias("factor")
    )
    lowest = cut(side(leads, "beyond", OUTSIDE_FACTOR))
    windowed = leads.filter("t IS NOT NULL").groupBy("title_key", "t").agg(F.min("slot").alias("slot")).select(
        block.cast("string").alias("block"), "title_key", F.col("t").alias("at"), "slot", F.lit(1.0).alias("factor")
    )
    offered = (
        windowed.unionByName(side(leads.filter("t IS NULL"), "undated first")).unionByName(lowest)
        .unionByName(lowest.withColumn("block", F.lit("undated second")).withColumn("factor", F.lit(1.0)))
    )
    titles = titled.select(F.col("tkey").alias("title_key"), "t").distinct()
    ask = lambda df, name, when: df.select(F.lit(name).alias("block"), "title_key", F.lit(when).cast("long").alias("since"))
    known = titles.select("title_key").distinct()
    dated = titles.filter("t IS NOT NULL").select(F.explode(F.array(block, block - 1).cast("array<string>")).alias("block"), "title_key", since.alias("since"))
    asks = (
        dated.unionByName(ask(known, "undated first", ever)).unionByName(ask(known, "beyond", ever))
        .unionByName(ask(titles.filter("t IS NULL"), "undated second", undated_ask))
    )
    itself = lowest.select("title_key", F.lit(ever).cast("long").alias("since"), F.col("slot").alias("lead_slot"))
    found = earliest_similar(cut(offered), cut(asks), POSSIBLE).unionByName(itself)
    own = F.array(F.coalesce(since, F.lit(undated_ask)), F.lit(ever)).cast("array<long>")
    return titles.select("title_key", "t", F.explode(own).alias("since")).join(found, ["title_key", "since"]).groupBy(
        F.col("title_key").alias("tkey"), "t"
    ).agg(F.min("lead_slot").alias("lead_slot"))


def title_pairs(articles: DataFrame, least: float = RELATED) -> DataFrame:
    """Similar titles for confirmed duplicates and clustering: (first_key, second_key, raw, similarity).

    Inside the window pairs from ``least`` on matter; beyond it only pairs that stay
    confirmed at the outside factor.  Possible duplicates are found without pairs.
    """
    found = title_similarity_join(articles, least - HALF_UNIT, WINDOW_HOURS, beyond=(CONFIRMED - HALF_UNIT) / OUTSIDE_FACTOR)
    return found.select(
        "first_key", "second_key", F.col("similarity").alias("raw"), round3(F.col("similarity")).alias("similarity")
    )


def assign_duplicates(articles: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row per article: ``is_duplicate``, its lead ``duplicate_of``, and ``candidate_of``.

    ``candidate_of`` is the earliest lead the article is a possible duplicate
    of, when that lead comes before the confirming one.
    """
    pairs = cut(title_pairs(articles, CONFIRMED)) if pairs is None else pairs
    keys = cut(article_keys(articles))
    slots = cut(_slots(keys))
    state, reads, memberships = solve_slots(slots, pairs)
    claims = cut(_claims(state, reads, memberships))
    possible = cut(_possible(slots, state))

    status = slots.join(state, "slot").join(claims, "slot", "left")
    same = F.lit(True)
    for c in _SLOT_BY:
        same = same & F.col(f"k.{c}").eqNullSafe(F.col(f"s.{c}"))
    placed = keys.alias("k").join(status.alias("s"), same).select("k.*", "s.slot", "s.status", "s.lead_slot")
    # Copies on one specific page with one hash confirm each other as well.
    clique = F.col("specific") & F.col("hash").isNotNull() & F.col("url").isNotNull()
    lead = F.when(F.col("status") == "D", F.col("lead_slot")).when(
        clique & (F.col("okey") != F.col("slot")), F.col("slot")
    )
    p = possible.select(F.col("tkey").alias("p_tkey"), F.col("t").alias("p_t"), F.col("lead_slot").alias("maybe"))
    found = placed.withColumn("lead_key", lead).join(
        p, (F.col("tkey") == F.col("p_tkey")) & F.col("t").eqNullSafe(F.col("p_t")), "left"
    )
    maybe = F.when(
        (F.col("maybe") < F.col("okey")) & (F.col("lead_key").isNull() | (F.col("maybe") < F.col("lead_key"))),
        F.col("maybe"),
    )
    ident = lambda c: F.substring_index(c, "|", -1)
    return found.select(
        "article_id",
        "source_id",
        F.col("lead_key").isNotNull().alias("is_duplicate"),
        ident(F.col("lead_key")).alias("duplicate_of"),
        ident(maybe).alias("candidate_of"),
    )


# --- relations, status, summary ---------------------------------------------------


def score_boost(confidence: Column, share: float) -> Column:
    return round3(confidence * share)


def duplicate_relations(assigned: DataFrame, articles: DataFrame, now) -> DataFrame:
    """Confirmed and candidate relations with their evidence."""
    wanted = assigned.select(
        F.col("article_id").alias("second_id"),
        F.inline(
            F.array_compact(
                F.array(
                    F.when(
                        F.col("duplicate_of").isNotNull(),
                        F.struct(F.lit("duplicate_confirmed").alias("relation_type"), F.col("duplicate_of").alias("first_id")),
                    ),
                    F.when(
                        F.col("candidate_of").isNotNull(),
                        F.struct(F.lit("duplicate_candidate").alias("relation_type"), F.col("candidate_of").alias("first_id")),
                    ),
                )
            )
        ),
    )
    evidence = pair_evidence(wanted, articles)
    confirmed = F.col("relation_type") == "duplicate_confirmed"
    boost = lambda share: F.when(confirmed, score_boost(F.col("confidence"), share)).otherwise(F.lit(0.0))
    return evidence.select(
        "relation_type",
        "source_id",
        F.col("second_id").alias("article_id"),
        F.lit(None).cast("string").alias("signal_id"),
        F.col("first_id").alias("target_article_id"),
        "confidence",
        "title_similarity",
        "hours_apart",
        "reasons",
        F.lit(None).cast("double").alias("cluster_score"),
        F.lit(None).cast("string").alias("role"),
        confirmed.alias("duplicate_support"),
        boost(HEAT_SHARE).alias("heat_boost"),
        boost(CREDIBILITY_SHARE).alias("credibility_boost"),
        ts_lit(now).alias("detected_at"),
    )


def dedupe_status(articles: DataFrame, assigned: DataFrame) -> DataFrame:
    """Articles with ``dedupe_status``: duplicate, canonical, possible_duplicate, or as before."""
    leads = assigned.filter("duplicate_of IS NOT NULL").select(F.col("duplicate_of").alias("article_id")).distinct()
    marks = assigned.select("article_id", "is_duplicate", "candidate_of").join(
        leads.withColumn("is_lead", F.lit(True)), "article_id", "left"
    )
    status = (
        F.when(F.col("is_duplicate"), "duplicate")
        .when(F.col("is_lead"), "canonical")
        .when(F.col("candidate_of").isNotNull(), "possible_duplicate")
        .otherwise(F.col("dedupe_status"))
    )
    return articles.join(marks, "article_id", "left").withColumn("dedupe_status", status).drop(
        "is_duplicate", "candidate_of", "is_lead"
    )


def stale_relations(relations: DataFrame, articles: DataFrame) -> DataFrame:
    """Confirmed relations whose endpoint is gone or whose rule no longer holds."""
    confirmed = relations.filter(
        "relation_type = 'duplicate_confirmed' AND article_id IS NOT NULL AND target_article_id IS NOT NULL"
    )
    pairs = confirmed.select(F.col("target_article_id").alias("first_id"), F.col("article_id").alias("second_id")).distinct()
    sound = pair_decision(pair_evidence(pairs, articles)).filter("confirmed").select(
        F.col("first_id").alias("target_article_id"), F.col("second_id").alias("article_id")
    )
    return confirmed.join(sound, ["target_article_id", "article_id"], "left_anti").select(*relations.columns)


def retract_stale(relations: DataFrame, articles: DataFrame) -> DataFrame:
    from ..schemas import RELATION_KEY
    from ..sources.tables import retract

    return retract(relations, stale_relations(relations, articles), RELATION_KEY)


def dedupe_summary(assigned: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    parts = {
        "checked_articles": (assigned, F.count("*")),
        "confirmed_duplicates": (assigned, F.count("duplicate_of")),
        "possible_duplicates": (assigned, F.count("candidate_of")),
    }
    if stale is not None:
        parts["removed_stale_relations"] = (stale, F.count("*"))
    return measure(**parts)
