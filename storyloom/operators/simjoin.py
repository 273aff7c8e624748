"""Title similarity between distinct titles, counted tile by tile.

Similarity of an earlier title *a* and a later title *b* is
``2 * |words of a (with repeats) found in b| / (len a + len b)``.  It depends on
the word lists only, so the join runs on distinct title keys: a thousand copies
of one title are one row here.

Both sides of a block are dealt out to tiles of bounded size.  A task indexes the
later titles of a tile by length and word and streams the earlier ones past that
index.  Titles that reach the limit share one of the rarest words of both, so only
those are looked up; what meets in them is compared by all its words, whole runs
of titles at once, and never a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_key, title_tokens
from .lineage import cut

FIRST_TITLES, SECOND_TITLES = 25_000, 50_000  # of a tile
TILE_BYTES = 16_000_000  # of either side's titles
CELLS, MEETINGS = 1 << 16, 1 << 16  # compared words, titles looked up at once
SLACK = 1e-9  # of a bound worked out in doubles
OUT_ROWS = 20_000
HALF_UNIT = 0.0005  # of similarities rounded to three places
_NONE = "~"  # after every slot


def similarity(first_words: Column, second_words: Column) -> Column:
    """Raw similarity of two word lists, 0 when either is empty."""
    shared = F.size(F.filter(first_words, lambda w: F.array_contains(second_words, w)))
    total = F.size(first_words) + F.size(second_words)
    both = (F.size(first_words) > 0) & (F.size(second_words) > 0)
    # Equal lists share all; long ones aren't held word against word for that.
    return F.when(both & (first_words == second_words), F.lit(1.0)).when(both, 2.0 * shared / total).otherwise(F.lit(0.0))


def title_similarity(first: Column | str, second: Column | str) -> Column:
    return similarity(title_tokens(first), title_tokens(second))


class _Index:
    """Titles of the later side by length and word, the rarest words first.

    Two titles that share ``o`` words or more meet in the rarest word they share,
    and each has ``o`` words or more from that one on (repeats of the earlier title
    count).  So a title is looked up by its rarest words only, among titles of a
    fitting length, and what meets there is compared as a whole.
    """

    def __init__(self, keys: pa.Array):
        lists = pc.split_pattern(keys, " ")
        coded = lists.values.dictionary_encode()
        lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        n, size = len(keys), len(coded.dictionary)
        self.keys, self.by_length = keys, np.argsort(lengths, kind="stable")
        self.lengths = lengths[self.by_length]
        number = np.empty(n, dtype=np.int64)
        number[self.by_length] = np.arange(n)
        rows = np.repeat(number, lengths)
        words = _distinct(rows * size + coded.indices.to_numpy()) % size
        order = np.argsort(np.bincount(words, minlength=size), kind="stable")
        rank = np.empty(size, dtype=np.int64)
        rank[order] = np.arange(size)
        self.words, self.size = coded.dictionary.take(pa.array(order)), size
        self.places = _distinct(rows * size + rank[coded.indices.to_numpy()])
        rows, words = self.places // size, self.places % size
        left = np.searchsorted(rows, rows, side="right") - np.arange(len(rows))  # words of the title from this one on
        self.marks = _marks(rows, words, n)
        # A class holds one length, or some long ones within an eighth of each other.
        self.least = np.array(_class_starts(int(lengths.max(initial=0))), dtype=np.int64)
        kind = np.searchsorted(self.least, self.lengths, side="right") - 1
        self.kinds = np.unique(kind)
        self.spans = np.searchsorted(rows, np.searchsorted(kind, np.arange(len(self.least) + 1)))
        self.most_left = int(left.max(initial=0))
        line = (kind[rows] * size + words) * (self.most_left + 1) + self.most_left - left
        at = np.argsort(line, kind="stable")
        self.line, self.rows = line[at], rows[at]

    def matches(self, keys: pa.Array, limits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in ``keys``, place in the index, similarity) of different titles that reach the limit of the earlier one."""
        lists = pc.split_pattern(keys, " ")
        lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        known = pc.index_in(lists.values, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        rows = np.repeat(np.arange(len(keys), dtype=np.int64), lengths)[known >= 0]
        place, repeats = np.unique(rows * self.size + known[known >= 0], return_counts=True)
        if not len(place):
            return
        row, word = place // self.size, place % self.size
        ends = np.searchsorted(row, np.arange(len(keys) + 1))
        upto = np.concatenate([[0], np.cumsum(repeats)])
        left = upto[ends[row + 1]] - upto[:-1]  # words of the title from this one on, with repeats
        # Shared by the words repeated most: what a number of different words comes to at best.
        best = np.cumsum(repeats[np.lexsort((-repeats, row))]) - upto[ends[row]]
        line_of_best, most = row * (int(lengths.max()) + 2) + best, int(lengths.max()) + 1
        marks = _marks(row, word, len(keys))
        spare = np.diff(ends) - np.bitwise_count(marks).sum(axis=1, dtype=np.int64)  # words that share a mark with another
        for kind in self.kinds:
            # What has to be shared at least, for the shortest titles of the class.
            need = np.maximum(np.ceil(limits * (lengths + self.least[kind]) / 2.0 - SLACK), 1)
            need = np.minimum(need, most).astype(np.int64)
            apart = np.searchsorted(line_of_best, np.arange(len(keys)) * (most + 1) + need) - ends[:-1] + 1  # different words at least
            asks = np.nonzero((left >= need[row]) & (apart[row] <= self.most_left))[0]
            line = (kind * self.size + word[asks]) * (self.most_left + 1)
            start = np.searchsorted(self.line, line)
            times = np.searchsorted(self.line, line + self.most_left - apart[row[asks]], side="right") - start
            asks, start, times = asks[times > 0], start[times > 0], times[times > 0]
            places = self.places[self.spans[kind] : self.spans[kind + 1]]
            titles = np.searchsorted(row[asks], np.arange(len(keys) + 1))  # a title's words stay together, so its pairs are found once
            for low, high in _portions(np.diff(np.concatenate([[0], np.cumsum(times)])[titles]), MEETINGS):
                part = slice(titles[low], titles[high])
                first, second = np.repeat(row[asks[part]], times[part]), self.rows[_run(start[part], times[part])]
                common = np.bitwise_count(marks[first] & self.marks[second]).sum(axis=1, dtype=np.int64) + spare[first]
                near = common >= apart[first]
                cell = _distinct(first[near] * len(self.keys) + second[near])
                first, second = cell // len(self.keys), cell % len(self.keys)
                for low, high in _portions(ends[first + 1] - ends[first], CELLS):
                    one, two = first[low:high], second[low:high]
                    n = ends[one + 1] - ends[one]
                    mine = _run(ends[one], n)
                    sought = np.repeat(two * self.size, n) + word[mine]
                    held = places[np.minimum(np.searchsorted(places, sought), len(places) - 1)] == sought
                    count = np.add.reduceat(np.where(held, repeats[mine], 0), np.concatenate([[0], np.cumsum(n)[:-1]]))
                    similar = 2.0 * count / (lengths[one] + self.lengths[two])
                    reached = similar >= limits[one]
                    yield one[reached], self.by_length[two[reached]], similar[reached]


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """The different ones, sorted."""
    held = np.sort(numbers)
    return held[np.concatenate([[True], held[1:] != held[:-1]])] if len(held) else held


def _marks(rows: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """A bit of two numbers a row for every word."""
    bit = (words * 0x9E3779B1) % (1 << 32) >> 25
    marks = np.zeros((n, 2), dtype=np.uint64)
    np.bitwise_or.at(marks, (rows, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return marks


def _class_starts(longest: int) -> list[int]:
    starts = [0]
    while starts[-1] < longest:
        starts.append(max(starts[-1] + 1, starts[-1] * 9 // 8))
    return starts


def _portions(times: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Borders of stretches of ``times`` that add up to ``most`` or less, one entry at least."""
    upto, low = np.concatenate([[0], np.cumsum(times)]), 0
    while low < len(times) and upto[low] < upto[-1]:
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + most, side="right")) - 1)
        yield low, high
        low = high


def _run(start: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The ``times`` numbers from each ``start`` on."""
    ends = np.cumsum(times)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + times, times)


def _tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similar titles of rows sorted by tile, the later side first."""
    now, later, index, out, waiting = None, [], None, [], 0
    for batch in batches:
        tile, is_first, keys, limits = (batch.column(i) for i in range(4))
        changes = pc.or_(pc.not_equal(tile[1:], tile[:-1]), pc.not_equal(is_first[1:], is_first[:-1])).to_numpy(zero_copy_only=False)
        edges = [0, *(np.nonzero(changes)[0] + 1).tolist(), len(keys)]
        for low, high in zip(edges, edges[1:], strict=False):
            if low == high:
                continue
            if tile[low].as_py() != now:
                now, later, index = tile[low].as_py(), [], None
            part = keys[low:high]
            if not is_first[low].as_py():
                later.append(part)
                continue
            if not later:
                continue
            if index is None:
                index = _Index(pa.concat_arrays(later))
            for a, b, similarity_ in index.matches(part, limits[low:high].to_numpy()):
                first, second = part.take(pa.array(a)), index.keys.take(pa.array(b))
                other = pc.not_equal(first, second)
                pairs = pa.RecordBatch.from_arrays([first, second, pa.array(similarity_)], ["first_key", "second_key", "similarity"]).filter(other)
                out.append(pairs)
                waiting += len(pairs)
                if waiting >= OUT_ROWS:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches(max_chunksize=OUT_ROWS)
                    out, waiting = [], 0
    if waiting:
        yield from pa.Table.from_batches(out).combine_chunks().to_batches(max_chunksize=OUT_ROWS)


def _in_tiles(first: DataFrame, second: DataFrame, columns: list[str], dealt_by: list[str]) -> DataFrame:
    """Rows of both sides by tile, the later side first; ``columns`` beside tile and is_first, rows are dealt out by ``dealt_by``."""
    size = lambda df, most: df.groupBy("block").agg(
        F.ceil(F.greatest(F.count("*") / most, F.sum(F.length("title_key")) / TILE_BYTES)).cast("int").alias("fan")
    )
    firsts = size(first, FIRST_TITLES).withColumnRenamed("fan", "first_fan")
    fans = cut(firsts.join(size(second, SECOND_TITLES).withColumnRenamed("fan", "second_fan"), "block"))
    tiles = fans.agg(F.coalesce(F.sum(F.col("first_fan") * F.col("second_fan")), F.lit(1))).first()[0]
    fan = F.broadcast(fans)  # a row a block of the period
    chunk = lambda c: F.pmod(F.xxhash64(*dealt_by), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    named = lambda df, is_first: df.select(
        F.concat_ws("\u0001", "block", F.col("i").cast("string"), F.col("j").cast("string")).alias("tile"), F.lit(is_first).alias("is_first"), *columns
    )
    left = first.join(fan, "block").withColumn("i", chunk("first_fan")).withColumn("j", every("second_fan"))
    right = second.join(fan, "block").withColumn("j", chunk("second_fan")).withColumn("i", every("first_fan"))
    rows = named(left, True).unionByName(named(right, False))
    return rows.repartition(min(2 * tiles, 5_000), "tile").sortWithinPartitions("tile", "is_first", *dealt_by)


def similar_titles(first: DataFrame, second: DataFrame) -> DataFrame:
    """(first_key, second_key, similarity) of different keys that reach the threshold.

    ``first`` has the distinct title_key, block and threshold, ``second``
    title_key and block; only equal blocks meet.
    """
    rows = _in_tiles(first, second.withColumn("threshold", F.lit(0.0)), ["title_key", "threshold"], ["title_key"])
    return rows.mapInArrow(_tile_pairs, "first_key STRING, second_key STRING, similarity DOUBLE")


class _Asks:
    """Asks of a tile, sorted by title, with the earliest slot found so far for each."""

    def __init__(self, keys: pa.Array, since: np.ndarray):
        coded = keys.dictionary_encode()
        self.keys, self.since, self.index = keys, since, _Index(coded.dictionary)
        self.starts = np.searchsorted(coded.indices.to_numpy(), np.arange(len(coded.dictionary) + 1))
        self.best = np.full(len(keys), _NONE, dtype=object)

    def meet(self, keys: pa.Array, at: np.ndarray, slots: np.ndarray, factors: np.ndarray, least: float) -> None:
        """Offer rows of leads sorted by title and date; their slots have the order of their dates."""
        coded = keys.dictionary_encode()
        n = len(coded.dictionary)
        codes = coded.indices.to_numpy().astype(np.int64)
        starts = np.searchsorted(codes, np.arange(n + 1))
        dates, place = np.unique(at, return_inverse=True)
        line = codes * (len(dates) + 1) + place
        factor = factors[starts[:-1]]
        earliest = np.full(len(self.keys), len(keys), dtype=np.int64)
        order = np.argsort(slots, kind="stable")
        rank = np.empty(len(keys), dtype=np.int64)
        rank[order] = np.arange(len(keys))
        wanted = np.searchsorted(dates, self.since)
        for first, second, similarity_ in self.index.matches(coded.dictionary, (least - HALF_UNIT) / factor):
            near = (np.floor(similarity_ * factor[first] * 1000.0 + 0.5) / 1000.0 >= least) & pc.not_equal(
                coded.dictionary.take(pa.array(first)), self.index.keys.take(pa.array(second))
            ).to_numpy(zero_copy_only=False)
            first, second = first[near], second[near]
            times = self.starts[second + 1] - self.starts[second]
            for low, high in _portions(times, MEETINGS):
                ask = _run(self.starts[second[low:high]], times[low:high])
                title = np.repeat(first[low:high], times[low:high])
                found = np.searchsorted(line, title * (len(dates) + 1) + wanted[ask])
                held = found < starts[title + 1]
                np.minimum.at(earliest, ask[held], rank[found[held]])
        hit = np.nonzero(earliest < len(keys))[0]
        self.best[hit] = np.minimum(self.best[hit], slots[order[earliest[hit]]])

    def answers(self) -> pa.RecordBatch:
        hit = np.nonzero(self.best != _NONE)[0]
        return pa.RecordBatch.from_arrays(
            [self.keys.take(pa.array(hit)), pa.array(self.since[hit], pa.int64()), pa.array(self.best[hit].tolist(), pa.string())], ["title_key", "since", "lead_slot"]
        )


def _tile_earliest(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Earliest similar leads of the asks, of rows sorted by tile, asks first, then by title and date."""
    now, later, asks = None, [], None
    for batch in batches:
        tile, is_first, keys, at, slots, factors = (batch.column(i) for i in range(6))
        changes = pc.or_(pc.not_equal(tile[1:], tile[:-1]), pc.not_equal(is_first[1:], is_first[:-1])).to_numpy(zero_copy_only=False)
        edges = [0, *(np.nonzero(changes)[0] + 1).tolist(), len(keys)]
        for low, high in zip(edges, edges[1:], strict=False):
            if low == high:
                continue
            if tile[low].as_py() != now:
                if asks is not None:
                    yield from pa.Table.from_batches([asks.answers()]).to_batches(max_chunksize=OUT_ROWS)
                now, later, asks = tile[low].as_py(), [], None
            part, dates = keys[low:high], at[low:high].to_numpy()
            if not is_first[low].as_py():
                later.append((part, dates))
            elif later:
                if asks is None:
                    asks = _Asks(pa.concat_arrays([k for k, _ in later]), np.concatenate([d for _, d in later]))
                asks.meet(part, dates, np.array(slots[low:high].to_pylist(), dtype=object), factors[low:high].to_numpy(), least)
    if asks is not None:
        yield from pa.Table.from_batches([asks.answers()]).to_batches(max_chunksize=OUT_ROWS)


def earliest_similar(leads: DataFrame, asks: DataFrame, least: float) -> DataFrame:
    """(title_key, since, lead_slot): for every ask the earliest lead with another, similar title.

    ``leads`` has block, title_key, at, slot and factor, ``asks`` block, title_key
    and since; only equal blocks meet.  A lead counts where its ``at`` is ``since``
    or later and the similarity times the factor, rounded, is ``least`` or more;
    inside a block slots must have the order of ``at``.  Meetings stay inside a
    task: what leaves it is a row an ask.
    """
    late = asks.select("block", "title_key", F.col("since").alias("at"), F.lit(None).cast("string").alias("slot"), F.lit(0.0).alias("factor"))
    rows = _in_tiles(leads, late, ["title_key", "at", "slot", "factor"], ["title_key", "at"])
    found = rows.mapInArrow(lambda batches: _tile_earliest(batches, least), "title_key STRING, since BIGINT, lead_slot STRING")
    return found.groupBy("title_key", "since").agg(F.min("lead_slot").alias("lead_slot"))


def title_units(articles: DataFrame, block_hours: int | None = None) -> DataFrame:
    """Distinct (title_key, block) of articles with a usable title; undated articles get a null block."""
    at = F.unix_millis(F.col("published_at").cast("timestamp"))
    block = F.floor(at / (block_hours * 3600 * 1000)) if block_hours else F.lit(0).cast("long")
    keys = F.filter(F.array(title_key("title")), lambda k: k != "")  # exploded, so that a title is cut up once, not again in a filter
    return articles.select(F.explode(keys).alias("title_key"), block.alias("block")).distinct()


def title_similarity_join(
    articles: DataFrame, threshold: float, window_hours: int | None = None, beyond: float | None = None
) -> DataFrame:
    """Ordered pairs of different titles at or above ``threshold``.

    With ``window_hours`` only titles published in the same or a neighbouring
    block of that length meet (a superset of "within the window"); titles of
    undated articles meet every title; ``beyond`` adds the pairs at or above
    that higher threshold at any distance.  All of it is one join: the kinds of
    meeting are block names.
    """
    units = cut(title_units(articles, window_hours))
    titles = units.select("title_key").distinct()
    limit = lambda df, t: df.withColumn("threshold", F.lit(float(t)))
    named = lambda df, name: df.select("title_key", F.lit(name).alias("block"))
    if window_hours is None:
        every = named(titles, "all")
        return similar_titles(limit(every, threshold), every)
    dated = units.filter("block IS NOT NULL")
    undated = units.filter("block IS NULL").select("title_key")
    first = limit(dated.select("title_key", F.col("block").cast("string").alias("block")), threshold)
    # the later title may lie in the next block
    second = dated.select(
        "title_key", F.explode(F.array(F.col("block"), F.col("block") - 1).cast("array<string>")).alias("block")
    ).distinct()
    first = first.unionByName(limit(named(undated, "undated first"), threshold)).unionByName(
        limit(named(titles, "undated second"), threshold)
    )
    second = second.unionByName(named(titles, "undated first")).unionByName(named(undated, "undated second"))
    if beyond is not None:
        first = first.unionByName(limit(named(titles, "beyond"), beyond))
        second = second.unionByName(named(titles, "beyond"))
    return similar_titles(first, second).distinct()
