"""Ranked lexical search by presence masks.

The index keeps, for every document, the terms that any item uses and how often
they occur.  In a block of documents each item's terms set one bit each in the
documents' masks; documents of one mask are one group, whose score can't exceed
the sum of its terms' greatest contributions in the block.  Groups are evaluated
by descending bound until no group left can reach the item's k-th score.  Tasks
carry their best documents from block to block and return k an item; the global
ranking is made from those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .decontaminate import words

K = 10
LOT_TERMS = 100_000  # terms of the items that are searched in one pass, about; more items take more passes
BLOCK = 16_384  # documents whose masks are grouped at a time
MASK_BYTES = 1 << 25  # of the masks of one item in a block
SLAB = 64  # documents evaluated at a time
SPREAD = 64  # parts in which an item's candidates are ranked first
# A-Z to a-z; digits, letters and bytes beyond ASCII stay; all else separates terms.
TERM_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
INDEX_SCHEMA = "doc_id long, n long, terms array<int>, counts array<int>"


def lots_of(items: DataFrame) -> tuple[DataFrame, int]:
    """(lot, item_id, terms) with each item's distinct terms, and the number of lots of about LOT_TERMS terms.

    Rows that repeat an item_id are one item with the terms of all of them.
    """
    terms = cut(items.select("item_id", F.explode(words(F.col("text"))).alias("term")).distinct())
    lots = max(1, math.ceil(terms.count() / LOT_TERMS))
    found = terms.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    return cut(found.select(F.pmod(F.xxhash64("item_id"), F.lit(lots)).cast("int").alias("lot"), "item_id", "terms")), lots


def _indexed(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    get, size = vocabulary.get, len(vocabulary) + 1
    for batch in batches:
        lengths, found, docs = [], [], []
        for row, text in enumerate(batch.column(1).cast(pa.binary())):
            terms = (text.as_py() or b"").translate(TERM_BYTES).split()
            hits = [t for t in map(get, terms) if t is not None]
            lengths.append(len(terms))
            found += hits
            docs += [row] * len(hits)
        cells, counts = np.unique(np.array(docs, dtype=np.int64) * size + np.array(found, dtype=np.int64), return_counts=True)
        ends = np.searchsorted(cells // size, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (cells % size, counts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])


class _Best:
    """The k best (score, doc_id) of an item so far; ties go to the smaller doc_id, null last."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must score to be of use."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score[score > 0]]), np.concatenate([self.doc, doc[score > 0]])
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]


class Postings:
    """A block's postings by term: documents (ascending), contributions and the greatest of them."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, gains: np.ndarray):
        order = np.argsort(terms, kind="stable")
        self.docs, self.gains = docs[order], gains[order]
        self.terms, starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(starts, len(terms))
        self.most = np.maximum.reduceat(self.gains, starts) if len(starts) else self.gains

    def of(self, asked: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        held = np.searchsorted(self.terms, asked[np.isin(asked, self.terms)])
        return [(self.docs[self.ends[t] : self.ends[t + 1]], self.gains[self.ends[t] : self.ends[t + 1]], int(self.most[t])) for t in held]


def masks_of(lists: list[tuple[np.ndarray, np.ndarray, int]], low: int, high: int) -> np.ndarray:
    """[high - low, words of 64 bits]: bit j of a document is set if it holds term j."""
    masks = np.zeros((high - low, (len(lists) + 63) // 64), dtype=np.uint64)
    for j, (docs, _, _) in enumerate(lists):
        masks[docs[slice(*np.searchsorted(docs, [low, high]))] - low, j // 64] |= np.uint64(1 << (j % 64))
    return masks


def search_block(lists: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, doc_ids: np.ndarray, best: _Best) -> int:
    """Put the block's best documents of one item into ``best``; the number of documents evaluated."""
    evaluated, step = 0, max(256, MASK_BYTES // (8 * ((len(lists) + 63) // 64)))
    for low in range(0, n_docs, step):
        masks = masks_of(lists, low, min(low + step, n_docs))
        some = np.flatnonzero(masks.any(axis=1))
        if not len(some):
            continue
        groups, member = np.unique(masks[some, 0], return_inverse=True) if masks.shape[1] == 1 else np.unique(masks[some], axis=0, return_inverse=True)
        groups = groups.reshape(len(groups), -1)
        bound = np.zeros(len(groups), dtype=np.int64)
        for j, (_, _, most) in enumerate(lists):
            bound += ((groups[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64) * most
        order = np.argsort(-bound, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        by_group = np.argsort(place[member.ravel()], kind="stable")
        docs, bound = some[by_group] + low, bound[order]
        ends = np.cumsum(np.bincount(place[member.ravel()], minlength=len(order)))
        at = group = 0
        while group < len(order) and bound[group] >= best.least:
            # Whole groups, as many as a slab holds, but one at least; all of them can still reach the k-th score.
            full = int(np.searchsorted(ends, at + SLAB, side="right")) - 1
            last = max(group, min(full, int(np.searchsorted(-bound, -best.least, side="right")) - 1))
            chosen = np.sort(docs[at : ends[last]])
            score = np.zeros(len(chosen), dtype=np.int64)
            for held, gains, _ in lists:
                spot = np.minimum(np.searchsorted(held, chosen), len(held) - 1)
                score += np.where(held[spot] == chosen, gains[spot], 0)
            best.add(score, doc_ids[chosen])
            evaluated += len(chosen)
            at, group = int(ends[last]), last + 1
    return evaluated


def _best_of_task(batches: Iterator[pa.RecordBatch], asked: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> Iterator[pa.RecordBatch]:
    best = [_Best(k) for _ in asked]
    none = np.iinfo(np.int64).max  # stands for a null doc_id

    def take(table: pa.Table) -> None:
        terms, counts = (table.column(c).combine_chunks() for c in ("terms", "counts"))
        lengths = pc.list_value_length(terms).to_numpy()
        docs = np.repeat(np.arange(table.num_rows), lengths)
        ids, tf = terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64)
        damp = 10 + (90 * table.column("n").to_numpy().astype(np.int64) * n_docs) // n_terms
        gains = weights[ids] * ((1_000_000_000 * tf) // (1000 * tf + 8 * damp[docs]))
        postings = Postings(docs[gains > 0], ids[gains > 0], gains[gains > 0])
        doc_ids = table.column("doc_id").fill_null(none).to_numpy()
        for i, item in enumerate(asked):
            if lists := postings.of(item):
                search_block(lists, table.num_rows, doc_ids, best[i])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            held.append(batch.slice(start, BLOCK))
            if sum(b.num_rows for b in held) >= BLOCK:
                take(pa.Table.from_batches(held))
                held = []
    if held and sum(b.num_rows for b in held):
        take(pa.Table.from_batches(held))
    sizes = [len(b.score) for b in best]
    docs = np.concatenate([b.doc for b in best]) if best else np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(np.arange(len(best), dtype=np.int32), sizes)),
            pa.array(docs, pa.int64(), mask=docs == none),
            pa.array(np.concatenate([b.score for b in best]) if best else np.zeros(0, np.int64)),
        ],
        ["item", "doc_id", "score"],
    )


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z lower-cased;
    null texts have none.  Equal scores go to the smaller doc_id, null last; rows
    that repeat a doc_id rank each by its own text; rows that repeat an item_id
    (null is one) are one item.  Items without terms, or without documents, have
    no rows.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    docs, (terms, lots) = docs.select(F.col("doc_id").cast("long"), "text"), lots_of(items.select("item_id", "text"))
    out = None
    for lot in range(lots):
        rows = terms.filter(F.col("lot") == lot).collect()  # about LOT_TERMS terms
        vocabulary = {t: i for i, t in enumerate(sorted({t.encode() for r in rows for t in r.terms}))}
        index = cut(docs.mapInArrow(lambda batches, v=vocabulary: _indexed(batches, v), INDEX_SCHEMA))
        total = index.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        n_docs, n_terms = total.docs, total.terms or 1
        held = index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # one row a term of the lot
        weights = np.zeros(len(vocabulary), dtype=np.int64)
        for r in held:
            weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
        asked = [np.array(sorted(vocabulary[t.encode()] for t in r.terms), dtype=np.int64) for r in rows]
        found = index.filter(F.size("terms") > 0).mapInArrow(
            lambda batches, a=asked, w=weights, n=n_docs, m=n_terms: _best_of_task(batches, a, w, n, m, k), "item int, doc_id long, score long"
        )
        ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {terms.schema['item_id'].dataType.simpleString()}")
        # Every task has k rows an item: ranked in parts first, so an item's rows never meet in one task whole.
        parts = _ranked(cut(found).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))), ["item", "part"], k).drop("rank", "part")
        one = _ranked(parts, ["item"], k).join(ids, "item").select("item_id", "rank", "doc_id", "score")
        out = one if out is None else out.unionByName(one)
    return out
