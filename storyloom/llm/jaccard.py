"""n-gram Jaccard join with MinHash banding.

Bands and rows are chosen for a target recall at the threshold.  Texts of the
same words are one class; classes that share a band hash meet in the bucket of
that hash and are compared on their full n-gram sets at the first band they
share.  Buckets of the same classes are one.  Buckets of more than BLOCK classes
are joined to groups where they share classes, and a group's classes meet in
blocks of bounded size, each pair once.  Only degrees and a spanning forest leave
a bucket or block, so no group's pairs are ever written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.operators.components import connected_components

from .common import cut, key_join, small, text_of

NGRAM = 5
SIMILARITY = 0.8
RECALL = 0.9999  # of pairs exactly at the threshold; more alike pairs are found more surely
HASHES = 128
BLOCK = 512  # classes of a block, and of a bucket that is compared at once
WORK = 2_000  # classes of a verifying group, about
SLICE = 500_000  # words hashed at a time
SEED = 20_231


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands reach ``recall`` with at most ``hashes`` hashes."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+"), "")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words of each text and the offsets of the texts' runs.

    ``words`` are word hashes of all texts, ``offsets`` where each begins and the
    end.  A text of fewer words, but not none, is one run.
    """
    words, lengths = words.astype(np.uint64), np.diff(offsets)
    runs = np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1))
    ends = np.concatenate([[0], np.cumsum(runs)])
    first = np.repeat(offsets[:-1] - ends[:-1], runs) + np.arange(ends[-1])
    size = np.repeat(np.minimum(lengths, n), runs)
    h = np.full(ends[-1], 0x51ED27, dtype=np.uint64)
    for k in range(n):
        held = size > k
        h[held] = mix(h[held] * np.uint64(0x100000001B3) + words[first[held] + k])
    return h, ends


def band_hashes(h: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[texts, bands] of texts that have runs."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
    masks = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    out = np.zeros((len(ends) - 1, bands), dtype=np.uint64)
    for k in range(bands * rows):
        low = np.minimum.reduceat((h ^ masks[k]) * factors[k], ends[:-1])
        out[:, k // rows] = mix(out[:, k // rows] * np.uint64(0x100000001B3) + low)
    return out


def _signed(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("words"))
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        start = 0
        while start < len(lists):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE, side="right")) - 1)
            at = offsets[start : stop + 1]
            h, ends = shingles(values[at[0] : at[-1]], at - at[0], n)
            made = band_hashes(h, ends, bands, rows).astype(np.int64)
            packed = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * bands), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), packed], ["key", "bands"])
            start = stop


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the common parts of sorted sets, all of ``left`` against all of ``right``."""
    every, ids = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(ids, kind="stable")
    ids, row = ids[order], row[order]
    for start in range(0, len(every), 4_096):
        a, b = np.searchsorted(ids, [start, start + 4_096])
        cells = np.zeros((len(left) + len(right), min(4_096, len(every) - start)), dtype=np.float32)
        cells[row[a:b], ids[a:b] - start] = 1
        out += cells[: len(left)] @ cells[len(left) :].T
    return out


def linked(left: pd.DataFrame, right: pd.DataFrame, n: int, similarity: float, band: int | None = None) -> np.ndarray:
    """Which classes of ``left`` and ``right`` share a band and are alike enough on their full sets.

    In a bucket of ``band`` only pairs count that share no earlier band and do not
    meet in a group of large buckets (column ``dense``).
    """
    a, b = np.stack(left["bands"].to_numpy()), np.stack(right["bands"].to_numpy())
    near = np.zeros((len(a), len(b)), dtype=bool)
    for k in range(a.shape[1] if band is None else band):
        near |= a[:, k][:, None] == b[:, k][None]
    if band is not None:
        groups = [np.array([x or "" for x in side["dense"]]) for side in (left, right)]
        near = ~near & ((groups[0][:, None] != groups[1][None]) | (groups[0] == "")[:, None])
    if not near.any():
        return near
    sets = [
        [np.unique(shingles(np.asarray(w), np.array([0, len(w)]), n)[0]) for w in side["words"]] for side in (left, right)
    ]
    common = _overlaps(*sets)
    sizes = [np.array([len(s) for s in side], dtype=np.float32) for side in sets]
    # |A & B| >= s |A | B|, in whole numbers up to rounding of s
    return near & (common * (1 + similarity) + 1e-3 >= similarity * (sizes[0][:, None] + sizes[1][None]))


def _verify(rows: pd.DataFrame, n: int, similarity: float) -> pd.DataFrame:
    """(a, b, links, texts): per class what it has in its buckets and blocks (b null), and forest edges (links null)."""
    out = []
    for (_, i, j, band), part in rows.groupby(["group", "i", "j", "band"], sort=False):
        left, right = part[part["block"] == i], part[part["block"] == j]
        hit = linked(left, right, n, similarity, None if band < 0 else int(band))
        if i == j:
            np.fill_diagonal(hit, False)
        keys = [left["key"].to_numpy(), right["key"].to_numpy()]
        sides = [(keys[0], hit, right["copies"])] + ([] if i == j else [(keys[1], hit.T, left["copies"])])
        for key, m, copies in sides:
            held = m.any(1)
            if held.any():
                out.append(pd.DataFrame({"a": key[held], "b": None, "links": (m @ copies.to_numpy(dtype=np.int64))[held], "texts": m.sum(1)[held]}))
        # a spanning forest: each class joins the tree of the first partner of another tree
        tree = {}

        def root(x):
            while tree.setdefault(x, x) != x:
                tree[x] = tree[tree[x]]
                x = tree[x]
            return x

        edges = []
        for x, y in zip(*np.nonzero(hit), strict=True):
            p, q = root(keys[0][x]), root(keys[1][y])
            if p != q:
                tree[p] = q
                edges.append((keys[0][x], keys[1][y]))
        if edges:
            out.append(pd.DataFrame({"a": [e[0] for e in edges], "b": [e[1] for e in edges], "links": None, "texts": None}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"a": [], "b": [], "links": [], "texts": []}, dtype=object)


def _buckets(signed: DataFrame) -> DataFrame:
    """(key, band, bucket, n, b): each class in its buckets of two classes or more; ``b`` is the bucket's smallest class.

    Of buckets that hold the same classes only the one of the smallest band is kept.
    """
    each = signed.select("key", F.posexplode("bands").alias("band", "hash"))
    held = each.groupBy("band", "hash").agg(
        F.count("*").alias("n"), F.min("key").alias("b"), F.max("key").alias("last"),
        F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y"),
    )
    same = held.filter("n > 1").groupBy("n", "b", "last", "x", "y").agg(F.min(F.struct("band", "hash")).alias("first"))
    kept = cut(same.select("n", "b", "first.band", "first.hash"))
    return cut(each.join(small(kept), ["band", "hash"]).select("key", "band", F.concat_ws(":", "band", "hash").alias("bucket"), "n", "b"))


def _dense(large: DataFrame) -> DataFrame:
    """(key, dense): the groups that large buckets with common classes form.

    A class is tied to the least of its buckets' smallest classes, and that one to
    the others: as many rows as classes, and a few for the buckets.
    """
    least = large.groupBy("key").agg(F.min("b").alias("m"), F.collect_set("b").alias("others"))
    ties = cut(least).select("key", "m", "others")
    between = ties.select(F.col("m").alias("a"), F.explode("others").alias("b")).distinct()
    groups = connected_components(ties.select(F.col("key").alias("a"), F.col("m").alias("b")).unionByName(between))
    return cut(groups.select(F.col("id").alias("key"), F.col("component").alias("dense")))


def _classes(docs: DataFrame, n: int, similarity: float, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, key) of all rows, and what holds for each key: copies, links, texts, first, tree."""
    bands, rows = choose_bands(similarity, recall)
    words = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), word_list(text_of()).alias("w"))
    keyed = words.select("doc_id", "text_hash", F.when(F.size("w") > 0, F.md5(F.concat_ws(" ", "w"))).alias("key"))
    keyed = cut(keyed)
    first = F.struct(F.col("doc_id").isNull().alias("unnumbered"), "doc_id", "text_hash")
    classes = cut(keyed.filter("key is not null").groupBy("key").agg(F.count("*").alias("copies"), F.min(first).alias("first")))
    texts = words.filter(F.size("w") > 0).select(F.md5(F.concat_ws(" ", "w")).alias("key"), F.transform("w", lambda x: F.xxhash64(x)).alias("words"))

    signed = texts.mapInArrow(lambda batches: _signed(batches, n, bands, rows), "key string, bands array<long>")
    signed = cut(signed.dropDuplicates(["key"]))
    members = _buckets(signed)
    dense = _dense(members.filter(F.col("n") > block))
    sizes = dense.groupBy("dense").agg(F.ceil(F.count("*") / block).cast("int").alias("slots"))
    # Block i meets every block j >= i once; a member goes to its row and its column of that half square.
    inside = dense.join(small(cut(sizes)), "dense").withColumn("block", F.pmod(F.xxhash64("key"), F.col("slots")).cast("int"))
    inside = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    inside = inside.select("key", "dense", F.col("dense").alias("group"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.lit(-1).alias("band"))
    zero = F.lit(0)
    apart = members.filter(F.col("n") <= block).join(dense, "key", "left")
    apart = apart.select("key", "dense", F.col("bucket").alias("group"), zero.alias("i"), zero.alias("j"), zero.alias("block"), "band")
    places = cut(inside.unionByName(apart))

    chosen = texts.join(small(cut(places.select("key").distinct())), "key", "left_semi").groupBy("key").agg(F.first("words").alias("words"))
    chosen = chosen.join(signed, "key").join(classes.select("key", "copies"), "key")
    lots = max(1, math.ceil(places.count() / WORK))
    work = places.join(chosen, "key").withColumn("lot", F.pmod(F.xxhash64("group", "i", "j"), F.lit(lots)))
    checked = work.select("lot", "group", "i", "j", "block", "band", "dense", "key", "bands", "copies", "words")
    checked = cut(checked.groupBy("lot").applyInPandas(lambda found: _verify(found, n, similarity), "a string, b string, links long, texts long"))

    degrees = checked.filter("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    trees = connected_components(checked.filter("b is not null").select("a", "b")).toDF("key", "tree")
    known = classes.join(degrees, "key", "left").join(trees, "key", "left")
    return keyed, cut(known.withColumns({"tree": F.coalesce("tree", "key"), "links": F.coalesce("links", F.lit(0)), "texts": F.coalesce("texts", F.lit(0))}))


def near_duplicates(docs: DataFrame, n: int = NGRAM, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links, n_texts, text_hash, class_key), one row per input row.

    Words are lower-cased runs of letters and digits.  class_id is the smallest
    doc_id that verified links and equal words lead to; n_copies counts the rows
    of the same words; n_links counts the other rows of similarity >=
    ``similarity``, copies included; n_texts the different texts among them.
    Texts without words (null, empty) are alike to none: class_id is their own
    doc_id.  A null doc_id is a row without number; a class of such rows has a
    null class_id.  Rows that repeat are copies.  class_key names the class whatever
    the ids (null for texts without words), text_hash the whole text.
    """
    keyed, known = _classes(docs, n, similarity, recall, block)
    lead = known.groupBy("tree").agg(F.min("first.doc_id").alias("class_id"))
    facts = cut(known.join(lead, "tree").select("key", "copies", "class_id", "tree", "links", "texts"))
    out = keyed.join(facts, "key", "left")
    one = F.coalesce("copies", F.lit(1))
    return out.select(
        "doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        one.alias("n_copies"), (one - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_texts"),
        "text_hash", F.col("tree").alias("class_key"),
    )


def keep_one(docs: DataFrame, n: int = NGRAM, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row of ``docs`` for each class of near duplicates: that of the smallest doc_id (null last), then text hash.

    Texts without words are alike to none and all stay; columns stay as they are.
    """
    key = ["doc_id", "text_hash"]
    keyed, known = _classes(docs.select("doc_id", "text"), n, similarity, recall, block)
    stay = cut(known.groupBy("tree").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash"))
    times = cut(keyed.filter("key is not null").groupBy(*key).agg(F.count("*").alias("times")))
    # All but the rows that stay, and the rows that stay but come several times.
    gone = cut(key_join(times, stay, key, "left_anti").select(*key))
    several = cut(key_join(times.filter("times > 1"), stay, key, "left_semi").select(*key))
    packed = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(text_of()).alias("text_hash"))
    single = key_join(packed, small(cut(gone.unionByName(several))), key, "left_anti")
    again = key_join(packed, small(several), key, "left_semi").dropDuplicates(key)
    return single.unionByName(again).select("row.*")
