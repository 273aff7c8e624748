"""Substring deduplication by a sparse suffix array, sorted with a common-prefix-aware distributed merge.

A byte goes if it lies in a string of LENGTH bytes that also starts elsewhere.

1. Suffixes are sorted at anchors only: the places of the smallest hash of KGRAM
   bytes among every WINDOW consecutive ones.  Whether a place is an anchor
   depends on the bytes around it, so equal strings of LENGTH bytes have an
   anchor at the same offset, with DEPTH more bytes of the string after it.
2. Each task sorts its anchors' suffixes (to DEPTH bytes) to runs, front-codes
   them (length of the prefix shared with the one before, and the rest), cuts
   them by splitters and sends the pieces.  A loser tree merges the pieces of a
   range; its players know how long a prefix they share with the last winner and
   compare from there only.  A suffix that shares all DEPTH bytes with the one
   before is a repeat.  Equal suffixes of a run travel once, so a passage in very
   many documents costs its number of runs.
3. Anchors of repeated suffixes are compared on their surroundings (all strings
   of LENGTH bytes to which they belong).  Surroundings that occur twice repeat as
   a whole; for the others each string is hashed and counted, for many suffixes
   in one task, for a suffix of very many surroundings over the cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, key_join, small, text_of

LENGTH = 200
WINDOW = 150
DEPTH = LENGTH - WINDOW + 1
KGRAM = 16
RUN = 200_000  # suffixes of a sorted run
PART = 24_000_000  # bytes of text for each range of the merge
SAMPLE_DOCS = 400  # documents from which the splitters come; only the evenness of the ranges depends on them
PIECE = 500_000  # bytes looked at together
SLICE = 2_000  # anchors whose surroundings are held at once
LOT = 10_000  # surroundings compared in one task, about
LARGE = 20_000  # different surroundings of one suffix from which on its strings are counted over the cluster
BEFORE = WINDOW - 1  # bytes of surroundings before an anchor; LENGTH after it
_RNG = np.random.default_rng(20_021)
BYTE = _RNG.integers(0, 2**64, 257, dtype=np.uint64)  # 256: beyond the text
AROUND = _RNG.integers(0, 2**64, BEFORE + LENGTH, dtype=np.uint64)
HEAD = _RNG.integers(0, 2**64, DEPTH, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
KEY = ["doc_id", "text_hash"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def anchors(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last): the anchors of the texts in ``buf`` (text i from bounds[i] to bounds[i + 1])
    and the first and last start of the strings of LENGTH bytes that have them as theirs."""
    out = [[], [], []]
    total = len(buf)
    for begin in range(0, total - LENGTH + 1, PIECE):
        stop = min(begin + PIECE, total - LENGTH + 1)  # starts looked at: begin .. stop - 1
        h = BYTE[buf[begin : stop + WINDOW + KGRAM - 2]]
        span = 1
        while span < KGRAM:
            h = h[:-span] * np.uint64(0x100000001B3 + 2 * span) + h[span:]
            span *= 2
        low = (mix(h) & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)  # of equal ones the leftmost
        span = 1
        while span * 2 <= WINDOW:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: len(low) - (WINDOW - span)], low[WINDOW - span :])
        place = (low[: stop - begin] & np.uint64(0xFFFFFF)).astype(np.int64) + begin
        ends = bounds[1:]
        for e in ends[(ends > begin) & (ends - LENGTH < stop)]:  # strings that would cross an end
            place[max(e - LENGTH + 1 - begin, 0) : max(e - begin, 0)] = -1
        edge = np.concatenate([[0], np.nonzero(place[1:] != place[:-1])[0] + 1, [len(place)]])
        p, lo, hi = place[edge[:-1]], edge[:-1] + begin, edge[1:] - 1 + begin
        if out[0] and len(p) and out[0][-1][-1] == p[0]:  # goes on over the edge of a piece
            out[2][-1][-1] = hi[0]
            p, lo, hi = p[1:], lo[1:], hi[1:]
        if len(p):
            for o, x in zip(out, (p, lo, hi), strict=True):
                o.append(x)
    p, lo, hi = (np.concatenate(o) if o else np.empty(0, np.int64) for o in out)
    held = p >= 0
    return p[held], lo[held], hi[held]


def heads(buf: np.ndarray, places: np.ndarray) -> np.ndarray:
    return buf[places[:, None] + np.arange(DEPTH)]


def head_hash(rows: np.ndarray) -> np.ndarray:
    return mix((rows.astype(np.uint64) + np.uint64(1)) @ HEAD).astype(np.int64)


def surroundings(buf: np.ndarray, places: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes from BEFORE before to LENGTH after each place; 256 outside its text."""
    at = places[:, None] + np.arange(-BEFORE, LENGTH)
    inside = (at >= begin[:, None]) & (at < end[:, None])
    return np.where(inside, buf[np.clip(at, 0, len(buf) - 1)], 256).astype(np.int16)


def string_hashes(around: np.ndarray) -> np.ndarray:
    """[anchors, BEFORE + 1]: hash of the string of LENGTH bytes that starts ``column`` bytes before the anchor."""
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(around.shape[1], BASE, np.uint64)]))
    sums = np.zeros((len(around), around.shape[1] + 1), dtype=np.uint64)
    np.cumsum(BYTE[around] * powers[:-1], axis=1, out=sums[:, 1:])
    start = BEFORE - np.arange(BEFORE + 1)
    # Brought to the same power, so equal strings agree wherever they stand.
    return mix((sums[:, start + LENGTH] - sums[:, start]) * powers[BEFORE - start])


def chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, bounds) of about PIECE bytes of whole texts at a time."""
    for batch in batches:
        texts = batch.column(column)
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32 if texts.type == pa.binary() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + PIECE, side="right")) - 1)
            yield batch.slice(start, stop - start), data[bounds[start] : bounds[stop]], bounds[start : stop + 1] - bounds[start]
            start = stop


# --- sorted runs -------------------------------------------------------------------------------


def front_code(rows: np.ndarray, twice: np.ndarray) -> bytes:
    """Sorted rows as: their number, the length each shares with the one before, whether it came twice, the rest of each."""
    shared = np.zeros(len(rows), dtype=np.uint8)
    if len(rows) > 1:
        shared[1:] = (rows[1:] != rows[:-1]).argmax(1)
    rest = rows[np.arange(DEPTH) >= shared[:, None]]
    return np.int64(len(rows)).tobytes() + shared.tobytes() + twice.astype(np.uint8).tobytes() + rest.tobytes()


def front_decode(blob: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(suffix, length shared with the one before, came twice)."""
    n = int(np.frombuffer(blob[:8], np.int64)[0])
    at, last = 8 + 2 * n, b""
    for i in range(n):
        shared = blob[8 + i]
        size = DEPTH - shared
        last = last[:shared] + blob[at : at + size]
        at += size
        yield last, shared, blob[8 + n + i]


def sorted_run(suffixes: np.ndarray, splitters: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(range, front-coded piece) of one run."""
    flat = np.ascontiguousarray(suffixes).view(f"S{DEPTH}").ravel()
    every, counts = np.unique(flat, return_counts=True)
    cuts = np.concatenate([[0], np.searchsorted(every, splitters, side="right"), [len(every)]])
    rows = every.view(np.uint8).reshape(-1, DEPTH)
    for part in range(len(cuts) - 1):
        if cuts[part] < cuts[part + 1]:
            piece = slice(cuts[part], cuts[part + 1])
            yield part, front_code(rows[piece], counts[piece] > 1)


def _runs(batches: Iterator[pa.RecordBatch], splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def send():
        pieces = list(sorted_run(np.concatenate(held), splitters))
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in pieces], pa.int32()), pa.array([b for _, b in pieces], pa.binary())], ["part", "piece"])

    for _, buf, bounds in chunks(batches, 0):
        rows = heads(buf, anchors(buf, bounds)[0])
        if len(rows):
            held.append(rows)
            size += len(rows)
        if size >= RUN:
            yield send()
            held, size = [], 0
    if size:
        yield send()


class LoserTree:
    """Merges sorted runs; yields (suffix, length shared with the one before, came twice in its run).

    Each player holds a suffix and the length of the prefix that it shares with
    the last winner it lost to or followed.  Of two, the one that shares more is
    smaller; only if both share alike are bytes compared, from there on.
    """

    def __init__(self, runs: list[Iterator[tuple[bytes, int, int]]]):
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.suffix, self.shared, self.twice = [None] * self.size, [0] * self.size, [0] * self.size
        for k, run in enumerate(runs):
            first = next(run, None)
            if first:
                self.suffix[k], _, self.twice[k] = first
        self.lost = [0] * self.size
        self.winner = self._play(1) if self.size > 1 else 0

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, loser = self._match(self._play(2 * node), self._play(2 * node + 1))
        self.lost[node] = loser
        return winner

    def _match(self, a: int, b: int) -> tuple[int, int]:
        s, t = self.suffix[a], self.suffix[b]
        if s is None:
            return b, a
        if t is None:
            return a, b
        i, j = self.shared[a], self.shared[b]
        if i != j:
            return (a, b) if i > j else (b, a)
        while i < DEPTH and s[i] == t[i]:
            i += 1
        if i == DEPTH or s[i] < t[i]:
            self.shared[b] = i
            return a, b
        self.shared[a] = i
        return b, a

    def __iter__(self) -> Iterator[tuple[bytes, int, int]]:
        suffix, shared, lost, match = self.suffix, self.shared, self.lost, self._match
        w = self.winner
        while suffix[w] is not None:
            yield suffix[w], shared[w], self.twice[w]
            after = next(self.runs[w], None) if w < len(self.runs) else None
            if after:
                suffix[w], shared[w], self.twice[w] = after
            else:
                suffix[w] = None
            node = (w + self.size) >> 1
            while node:
                w, lost[node] = match(w, lost[node])
                node >>= 1


def _merge(pieces: pd.DataFrame) -> pd.DataFrame:
    """Hashes of the suffixes that occur more than once in a range."""
    out, last, found = [], None, False
    for suffix, shared, twice in LoserTree([front_decode(p) for p in pieces["piece"]]):
        if last is not None and shared == DEPTH:
            found = True
            continue
        if found:
            out.append(last)
        last, found = suffix, bool(twice)
    if found:
        out.append(last)
    rows = np.frombuffer(b"".join(out), dtype=np.uint8).reshape(-1, DEPTH)
    return pd.DataFrame({"head": head_hash(rows) if len(rows) else np.empty(0, np.int64)})


def repeated_heads(docs: DataFrame, total: int) -> DataFrame:
    """(head): hashes of the anchors' suffixes of DEPTH bytes that occur more than once; ``docs`` has ``data``, of ``total`` bytes."""
    few = docs.orderBy(F.xxhash64("data"), "data").filter(F.octet_length("data") >= LENGTH).select(F.substring("data", 1, 20_000).alias("data")).limit(SAMPLE_DOCS)
    sample = [heads(b, anchors(b, np.array([0, len(b)]))[0]) for r in few.collect() for b in [np.frombuffer(bytes(r.data), np.uint8)]]
    parts = max(1, -(-total // PART)) * 2
    splitters = np.empty(0, f"S{DEPTH}")
    if sample:
        every = np.unique(np.ascontiguousarray(np.concatenate(sample)).view(f"S{DEPTH}").ravel())
        splitters = np.unique(every[np.linspace(0, len(every) - 1, parts + 1).astype(int)[1:-1]])
    pieces = docs.select("data").mapInArrow(partial(_runs, splitters=splitters), "part int, piece binary")
    return cut(pieces.repartition(len(splitters) + 1, "part").groupBy("part").applyInPandas(_merge, "head long"))


# --- from repeated suffixes to spans -----------------------------------------------------------


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_hash", "head", "around", "place", "least", "most"]
    for rows, buf, bounds in chunks(batches, 2):
        every = anchors(buf, bounds)
        for a in range(0, len(every[0]), SLICE):
            p, lo, hi = (x[a : a + SLICE] for x in every)
            doc = np.searchsorted(bounds, p, side="right") - 1
            around = surroundings(buf, p, bounds[doc], bounds[doc + 1]).astype(np.uint64)
            around += np.uint64(1)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(take), rows.column(1).take(take), pa.array(head_hash(heads(buf, p))), pa.array(mix(around @ AROUND).astype(np.int64)),
                 pa.array(p - bounds[doc]), pa.array((p - hi).astype(np.int16)), pa.array((p - lo).astype(np.int16))], names)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The asked anchors with their surroundings: bytes, and how many of them come before the anchor."""
    names = ["head", "around", "single", "large", "least", "most"]
    for batch in batches:
        texts, asked = batch.column(0), batch.column(1)
        each = asked.flatten()
        doc = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
        place = each.field("place").to_numpy(zero_copy_only=False)
        pieces, before, last, data = [], [], -1, b""
        for d, p in zip(doc, place, strict=True):
            if d != last:
                last, data = d, texts[int(d)].as_py()
            before.append(min(BEFORE, p))
            pieces.append(data[p - before[-1] : p + LENGTH])
        yield pa.RecordBatch.from_arrays(
            [*[each.field(n) for n in names], pa.array(before, pa.int16()), pa.array(pieces, pa.binary())], [*names, "before", "bytes"])


def _hashed(least, most, before, pieces) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, held) [surroundings, BEFORE + 1] of the strings that belong to each anchor, by how far they start before it."""
    around = np.full((len(pieces), BEFORE + LENGTH), 256, dtype=np.int16)
    for k, (b, piece) in enumerate(zip(before, pieces, strict=True)):
        around[k, BEFORE - b : BEFORE - b + len(piece)] = np.frombuffer(piece, np.uint8)
    columns = np.arange(BEFORE + 1)
    return string_hashes(around), (columns >= np.asarray(least)[:, None]) & (columns <= np.asarray(most)[:, None])


def _repeated(rows: pd.DataFrame) -> pd.DataFrame:
    """(head, around, before): for single surroundings, how far before the anchor its repeated strings start."""
    keys, held = [], []
    for a in range(0, len(rows), SLICE):
        part = rows.iloc[a : a + SLICE]
        hashes, mine = _hashed(part["least"], part["most"], part["before"], part["bytes"])
        held.append(mine)
        keys.append(mix(hashes ^ mix(part["head"].to_numpy().astype(np.uint64))[:, None])[mine])
    held = np.concatenate(held)
    _, at, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    again = np.zeros(held.shape, dtype=bool)
    again[held] = counts[at] > 1
    chosen = np.nonzero(rows["single"].to_numpy(dtype=bool) & again.any(1))[0]
    return pd.DataFrame({"head": rows["head"].to_numpy()[chosen], "around": rows["around"].to_numpy()[chosen], "before": [np.nonzero(again[k])[0].astype(np.int32) for k in chosen]})


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(head, around, single, least, hashes) of surroundings; columns as those of ``_contexts``."""
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            part = batch.slice(a, SLICE)
            least, most, before = (part.column(k).to_numpy().astype(int) for k in (4, 5, 6))
            hashes, held = _hashed(least, most, before, part.column(7).to_pylist())
            offsets = np.concatenate([[0], np.cumsum(held.sum(1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(k) for k in (0, 1, 2)], pa.array(least.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.astype(np.int64)[held]))],
                ["head", "around", "single", "least", "hashes"])


def spans_of(docs: DataFrame, total: int) -> DataFrame:
    """(doc_id, text_hash, spans): merged (start, stop) bytes to remove of each document that has any; ``docs`` has ``data``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    repeated = repeated_heads(docs, total)
    schema = f"doc_id {kind}, text_hash long, head long, around long, place long, least smallint, most smallint"
    found = docs.select(*KEY, "data").mapInArrow(_anchored, schema)
    found = cut(found.join(repeated, "head", "left_semi"))

    rep = F.min(F.struct("doc_id", "text_hash", "place", "least", "most")).alias("rep")
    kinds = cut(found.groupBy("head", "around").agg(F.count("*").alias("times"), rep))
    mixed = kinds.groupBy("head").agg(F.count("*").alias("kinds"), F.count_if(F.col("times") == 1).alias("singles")).filter("kinds > 1 AND singles > 0")
    asked = kinds.join(cut(mixed.select("head", (F.col("kinds") > LARGE).alias("large"))), "head")
    one = F.struct("head", "around", (F.col("times") == 1).alias("single"), "large", "rep.place", "rep.least", "rep.most")
    per_doc = cut(asked.groupBy("rep.doc_id", "rep.text_hash").agg(F.sort_array(F.collect_list(one)).alias("asked")))  # a document's own anchors
    texts = key_join(docs.select(*KEY, "data"), per_doc, KEY).select("data", "asked")
    schema = "head long, around long, single boolean, large boolean, least smallint, most smallint, before smallint, bytes binary"
    contexts = cut(texts.mapInArrow(_contexts, schema))
    lots = max(1, -(-contexts.count() // LOT))
    usual = contexts.filter("NOT large").withColumn("lot", F.pmod(F.xxhash64("head"), F.lit(lots)))
    before = usual.repartition(lots, "lot").groupBy("lot").applyInPandas(lambda rows: _repeated(rows), "head long, around long, before array<int>")

    strings = contexts.filter("large").mapInArrow(_strings, "head long, around long, single boolean, least int, hashes array<long>")
    each = strings.select("head", "around", "single", "least", F.posexplode("hashes").alias("i", "hash"))
    again = each.groupBy("head", "hash").agg(F.count("*").alias("n"), F.max("single").alias("asked")).filter("n > 1 AND asked").select("head", "hash")
    hits = each.filter("single").join(cut(again), ["head", "hash"], "left_semi")
    before = before.unionByName(hits.groupBy("head", "around").agg(F.sort_array(F.collect_list(F.col("least") + F.col("i"))).alias("before")))

    # Starts of repeated strings, as runs of how far they lie before the anchor.
    run_first = F.filter("before", lambda o: ~F.array_contains("before", o - 1))
    run_last = F.filter("before", lambda o: ~F.array_contains("before", o + 1))
    facts = kinds.select("head", "around", "times").join(before.select("head", "around", run_first.alias("near"), run_last.alias("far")), ["head", "around"], "left")
    facts = cut(facts.filter("times > 1 OR near is not null"))
    span = lambda far, near: F.struct((F.col("place") - far).cast("long").alias("start"), (F.col("place") - near + LENGTH).cast("long").alias("stop"))
    spans = F.when(F.col("times") > 1, F.array(span(F.col("most"), F.col("least")))).otherwise(F.zip_with("far", "near", span))
    rows = found.join(facts, ["head", "around"]).select(*KEY, F.explode(spans).alias("s"))
    joined = rows.groupBy(*KEY).agg(F.sort_array(F.collect_set("s")).alias("s"))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def grow(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        met = F.coalesce(s["start"] <= last["stop"], F.lit(False))
        return F.when(met, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.array_append(acc, s))

    return cut(joined.select(*KEY, F.aggregate("s", none, grow).alias("spans")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, spans), one row per input row.

    Texts are UTF-8 bytes, null is empty; ``kept`` has the remaining bytes and
    ``spans`` the (start, stop) of the maximal removed runs.  Texts under LENGTH
    bytes lose nothing.  Rows that repeat an id are each a text of their own, so
    equal rows remove each other wherever they have LENGTH bytes.
    """
    data = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().cast("binary").alias("data"))
    total = data.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("n")).first().n
    out = key_join(data, small(spans_of(data, total), cells=F.size("spans") * 4), KEY, "left")
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    out = out.withColumn("spans", F.coalesce("spans", none))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("kept"))
    piece = lambda at, stop: F.substring("data", (at + 1).cast("int"), (stop - at).cast("int"))
    done = F.aggregate("spans", start, lambda acc, s: F.struct(s["stop"].alias("at"), F.concat(acc["kept"], piece(acc["at"], s["start"])).alias("kept")))
    kept = F.concat(done["kept"], piece(done["at"], F.octet_length("data").cast("long")))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select(
        "doc_id", F.octet_length("data").cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.when(F.size("spans") == 0, F.col("data")).otherwise(kept).alias("kept"), "spans",
    )


def brute_force(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by looking at every string; for tests."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen: dict[bytes, int] = {}
    for _, b in texts:
        for a in range(len(b) - LENGTH + 1):
            s = b[a : a + LENGTH]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for a in range(len(b) - LENGTH + 1):
            if seen[b[a : a + LENGTH]] > 1:
                gone[a : a + LENGTH] = b"\x01" * LENGTH
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out
