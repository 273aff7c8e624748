"""Substring deduplication over sliding spans of sentences.

From every sentence on, the run of the fewest consecutive sentences (SENTENCES at
least) that holds WORDS words is hashed and counted over all documents; sentences
covered by a repeated run that is not its first occurrence go.  Runs are measured
in words so that a passage is found whether it is two long sentences or ten short
ones, and short phrases that texts share by chance are left alone.  Sentences of
more than LONG words are taken clause by clause, so a passage that begins or ends
inside a sentence is met at the next clause.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, key_join, small, text_of

SENTENCES = 2  # consecutive sentences that a run has at least
WORDS = 20  # words that a run has at least
LONG = 12  # words beyond which a sentence is cut at its clause marks
ROWS = 1_000  # texts taken apart at a time
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n][.!?]*|[^.!?\n]+")
CLAUSE = re.compile(r"[^,;:]*[,;:]|[^,;:]+")
DOC = ["doc_id", "text_hash", "nth"]
RUNS = "doc_id long, text_hash long, nth long, pos int, last int, high long, low long"


def sentences(text: str) -> tuple[list[str], list[bytes], list[int]]:
    """The text cut into sentences and clauses (joined they are the text), the same lower-cased with single spaces, and their words."""
    parts, normal, counts = [], [], []
    for sentence in SENTENCE.findall(text):
        words = sentence.lower().encode().split()
        if len(words) <= LONG:
            parts.append(sentence)
            normal.append(b" ".join(words))
            counts.append(len(words))
            continue
        for clause in CLAUSE.findall(sentence):
            words = clause.lower().encode().split()
            parts.append(clause)
            normal.append(b" ".join(words))
            counts.append(len(words))
    return parts, normal, counts


def runs(normal: list[bytes], counts: list[int], least: int = SENTENCES, words: int = WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(pos, last, digest) of each run, by the places of its first and last sentence.  Blank sentences (line ends) are skipped."""
    at = [i for i, n in enumerate(counts) if n]
    stop = held = 0
    for start, pos in enumerate(at):
        while stop < len(at) and (held < words or stop - start < least):
            held += counts[at[stop]]
            stop += 1
        if held < words or stop - start < least:
            return
        yield pos, at[stop - 1], hashlib.blake2b(b"\n".join([normal[i] for i in at[start:stop]]), digest_size=16).digest()
        held -= counts[pos]


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _hashed(batches: Iterator[pa.RecordBatch], least: int, words: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        row, pos, last, digests = [], [], [], []
        for i, text in enumerate(batch.column(3).to_pylist()):
            _, normal, counts = sentences(text)
            for first, end, digest in runs(normal, counts, least, words):
                row.append(i)
                pos.append(first)
                last.append(end)
                digests.append(digest)
        keys = [batch.column(k).take(pa.array(row, pa.int64())) for k in range(3)]
        halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [*keys, pa.array(pos, pa.int32()), pa.array(last, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
            [*DOC, "pos", "last", "high", "low"],
        )


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with _id, _hash and _nth, which tell every row apart.

    Only rows that repeat a doc_id and its text need a number; they are written
    once, so that it stays the same.
    """
    rows = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_hash": F.xxhash64(text_of())})
    key = ["_id", "_hash"]
    again = cut(rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key))
    if again.isEmpty():
        return rows.withColumn("_nth", F.lit(0).cast("long"))
    single = key_join(rows, small(again), key, "left_anti").withColumn("_nth", F.lit(0).cast("long"))
    return single.unionByName(cut(key_join(rows, small(again), key, "left_semi").withColumn("_nth", F.monotonically_increasing_id())))


def repeated_spans(rows: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, nth, pos, last) of the runs of ``numbered`` rows that occur before.

    First is the smallest (doc_id, text_hash, nth, pos), null ids first.  Runs are
    equal if their 128-bit digests are.
    """
    texts = rows.select(F.col("_id").alias("doc_id"), F.col("_hash").alias("text_hash"), F.col("_nth").alias("nth"), text_of().alias("text"))
    found = cut(texts.mapInArrow(lambda batches: _hashed(batches, least, words), RUNS))
    here = F.struct(*DOC, "pos")
    first = found.groupBy("high", "low").agg(F.min(here).alias("first"), F.count("*").alias("n")).filter("n > 1")
    both = found.join(cut(first.select("high", "low", "first")), ["high", "low"])
    return both.filter(~here.eqNullSafe(F.col("first"))).select(*DOC, "pos", "last")


def _without(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows with n_sentences, n_removed and the text that is left."""
    for batch in slices(batches):
        texts, gone = batch.column(names.index("text")).to_pylist(), batch.column(len(names)).to_pylist()
        n_sentences, n_removed, kept = [], [], []
        for text, spans in zip(texts, gone, strict=True):
            parts, _, counts = sentences(text or "")
            lost = np.zeros(len(parts) + 1, dtype=np.int64)
            for span in spans or []:
                lost[span["pos"]] += 1
                lost[span["last"] + 1] -= 1
            lost = np.cumsum(lost)[:-1] > 0
            n_sentences.append(sum(n > 0 for n in counts))
            n_removed.append(sum(n > 0 for n, x in zip(counts, lost.tolist(), strict=True) if x))
            kept.append(text if text is None or not spans else "".join(p for p, x in zip(parts, lost.tolist(), strict=True) if not x))
        columns = [pa.array(kept, batch.schema.field(i).type) if name == "text" else batch.column(i) for i, name in enumerate(names)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n_sentences, pa.int64()), pa.array(n_removed, pa.int64())], [*names, "n_sentences", "n_removed"])


def remove_repeats(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``docs`` with n_sentences, n_removed and ``text`` without the sentences covered by a repeated, non-first run.

    Sentences end with their marks or line, clauses of long ones with theirs; both
    count as sentences.  Two runs are equal if their sentences are, apart from case
    and white space.  All rows and columns stay (n_sentences and n_removed replace
    columns of that name); null texts stay null and have no sentences; texts under
    ``words`` words have no runs; a text all of whose sentences repeat becomes empty.
    Of equal rows the one with the smallest doc_id (null first) keeps its text; of
    rows that repeat a doc_id and its text one does.
    """
    names = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    rows = numbered(docs.select(*names))
    gone = repeated_spans(rows, least, words).groupBy(*DOC).agg(F.collect_set(F.struct("pos", "last")).alias("_gone"))  # a document's own runs
    gone = cut(gone.toDF("_id", "_hash", "_nth", "_gone"))
    joined = key_join(rows, gone, ["_id", "_hash", "_nth"], "left").select(*names, "_gone")
    kept = T.StructType([*docs.select(*names).schema.fields, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(lambda batches: _without(batches, names), kept)
