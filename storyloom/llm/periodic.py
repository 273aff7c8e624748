"""Periodic runs of words by an online, sparse dynamic program over diagonals.

A diagonal is a lag: word i against word i - lag.  A run of smallest period q and
at least 4 q words matches on diagonal q for 3 q words or more, so for a scale
2^s with 2^(s-1) < q <= 2^s all of the run's later words end a repeat of 2^s
words, and the nearest earlier end of the same 2^s words lies q back: a nearer
one would give the run a smaller period.  Each word therefore has at most one
live diagonal a scale.  Words are taken in order; a live lag that goes on has its
match length raised by one, one that doesn't has ended and is a run if it is long
enough.  Words whose 2^s words occur once take no part in larger scales, so an
ordinary text is left after two or three of them, and a text of n words costs
n log n at the most, however often words repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST_WORDS = 6
TIMES = 4  # periods that a run must hold at least
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def live_lags(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, lag, scale), by word: the nearest earlier end of the same ``scale`` words, where its lag is of that scale."""
    n, seen = len(words), {}
    names = np.array([seen.setdefault(w, i) for i, w in enumerate(words)], dtype=np.int64)
    at, scale, found = np.arange(n), 1, []
    while len(at) > 1 and TIMES * (scale // 2 + 1) <= n:
        order = np.argsort(names, kind="stable")
        at, names = at[order], names[order]
        again = names[1:] == names[:-1]
        lag = at[1:] - at[:-1]
        hit = again & (lag > scale // 2) & (lag <= scale)
        if hit.any():
            found.append((at[1:][hit], lag[hit], np.full(int(hit.sum()), scale)))
        # What occurs once ends here; the others are named anew by their two halves.
        kept = np.append(again, False) | np.append(False, again)
        number = np.full(n, -1, dtype=np.int64)
        number[at[kept]] = np.cumsum(np.append(True, ~again))[kept]
        at = np.sort(at[kept])
        at = at[at >= scale]
        at = at[number[at - scale] >= 0]
        names = number[at - scale] * (n + 1) + number[at]
        scale *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    word, lag, scales = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((lag, word))
    return word[order], lag[order], scales[order]


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    if len(words) < LEAST_WORDS:
        return []
    out: list[tuple[int, int, int]] = []

    def end(last: int, ended: dict[int, int]) -> None:
        for lag, matched in ended.items():
            if matched + lag >= max(LEAST_WORDS, TIMES * lag):
                out.append((last - matched - lag + 1, matched + lag, lag))

    active: dict[int, int] = {}  # match length of each live lag
    before: dict[int, int] = {}  # the same at the word before
    last = -2
    for word, lag, scale in zip(*(x.tolist() for x in live_lags(words)), strict=True):
        if word != last:
            end(last - 1, before)  # what the last word didn't go on with
            before, active = active, {}
            if word != last + 1:
                end(last, before)
                before = {}
            last = word
        active[lag] = before.pop(lag, scale - 1) + 1
    end(last - 1, before)
    end(last, active)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that are in no run or among the first ``period`` words of each that holds them, joined by one space."""
    if not runs:
        return b" ".join(words)
    out, done = [], 0
    for start, stop in sorted((s + q, s + length) for s, length, q in runs):
        if start > done:
            out += words[done:start]
        done = max(done, stop)
    return b" ".join(out + words[done:])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, ends, flat, texts = [], [0], [], []
        for text in batch.column(1).cast(pa.binary()):
            words = (text.as_py() or b"").split()  # at space and \t to \r
            runs = runs_of(words)
            n_words.append(len(words))
            flat += runs
            ends.append(len(flat))
            texts.append(collapse(words, runs))
        fields = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(RUN)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed), one row per input row.

    ``runs`` holds (start, length, period) of every stretch of words with that
    smallest period and at least LEAST_WORDS words and TIMES periods that can't be
    extended, by start, then period; ``collapsed`` is the text without the words
    that stand in a run after its first period, joined by one space.  Null and
    blank texts have no words; null ids are kept and rows that repeat are judged
    each by itself; extra columns are ignored.
    """
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(_found, SCHEMA)
