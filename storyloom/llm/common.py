"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators.lineage import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rows up to which a written table may be broadcast; its rows are counted first.
BROADCAST_ROWS = 200_000
BROADCAST_CELLS = 4_000_000

__all__ = ["BROADCAST_ROWS", "ascii_lower", "cut", "key_join", "load", "small", "text_of"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """Whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else; all-ASCII texts take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def key_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which null keys meet null keys; keeps the left side's keys and drops the right side's."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_right_{k}" for k in keys])


def small(df: DataFrame, rows: int = BROADCAST_ROWS, cells: Column | None = None) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if it is counted to be small, else as it is.

    Small means at most ``rows`` rows and, where rows hold lists, at most
    BROADCAST_CELLS in the sum of ``cells``, the numbers that a row holds.
    """
    if df.limit(rows + 1).count() > rows:
        return df
    if cells is not None and (df.agg(F.sum(cells)).first()[0] or 0) > BROADCAST_CELLS:
        return df
    return F.broadcast(df)
