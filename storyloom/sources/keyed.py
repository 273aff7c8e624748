"""Keyed tables: partitioned, bucketed Spark tables whose upserts touch only the parts they change.

A row lies in the part that its key hashes to and, inside it, in the bucket Spark
itself assigns.  An upsert reads and overwrites the parts of its changes (dynamic
partition overwrite); the stored side is bucketed by the key, so it takes part in
the join where it lies and only the changes are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import path_exists

PARTS = 64
BUCKETS = 8
PART = "part"


class KeyedTable:
    """A table of ``schema`` with unique, non-null ``keys``, stored under ``path`` and known to the session as ``name``.

    An upsert is idempotent: a run that is lost half way leaves every part old or
    new, and the same upsert made again completes it.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, schema: T.StructType, keys: Sequence[str], parts: int = PARTS, buckets: int = BUCKETS, part_by: Sequence[str] | None = None):
        self.spark, self.name, self.path, self.schema, self.keys = spark, name, path, schema, list(keys)
        self.part_by = list(part_by or keys)  # the keys that choose a row's part
        self.parts, self.buckets = parts, buckets
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        known = spark.catalog.tableExists(name)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}, {PART} INT) USING parquet PARTITIONED BY ({PART}) "
            f"CLUSTERED BY ({', '.join(f'`{k}`' for k in self.keys)}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        if not known and path_exists(spark, path):  # written by an earlier session
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.part_by), F.lit(self.parts)).cast("int")

    def read(self) -> DataFrame:
        return self.spark.table(self.name).drop(PART)

    def touched(self, changes: DataFrame) -> list[int]:
        """Parts that hold the keys of ``changes``: at most ``parts`` numbers."""
        return sorted(r[0] for r in changes.select(self.part()).distinct().collect())

    def merged(self, changes: DataFrame, update: Sequence[str], parts: Sequence[int]) -> DataFrame:
        """The rows of ``parts`` after the upsert: new keys inserted, ``update`` columns of known keys replaced."""
        base = self.spark.table(self.name).filter(F.col(PART).isin(*parts)).withColumn("_old", F.lit(True)).alias("b")
        new = changes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields], F.lit(True).alias("_new"), self.part().alias(PART)).alias("c")
        on = F.lit(True)
        for k in self.keys:
            on = on & (F.col(f"b.{k}") == F.col(f"c.{k}"))
        joined = base.join(new, on, "full")
        fresh = F.col("b._old").isNull()
        columns = []
        for f in self.schema.fields:
            take = fresh | F.col("c._new").isNotNull() if f.name in update else fresh
            columns.append(F.when(take, F.col(f"c.{f.name}")).otherwise(F.col(f"b.{f.name}")).alias(f.name))
        return joined.select(*columns, F.coalesce(f"b.{PART}", f"c.{PART}").alias(PART))

    def upsert(self, changes: DataFrame, update: Sequence[str] | None = None) -> list[int]:
        """Insert new keys, replace the ``update`` columns (default: all but the keys) of known ones; the parts written.

        ``changes`` has the table's columns and unique keys; rows without a key are
        an error of the caller and are refused.
        """
        update = [f.name for f in self.schema.fields if f.name not in self.keys] if update is None else update
        blank = F.lit(False)
        for k in self.keys:
            blank = blank | F.col(k).isNull()
        if not changes.filter(blank).isEmpty():
            raise ValueError(f"changes of {self.name} have rows without {', '.join(self.keys)}")
        parts = self.touched(changes)
        if parts:
            self._put(self.merged(changes, update, parts))
        return parts

    def delete(self, doomed: DataFrame) -> list[int]:
        """Remove the rows with the keys of ``doomed``; the parts written."""
        keys = doomed.select(*self.keys).distinct()
        parts = self.touched(keys)
        if parts:
            left = self.spark.table(self.name).filter(F.col(PART).isin(*parts)).join(keys, self.keys, "left_anti")
            self._put_all(left.select(*[f.name for f in self.schema.fields], PART), parts)
        return parts

    def replace(self, rows: DataFrame, groups: DataFrame) -> list[int]:
        """Put ``rows`` in place of all rows of the ``groups`` (values of the ``part_by`` keys); the parts written."""
        groups = groups.select(*self.part_by).distinct()
        parts = sorted({*self.touched(groups), *self.touched(rows)})
        if parts:
            left = self.spark.table(self.name).filter(F.col(PART).isin(*parts)).join(groups, self.part_by, "left_anti")
            names = [f.name for f in self.schema.fields]
            fresh = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields], self.part().alias(PART))
            self._put_all(left.select(*names, PART).unionByName(fresh), parts)
        return parts

    def _put_all(self, rows: DataFrame, parts: Sequence[int]) -> None:
        """Overwrite ``parts``; those that nothing is left for are dropped."""
        emptied = set(parts) - {r[0] for r in rows.select(PART).distinct().collect()}
        self._put(rows)
        for part in sorted(emptied):
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({PART} = {part})")

    def _put(self, rows: DataFrame) -> None:
        conf, name = self.spark.conf, "spark.sql.sources.partitionOverwriteMode"
        before = conf.get(name, None)
        conf.set(name, "dynamic")
        try:
            rows.write.insertInto(self.name, overwrite=True)
        finally:
            conf.set(name, before) if before is not None else conf.unset(name)
