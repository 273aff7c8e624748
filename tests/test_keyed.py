"""Keyed tables: what an upsert writes, reads and shuffles."""

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.sources.keyed import KeyedTable

SCHEMA = T.StructType([T.StructField("source", T.StringType()), T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("n", T.LongType())])


@pytest.fixture
def table(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex}"
    yield KeyedTable(spark, name, str(tmp_path / "t"), SCHEMA, ["source", "id"], parts=50, buckets=4)
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def rows_of(spark, low, high, title, n):
    return spark.range(low, high).select(F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source"), "id", F.lit(title).alias("title"), F.lit(n).cast("long").alias("n"))


def test_upsert_and_delete(spark, table):
    assert table.read().count() == 0 and table.upsert(rows_of(spark, 0, 0, "x", 1)) == []
    table.upsert(rows_of(spark, 0, 2_000, "old", 1))
    table.upsert(rows_of(spark, 1_900, 2_100, "new", 2), ["title"])
    got = {r.id: (r.title, r.n) for r in table.read().collect()}
    assert len(got) == 2_100 and got[0] == ("old", 1) and got[1_950] == ("new", 1) and got[2_050] == ("new", 2)
    table.delete(rows_of(spark, 0, 2_099, "", 0))
    assert [tuple(r) for r in table.read().collect()] == [("s6", 2_099, "new", 2)]
    with pytest.raises(ValueError, match="without"):
        table.upsert(spark.createDataFrame([(None, 1, "a", 1)], SCHEMA))


def test_upsert_rewrites_only_the_parts_it_touches(spark, table, tmp_path):
    table.upsert(rows_of(spark, 0, 2_000, "old", 1))
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("part-*.parquet")}
    before = files()
    changes = rows_of(spark, 10, 20, "new", 2)  # ten of two thousand keys
    parts = table.upsert(changes)
    after = files()
    kept = {f for f in before if after.get(f) == before[f]}
    assert 0 < len(parts) <= 10
    assert {f for f in before if not any(f"/part={p}/" in f for p in parts)} == kept
    assert table.read().filter("title = 'new'").count() == 10


def test_the_stored_side_is_not_shuffled(spark, table):
    table.upsert(rows_of(spark, 0, 2_000, "old", 1))
    changes = rows_of(spark, 10, 20, "new", 2)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = table.touched(changes)
        plan = table.merged(changes, ["title", "n"], parts)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    stored, new = plan.split("Exchange", 1)
    assert "FileScan parquet" in stored and "PartitionFilters" in stored and "Bucketed: true" in stored
    assert "FileScan" not in new  # the one exchange is that of the changes


def test_another_session_finds_the_rows(spark, table, tmp_path):
    table.upsert(rows_of(spark, 0, 100, "old", 1))
    again = KeyedTable(spark, f"{table.name}_again", str(tmp_path / "t"), SCHEMA, ["source", "id"], parts=50, buckets=4)
    assert again.read().count() == 100
    spark.sql(f"DROP TABLE {again.name}")
