"""Two runs over the same tables: the second adds nothing for known records and keeps signal ids."""

from pyspark.sql import functions as F

from catalog.flows import CLOCK, _inputs
from catalog.registry import Tables
from storyloom.plans import batch

SF = "/root/testdata/sf0.001"


def test_second_run_keeps_what_it_knows(spark, tmp_path):
    t = Tables(spark, SF)
    root = str(tmp_path)
    inputs = _inputs(t)
    first = batch.run_batch(spark, root, inputs, batch.RunOptions.normalize(), CLOCK, "r1")
    before = {r.signal_id: r.heat_score for r in first["signals"].collect()}
    articles = first["articles"].count()
    links = sorted(map(tuple, first["signal_articles"].collect()))
    assert before and articles
    second = batch.run_batch(spark, root, inputs, batch.RunOptions.normalize(), CLOCK, "r2")
    assert second["articles"].count() == articles
    assert second["raw_items"].agg(F.min("duplicate_fetch_count")).first()[0] == 1
    assert {r.signal_id: r.heat_score for r in second["signals"].collect()} == before
    assert sorted(map(tuple, second["signal_articles"].collect())) == links
    assert second["relations"].count() == first["relations"].count()


def test_a_scheduled_run_skips_what_is_not_due_and_remembers_failures(spark, tmp_path):
    from datetime import timedelta

    t = Tables(spark, SF)
    inputs = _inputs(t)
    failing = t.sources.filter("enabled AND source_type = 'rss'").select("source_id", F.lit("down").alias("reason")).limit(1)
    inputs.failed_sources = failing
    first = batch.run_batch(spark, str(tmp_path), inputs, batch.RunOptions.normalize(), CLOCK, "r1")
    bad = failing.first().source_id
    health = {r.source_id: r for r in first["health"].collect()}
    assert (health[bad].failure_count, health[bad].last_error_category) == (1, "transient_failure")
    fetched = [r.source_id for r in first["run_outcomes"].filter("status = 'succeeded'").collect()]
    assert all(health[s].failure_count == 0 and health[s].last_successful_at is not None for s in fetched)
    assert {r.source_id for r in first["cursors"].filter("last_successful_fetch_at is not null").collect()} == set(fetched)
    inputs.failed_sources = None
    later = CLOCK + timedelta(minutes=10)
    second = batch.run_batch(spark, str(tmp_path), inputs, batch.RunOptions.normalize(mode="scheduled"), later, "r2")
    skipped = {r.source_id: r.reason for r in second["run_outcomes"].filter("status = 'skipped'").collect()}
    assert all(s in skipped for s in fetched)


def test_versions_survive_a_crash_before_the_marker(spark, tmp_path):
    import pytest

    from storyloom.sources import tables

    root = str(tmp_path)
    tables.write_version(spark.range(3), root, "t", "a")
    spark.range(9).write.parquet(f"{root}/t/v=b")  # data without a marker: the writer died in between
    assert tables.read_version(spark, root, "t").count() == 3
    with pytest.raises(FileExistsError):
        tables.write_version(spark.range(5), root, "t", "a")
    tables.write_version(spark.range(7), root, "t", "b")
    assert tables.read_version(spark, root, "t").count() == 7
