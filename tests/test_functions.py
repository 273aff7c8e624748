from datetime import datetime

from pyspark.sql import functions as F

from storyloom.functions import numbers, text, times, urls
from storyloom.plans.batch import RunOptions


def one(spark, column, value="x", kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first().r


def test_text(spark):
    v = F.col("v")
    assert one(spark, text.clean_text(v), " a \n　b  ") == "a b"
    assert one(spark, text.clean_text(v), " \t ") is None
    assert one(spark, text.clean_summary(v), "<p>Hi</p>  <b>you</b>") == "Hi you"
    assert one(spark, text.title_tokens(v), "The New GPT-5: 人工智能 for x") == ["gpt", "5", "人工智能", "x"]
    assert one(spark, text.clip(v, 10), "a" * 12) == "a" * 7 + "..."
    assert one(spark, text.excerpt(v, 10), "a" * 12) == "a" * 9 + "..."
    assert one(spark, text.with_terminal(v), "完") == "完。"
    assert one(spark, text.strip_terminal(v), "完！？") == "完"
    assert one(spark, text.slugify(v, F.lit("7")), "Hello,  World 你好!") == "hello-world-你好-7"
    assert one(spark, text.cjk_count(v), "a你b好") == 2
    assert one(spark, text.word_count(v), " a  b ") == 2


def test_clip_visible(spark):
    v = F.col("v")
    assert one(spark, text.clip_visible(v, 10), "一二三四五六七。八九十") == "一二三四五六七。"
    assert one(spark, text.clip_visible(v, 10), "一。三四五六七八九十甲") == "一。三四五六七八九。"
    assert one(spark, text.clip_visible(v, 10), "短句") == "短句"


def test_urls(spark):
    v = F.col("v")
    assert one(spark, urls.normalize_url(v), "HTTPS://X.com/A/b/?q=1#f") == "https://x.com/A/b"
    assert one(spark, urls.normalize_url(v), "https://x.com") == "https://x.com"
    assert one(spark, urls.normalize_url(v), " not a url/ ") == "not a url"
    assert one(spark, urls.has_specific_path(v), "https://x.com/a") is True
    assert one(spark, urls.has_specific_path(v), "https://x.com") is False
    assert one(spark, urls.strip_tracking(v), "https://x.com/a?utm_source=s&b=2#c") == "https://x.com/a?b=2"


def test_times(spark):
    v = F.col("v")
    for given in ("2026-04-20T10:00:00Z", "Mon, 20 Apr 2026 10:00:00 GMT", "Mon, 20 Apr 2026 18:00:00 +0800", "20 Apr 2026 06:00:00 EDT"):
        assert one(spark, times.to_ts(v), given) == datetime(2026, 4, 20, 10), given
    assert one(spark, times.to_ts(v), "2024") == datetime(2024, 1, 1)
    assert one(spark, times.to_ts(v), "soon") is None
    label, first, last = times.date_range("week", None, None, datetime(2024, 1, 31, 5))
    assert (label, first, last) == ("week", datetime(2024, 1, 25), datetime(2024, 1, 31, 23, 59, 59, 999000))


def test_rounding_goes_up_at_half(spark):
    assert one(spark, numbers.round3(F.col("v")), 0.0625, "double") == 0.063
    assert one(spark, numbers.round3(F.col("v")), -0.0625, "double") == -0.062


def test_run_options():
    assert RunOptions.normalize(mode="startup").lookback_hours == 24.0
    assert RunOptions.normalize(mode="scheduled").incremental is True
    assert RunOptions.normalize(mode="scheduled", recovery=True).incremental is False
    assert RunOptions.normalize(mode="odd", lookback_hours="-1", enrichment_limit="2.5") == RunOptions()
