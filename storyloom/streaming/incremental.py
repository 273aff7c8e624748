"""The incremental path as Structured Streaming over a landing folder of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import ingest, scoring
from ..operators.ingest import content_hash, filter_lookback
from ..operators.lineage import cut
from ..schemas import DBL, RAW_ITEMS, RECORDS, STR, TS, shape
from ..sources.keyed import KeyedTable
from ..sources.tables import path_exists, read_version, write_version

EVERY = "30 minutes"
SEEN_KEY = ["source_id", "external_id"]
SEEN_BUCKETS = 64
BLOOM_BITS, BLOOM_HASHES = 1 << 22, 4
STORED_SCORES = shape((STR, "signal_id"), (DBL, "heat_score signal_score"), (TS, "primary_published_at"))


def landing_records(spark: SparkSession, landing: str, schema: StructType = RECORDS, files_per_batch: int | None = None) -> DataFrame:
    """Record files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(landing)


def start(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = EVERY, mode: str = "append") -> StreamingQuery:
    """Run ``handle`` per micro-batch; ``every`` None processes what is there and stops."""
    writer = df.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


# --- raw items ----------------------------------------------------------------------


def stream_raw_items(spark: SparkSession, landing: str, root: str, checkpoint: str, every: str | None = EVERY, schema: StructType = RECORDS, files_per_batch: int | None = None) -> StreamingQuery:
    """Land each micro-batch as a folded delta in its own folder.

    The work per batch follows the batch, not the stored table, and a replayed
    batch overwrites its own folder, so every record counts once.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        ingest.fold_batch(batch).write.mode("overwrite").parquet(f"{root}/raw_deltas/batch={batch_id}")

    return start(landing_records(spark, landing, schema, files_per_batch), fold, checkpoint, every)


def raw_items(spark: SparkSession, root: str) -> DataFrame:
    """Raw items as of all deltas: earliest payload, latest meta, number of refetches."""
    deltas = spark.read.parquet(f"{root}/raw_deltas")
    return (
        deltas.groupBy("source_id", "external_id")
        .agg(
            F.min_by("payload", "first_fetched_at").alias("payload"),
            F.max_by("response_meta", F.when(F.col("response_meta").isNotNull(), F.col("last_fetched_at"))).alias("response_meta"),
            F.min("first_fetched_at").alias("first_fetched_at"),
            F.max("last_fetched_at").alias("last_fetched_at"),
            (F.sum("fetches") - 1).alias("duplicate_fetch_count"),
        )
        .withColumn("content_hash", content_hash("payload"))
        .select(*[f.name for f in RAW_ITEMS.fields])
    )


# --- first seen, lookback -----------------------------------------------------------------


def stream_first_seen(records: DataFrame, late: str = "30 days") -> DataFrame:
    """First record of every (source, external id); ids are remembered for ``late``."""
    return records.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["source_id", "external_id"])


def _placed(ids: DataFrame) -> DataFrame:
    """``ids`` with the bucket of the seen store that holds them and their hash."""
    return ids.withColumn("_hash", F.xxhash64(*SEEN_KEY)).withColumn("bucket", F.pmod("_hash", F.lit(SEEN_BUCKETS)).cast("int"))


def _bits(placed: DataFrame) -> DataFrame:
    """(source_id, external_id, bucket, word, bit): the places of each id in its bucket's Bloom filter."""
    spots = F.array(*[F.pmod(F.xxhash64(F.lit(k), "_hash"), F.lit(BLOOM_BITS)) for k in range(BLOOM_HASHES)])
    spread = placed.select(*SEEN_KEY, "bucket", F.explode(spots).alias("spot"))
    return spread.select(*SEEN_KEY, "bucket", F.floor(F.col("spot") / 64).alias("word"), F.expr("shiftleft(CAST(1 AS BIGINT), CAST(spot % 64 AS INT))").alias("bit"))


def suspect_buckets(root: str, placed: DataFrame, batch_id: int) -> list[int]:
    """Buckets of the seen store that may hold an id of the batch, by the filters of earlier batches; at most SEEN_BUCKETS numbers."""
    spark, folder = placed.sparkSession, f"{root}/bloom"
    if not path_exists(spark, folder):
        return []
    asked = [r[0] for r in placed.select("bucket").distinct().collect()]
    stored = spark.read.schema("word BIGINT, bits BIGINT, batch BIGINT, bucket INT").parquet(folder)
    filters = stored.filter((F.col("batch") < batch_id) & F.col("bucket").isin(*asked)).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
    hit = _bits(placed).join(filters, ["bucket", "word"]).filter(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    whole = hit.groupBy(*SEEN_KEY, "bucket").agg(F.count("*").alias("n")).filter(F.col("n") == BLOOM_HASHES)
    return sorted(r[0] for r in whole.select("bucket").distinct().collect())


def seen_ids(root: str, spark: SparkSession, batch_id: int, buckets: list[int]) -> DataFrame:
    """Ids that earlier batches put into ``buckets``; only their files are read."""
    schema = "source_id STRING, external_id STRING, batch BIGINT, bucket INT"
    if not buckets:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/seen").filter((F.col("batch") < batch_id) & F.col("bucket").isin(*buckets))


def first_seen_exact(root: str, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler that passes on ids never seen in any batch, and remembers them for good.

    Ids lie in SEEN_BUCKETS buckets by hash, each with a Bloom filter; a batch asks
    the filters and reads only buckets that may hold one of its ids.  A replayed
    batch overwrites its own folders and is compared with earlier batches only.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        placed = _placed(cut(batch.dropDuplicates(SEEN_KEY)))
        buckets = suspect_buckets(root, placed, batch_id)
        known = seen_ids(root, batch.sparkSession, batch_id, buckets)
        fresh = cut(placed.join(known.select(*SEEN_KEY), SEEN_KEY, "left_anti"))
        write(fresh.drop("_hash", "bucket"), batch_id)
        bits = _bits(fresh).groupBy("bucket", "word").agg(F.bit_or("bit").alias("bits"))
        for name, rows in (("seen", fresh.select(*SEEN_KEY, "bucket")), ("bloom", bits)):
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{name}/batch={batch_id}")

    return handle


def stream_lookback(records: DataFrame, now, hours: float) -> DataFrame:
    """Row filter, not a watermark: undated records must pass."""
    return filter_lookback(records, now, hours)


# --- running state ---------------------------------------------------------------------


def stream_source_state(records: DataFrame) -> DataFrame:
    """Per source: newest publication, last fetch, record count (update mode)."""
    return records.groupBy("source_id").agg(
        F.max("published_at").alias("last_seen_published_at"),
        F.max("fetched_at").alias("last_successful_fetch_at"),
        F.count("*").alias("records"),
    )


def health_handler(root: str, start_rows: DataFrame) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler that rolls source health forward; a replayed batch is skipped."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        from ..sources.tables import current_version

        spark = batch.sparkSession
        done = current_version(spark, root, "health")
        if done is not None and int(done.rsplit("=", 1)[1]) >= batch_id:
            return
        health = read_version(spark, root, "health") if done is not None else start_rows
        write_version(ingest.update_health(health, batch), root, "health", str(batch_id))

    return handle


def stream_date_summary(signals: DataFrame) -> DataFrame:
    """Visible signals per UTC day (update mode).

    Publication dates lie any time back, so there is no watermark: the state is
    one row a day.
    """
    shown = signals.filter(~F.coalesce(F.col("status"), F.lit("")).isin("hidden", "deleted"))
    return (
        shown.groupBy(F.window("primary_published_at", "1 day"))
        .agg(F.count("*").alias("signal_count"))
        .select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), "signal_count")
    )


# --- re-scoring ---------------------------------------------------------------------------


def touched_signals(changes: DataFrame, signals: DataFrame, links: DataFrame, articles: DataFrame, stored: DataFrame) -> DataFrame:
    """Signals whose scores (kind, id) ``changes`` may move; kinds are article, source and signal.

    Those with a changed article or an article of a changed source, the changed
    signals, and, as topic velocity counts neighbours, the signals dated within
    72 h of a changed signal's date, now or when it was last scored.
    """
    of = lambda kind: changes.filter(F.col("kind") == kind).select("id").distinct()
    own = articles.join(of("source").withColumnRenamed("id", "source_id"), "source_id", "left_semi").select("article_id")
    moved = own.unionByName(of("article").withColumnRenamed("id", "article_id"))
    by_article = links.join(moved, "article_id", "left_semi").select("signal_id")
    direct = of("signal").withColumnRenamed("id", "signal_id")
    dates = lambda rows: rows.join(direct, "signal_id", "left_semi").select(F.col("primary_published_at").cast("timestamp").alias("at"))
    days = around(dates(signals).unionByName(dates(stored)))
    near = signals.join(days, F.to_date("primary_published_at") == F.col("day"), "left_semi").select("signal_id")
    return by_article.unionByName(direct).unionByName(near).distinct()


def around(dates: DataFrame) -> DataFrame:
    """Days within 72 h of any of the dates (column ``at``)."""
    day = F.to_date("at")
    return dates.filter("at IS NOT NULL").select(F.explode(F.sequence(F.date_sub(day, 4), F.date_add(day, 4))).alias("day")).distinct()


def refresh_scores(touched: DataFrame, signals, links, articles, sources, relations, signal_topics, now) -> DataFrame:
    """Scores (signal_id, heat_score, signal_score, primary_published_at) of the ``touched`` signals.

    Members, relations and topics are narrowed to those signals first; velocity
    looks at the signals of the days around them.
    """
    mine = cut(signals.join(touched, "signal_id", "left_semi"))
    own = cut(links.join(touched, "signal_id", "left_semi"))
    members = own.select("article_id").distinct()
    days = around(mine.select(F.col("primary_published_at").cast("timestamp").alias("at")))
    neighbours = signals.join(days, F.to_date("primary_published_at") == F.col("day"), "left_semi")
    about = relations.join(members, "article_id", "left_semi").unionByName(relations.filter("article_id IS NULL").join(touched, "signal_id", "left_semi"))
    topics = signal_topics.join(touched, "signal_id", "left_semi")
    velocity = scoring.topic_velocity(neighbours, signal_topics.join(neighbours.select("signal_id"), "signal_id", "left_semi"))
    context = scoring.score_context(mine, own, articles.join(members, "article_id", "left_semi"), sources, about, topics, now, velocity)
    scores = scoring.score_signals(scoring.score_components(context))
    return scores.join(mine.select("signal_id", "primary_published_at"), "signal_id")


def refresh_handler(read: Callable[[str], DataFrame], now, store: KeyedTable) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler of (kind, id) changes that re-scores what they touch and merges it into the stored scores.

    ``read`` gives a table's current state by name, so every batch sees the tables
    as they are then.  Scores of signals that are gone are removed.  A replayed
    batch makes the same rows again.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        signals, links, articles = read("signals"), read("links"), read("articles")
        touched = cut(touched_signals(cut(batch.select("kind", "id").distinct()), signals, links, articles, store.read()))
        gone = touched.join(signals.select("signal_id"), "signal_id", "left_anti")
        store.delete(gone)
        store.upsert(cut(refresh_scores(touched, signals, links, articles, read("sources"), read("relations"), read("signal_topics"), now)))

    return handle
