"""Queries that run streaming jobs over the given events to completion
(availableNow) and read what they wrote. Jobs with state across batches meet
the events as they would arrive: period by period, the job started anew for
each, on its own checkpoint."""

from collections.abc import Iterator

from pyspark.sql import functions as F

from webrec.plans.inputs import CRAWL, table, with_views
from webrec.plans.registry import query
from webrec.session import scratch
from webrec.streaming import jobs as J

CR = with_views("crawl")


def _sightings(spark, sf_dir):
    """The crawl log as a stream."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    # a pattern matches a single file as well as a folder of parts
    found = path[:-1] + "[t]"
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 16).parquet(found)
    return spark.sql(CRAWL, events=events).withColumn("ts", F.col("ts").cast("timestamp"))


PERIODS = 6


def _arrivals(spark, sf_dir, periods: int = PERIODS) -> Iterator:
    """The events as a stream over a landing folder, once after each period of
    equal length is added to it; rows without a time come with the first."""
    events, landing = table(spark, sf_dir, "events"), scratch(spark, "landing")
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = events.agg(F.min(ts), F.max(ts)).first()
    if lo is None:
        lo = hi = 0
    period = F.least(F.floor((ts - lo) * periods / max(hi - lo, 1)), F.lit(periods - 1))
    for k in range(periods):
        events.where(F.coalesce(period, F.lit(0)) == k).write.mode("append").parquet(landing)
        yield spark.readStream.schema(events.schema).parquet(landing)


@query("stream_new_urls", f"{CR} SELECT url, arg_min(event_id, (ts, event_id)) AS event_id FROM crawl GROUP BY url")
def stream_new_urls(spark, sf_dir):
    store, checkpoint = scratch(spark, "new-urls"), scratch(spark, "cp")
    for events in _arrivals(spark, sf_dir):
        crawl = spark.sql(CRAWL, events=events).withColumn("ts", F.col("ts").cast("timestamp"))
        J.stream_new_urls(crawl.select("event_id", "ts", "url"), store, checkpoint).awaitTermination()
    return spark.read.parquet(store).select("url", "event_id")


@query("stream_new_urls_recent", f"{CR} SELECT DISTINCT url FROM crawl")
def stream_new_urls_recent(spark, sf_dir):
    out = scratch(spark, "recent-urls")
    J.stream_new_urls_recent(_sightings(spark, sf_dir).select("event_id", "ts", "url"), "400 days", out, scratch(spark, "cp")).awaitTermination()
    return spark.read.parquet(out).select("url")


@query(
    "stream_run_metrics",
    f"""{CR}, m AS (SELECT date_trunc('minute', ts) AS window_start, source FROM crawl)
        SELECT CAST(window_start AS TIMESTAMP) AS window_start, source, CAST(count(*) AS BIGINT) AS urls FROM m
        WHERE window_start + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM crawl) - INTERVAL 10 MINUTE GROUP BY window_start, source""",
)
def stream_run_metrics(spark, sf_dir):
    out = scratch(spark, "metrics")
    J.stream_run_metrics(_sightings(spark, sf_dir), out, scratch(spark, "cp")).awaitTermination()
    return spark.read.parquet(out).select("window_start", "source", "urls")


query(
    "ttl_cache_lookup",
    """WITH c AS (SELECT user_id AS url, event_id, ts AS cached_at, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + INTERVAL 6 HOUR END AS expires_at FROM events),
       l AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY cached_at DESC) AS rn FROM c) SELECT url, event_id FROM l WHERE rn = 1 AND (expires_at IS NULL OR expires_at >= TIMESTAMP '2024-01-30 12:00:00')""",
)(
    lambda spark, sf_dir: J.ttl_cache_lookup(
        table(spark, sf_dir, "events").select(
            F.col("user_id").alias("url"), "event_id", F.col("ts").cast("timestamp").alias("cached_at"),
            F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) + INTERVAL '6' HOUR END").alias("expires_at")),
        "2024-01-30 12:00:00").select("url", "event_id")
)


@query(
    "ttl_cache_stream",
    """WITH c AS (SELECT user_id AS url, event_id, ts AS cached_at, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + INTERVAL 6 HOUR END AS expires_at FROM events),
       l AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY cached_at DESC, event_id DESC) AS rn FROM c)
       SELECT url, event_id FROM l WHERE rn = 1 AND (expires_at IS NULL OR epoch_ms(expires_at) >= (SELECT epoch_ms(max(ts)) - 3600000 FROM events))""",
)
def ttl_cache_stream(spark, sf_dir):
    log, checkpoint = scratch(spark, "cache-log"), scratch(spark, "cp")
    for events in _arrivals(spark, sf_dir):
        at = F.col("ts").cast("timestamp")
        entries = events.select(
            F.col("user_id").alias("url"), "event_id", at.alias("cached_at"),
            F.when(F.col("event_id") % 5 == 0, None).otherwise(at + F.expr("INTERVAL '6' HOUR")).alias("expires_at"),
        )
        J.ttl_cache_stream(entries, log, checkpoint, "1 hour").awaitTermination()
    return J.ttl_cache_state(spark.read.parquet(log)).select("url", F.col("row_id").alias("event_id"))
