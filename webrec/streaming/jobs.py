"""Structured Streaming forms of the long-running steps, and the TTL cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webrec.operators.dedup import first_per_key


BUCKETS = 64
#: Expiry of an entry that has none.
NEVER = 2**63 - 1


def _store(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored rows, or None before the first batch. Only a missing folder
    means that; any other fault is raised."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def stream_new_urls(sightings: DataFrame, store: str, checkpoint: str, url: str = "url", ts: str = "ts", row_id: str = "event_id") -> StreamingQuery:
    """Insert-if-absent by URL, for all time. Each micro-batch keeps its first
    sighting per URL and drops URLs stored by other batches. The store is
    partitioned by a hash of the URL, and a batch reads the buckets that its
    URLs fall in, URL column only; it owns one folder, so a replay after a
    failure overwrites itself."""
    columns = list(sightings.columns)
    bucket = F.pmod(F.xxhash64(url), F.lit(BUCKETS)).cast("int")

    def write(batch: DataFrame, n: int) -> None:
        fresh = first_per_key(batch, url, [F.asc(ts), F.asc(row_id)]).withColumn("url_bucket", bucket)
        known = _store(batch.sparkSession, store)
        if known is not None:
            touched = [r[0] for r in fresh.select("url_bucket").distinct().collect()]  # BUCKETS at most
            known = known.where((F.col("batch") != n) & F.col("url_bucket").isin(touched)).select(url)
            fresh = fresh.join(known, url, "left_anti")
        fresh.select(*columns, "url_bucket").write.mode("overwrite").partitionBy("url_bucket").parquet(f"{store.rstrip('/')}/batch={n}")

    return sightings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_new_urls_recent(sightings: DataFrame, delay: str, out: str, checkpoint: str, url: str = "url", ts: str = "ts") -> StreamingQuery:
    """Same within a watermark: state is bounded by the delay."""
    once = sightings.withWatermark(ts, delay).dropDuplicatesWithinWatermark([url])
    return once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def run_metrics(sightings: DataFrame, width: str = "1 minute", ts: str = "ts") -> DataFrame:
    """URLs per time window and source (batch and streaming alike)."""
    g = sightings.groupBy(F.window(ts, width).alias("w"), "source").agg(F.count("*").alias("urls"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "source", "urls")


def stream_run_metrics(sightings: DataFrame, out: str, checkpoint: str, width: str = "1 minute", delay: str = "10 minutes", ts: str = "ts") -> StreamingQuery:
    """Closed windows only, appended once."""
    m = run_metrics(sightings.withWatermark(ts, delay), width, ts)
    return m.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def ttl_cache_lookup(cache: DataFrame, as_of: str, url: str = "url") -> DataFrame:
    """Latest entry per URL, if it never expires or not before ``as_of``."""
    rest = [c for c in cache.columns if c != url]
    latest = cache.groupBy(url).agg(F.max_by(F.struct(*rest), "cached_at").alias("r")).select(url, "r.*")
    return latest.where(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(as_of).cast("timestamp")))


def ttl_cache_stream(entries: DataFrame, log: str, checkpoint: str, delay: str = "10 minutes", url: str = "url", row_id: str = "event_id") -> StreamingQuery:
    """The cache with expiry over a stream of ``url, row_id, cached_at,
    expires_at``. The state holds the newest entry of each URL until event time
    (the newest ``cached_at`` less ``delay``) passes its expiry; an entry without
    an expiry stays. Each change is one row of the table ``log``: an entry that
    came (``alive``) or went. Entries later than ``delay`` are dropped. So the
    state grows with the live URLs, not with the entries; read the table with
    ``ttl_cache_state``.

    A micro-batch is one aggregate of its entries and the state before it, to
    which a task sends at most one row a URL. The state lies with the checkpoint,
    one folder a batch, of which the last two are kept. A batch only reads the
    one before it and owns its folders, so a replay overwrites itself."""
    state = f"{checkpoint.rstrip('/')}/cache"
    slim = entries.select(
        F.col(url).alias("url"), F.unix_micros("cached_at").alias("cached_us"), F.col(row_id).cast("long").alias("row_id"),
        F.coalesce(F.unix_millis("expires_at"), F.lit(NEVER)).alias("expires_ms"),
    )
    clock = F.unix_millis(F.timestamp_micros(F.max("cached_us")) - F.lit(delay).cast("interval"))

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before, own = f"{state}/batch={n - 1}", f"{state}/batch={n}"
        rows, now = batch.withColumn("held", F.lit(False)), None
        if n:
            now = spark.read.parquet(f"{before}/clock").first()[0]
            held = spark.read.parquet(f"{before}/entries").withColumn("held", F.lit(True))
            if now is not None:
                held = held.where(F.col("expires_ms") >= now)
                rows = rows.where(F.col("cached_us").isNull() | (F.col("cached_us") > now * 1000))
            rows = rows.unionByName(held)
        # of equal entries the one held stays
        newest = rows.groupBy("url").agg(F.max(F.struct("cached_us", "row_id", "held", "expires_ms")).alias("r")).select("url", "r.*")
        newest.write.mode("overwrite").parquet(f"{own}/entries")
        newest = spark.read.parquet(f"{own}/entries")
        now = max((t for t in (now, newest.agg(clock).first()[0]) if t is not None), default=None)
        over = F.col("expires_ms") < F.lit(now).cast("long")
        changes = F.array_compact(F.array(F.when(~F.col("held"), F.lit(True)), F.when(over, F.lit(False))))
        newest.select("url", "cached_us", "row_id", "expires_ms", F.explode(changes).alias("alive")).write.mode("overwrite").parquet(f"{log.rstrip('/')}/batch={n}")
        spark.range(1).select(F.lit(now).cast("long").alias("now")).write.mode("overwrite").parquet(f"{own}/clock")
        _remove(spark, f"{state}/batch={n - 2}")

    return slim.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ttl_cache_state(log: DataFrame) -> DataFrame:
    """Entries alive after the last change: ``url, row_id, cached_at,
    expires_at``. Of one entry's changes its going is the last."""
    last = F.max_by(F.struct("row_id", "cached_us", "expires_ms", "alive"), F.struct("cached_us", "row_id", ~F.col("alive")))
    rows = log.groupBy("url").agg(last.alias("r")).select("url", "r.*").where("alive")
    return rows.select(
        "url", "row_id", F.timestamp_micros("cached_us").alias("cached_at"),
        F.when(F.col("expires_ms") < NEVER, F.timestamp_millis("expires_ms")).alias("expires_at"),
    )
