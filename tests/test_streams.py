"""Streams over several micro-batches, restarts and a replay."""

import os
import shutil
import time

import duckdb
from pyspark.sql import functions as F

from tests.harness import compare
from webrec.plans import all_oracles, all_queries
from webrec.streaming import jobs as J

SEEN = "event_id long, ts timestamp, url string"
ENTRY = "url string, event_id long, cached_at timestamp, expires_at timestamp"


def _land(spark, rows, schema, folder):
    typed = spark.createDataFrame(rows, ", ".join(f"{c.split()[0]} {'long' if c.endswith('long') else 'string'}" for c in schema.split(", ")))
    typed.selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in schema.split(", ")]).coalesce(1).write.mode("append").parquet(folder)


def test_new_urls_over_batches_and_a_replay(spark, tmp_path):
    landing, store, cp = (str(tmp_path / n) for n in ("in", "store", "cp"))
    batches = [
        [(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:01:00", "b"), (3, "2024-01-01 00:02:00", "a")],
        [(4, "2024-01-02 00:00:00", "b"), (5, "2024-01-02 00:00:00", "c")],
        [(6, "2024-01-03 00:00:00", "a"), (7, "2024-01-03 00:00:00", None)],
        [(8, "2024-01-04 00:00:00", "c"), (9, "2024-01-04 00:00:00", "d"), (10, "2024-01-04 00:00:00", "d")],
        [(11, "2024-01-05 00:00:00", "a"), (12, "2024-01-05 00:00:00", "b")],
    ]
    want = []
    seen = set()
    for n, rows in enumerate(batches):
        _land(spark, rows, SEEN, landing)
        J.stream_new_urls(spark.readStream.schema(SEEN).parquet(landing), store, cp).awaitTermination()
        for event, _, url in rows:
            if url not in seen:
                seen.add(url)
                want.append((event, url))
        assert sorted((r.event_id, r.url) for r in spark.read.parquet(store).collect()) == want
    before = want
    # the last batch was written, but its commit was lost
    commits = sorted((int(f) for f in os.listdir(f"{cp}/commits") if f.isdigit()))
    assert len(commits) == 5
    for f in (f"{commits[-1]}", f".{commits[-1]}.crc"):
        if os.path.exists(f"{cp}/commits/{f}"):
            os.remove(f"{cp}/commits/{f}")
    J.stream_new_urls(spark.readStream.schema(SEEN).parquet(landing), store, cp).awaitTermination()
    assert sorted((r.event_id, r.url) for r in spark.read.parquet(store).collect()) == before


def test_cache_stream_equals_the_batch_cache(spark, tmp_path):
    landing, log, cp = (str(tmp_path / n) for n in ("in", "log", "cp"))
    batches = [
        [("a", 1, "2024-01-01 00:00:00", "2024-01-01 01:00:00"), ("b", 2, "2024-01-01 00:00:00", None), ("c", 3, "2024-01-01 00:00:00", "2024-01-01 09:00:00")],
        # a anew before its end, d already over when it comes, two of e at one time
        [("a", 4, "2024-01-01 00:50:00", "2024-01-01 05:00:00"), ("d", 5, "2024-01-01 00:55:00", "2024-01-01 00:56:00"), ("e", 6, "2024-01-01 00:57:00", None), ("e", 7, "2024-01-01 00:57:00", "2024-01-01 02:00:00")],
        # an older a within the delay changes nothing
        [("a", 8, "2024-01-01 00:49:00", None), ("f", 9, "2024-01-01 03:00:00", "2024-01-01 08:00:00")],
        [("g", 10, "2024-01-01 06:00:00", "2024-01-01 06:30:00"), (None, 11, "2024-01-01 06:00:00", None)],
        # c comes anew in the batch whose time would have ended it, b gets an end
        [("c", 12, "2024-01-01 09:30:00", "2024-01-02 00:00:00"), ("b", 13, "2024-01-01 09:30:00", "2024-01-01 09:31:00")],
        [("h", 14, "2024-01-01 12:00:00", None)],
    ]
    rows = []
    for batch in batches:
        _land(spark, batch, ENTRY, landing)
        rows += batch
        J.ttl_cache_stream(spark.readStream.schema(ENTRY).parquet(landing), log, cp).awaitTermination()
        entries = spark.read.parquet(landing)
        now = entries.agg((F.max("cached_at") - F.expr("INTERVAL 10 MINUTES")).cast("string")).first()[0]
        # the batch cache with ties settled by the row
        newest = entries.groupBy("url").agg(F.max_by(F.struct("event_id", "cached_at", "expires_at"), F.struct("cached_at", "event_id")).alias("r")).select("url", "r.*")
        want = {(r.url, r.event_id, r.expires_at) for r in J.ttl_cache_lookup(newest, now).collect()}
        assert {(r.url, r.row_id, r.expires_at) for r in J.ttl_cache_state(spark.read.parquet(log)).collect()} == want
    changes = spark.read.parquet(log)
    assert {r.row_id for r in changes.where("NOT alive").collect()} == {4, 5, 7, 9, 10, 13}
    assert changes.where("row_id IN (1, 3, 6, 8)").where("NOT alive").count() == 0


def test_cache_stream_of_many_urls_a_replay_and_rows_without_a_time(spark, tmp_path):
    """60,000 URLs in two batches: one Python call a URL and batch took minutes."""
    landing, log, cp = (str(tmp_path / n) for n in ("in", "log", "cp"))
    n = 60_000
    at = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, {})"
    first = spark.range(n).selectExpr("'u' || id url", "id event_id", f"{at.format(0)} cached_at", f"if(id % 3 = 0, NULL, {at.format(1)}) expires_at")
    # every second URL anew, after the others' end
    second = spark.range(0, n, 2).selectExpr("'u' || id url", f"id + {n} event_id", f"{at.format(3)} cached_at", f"{at.format(9)} expires_at")
    # without a time: older than any, and late never
    bare = spark.sql("SELECT * FROM VALUES ('u0', -1L, CAST(NULL AS timestamp), CAST(NULL AS timestamp)), ('bare', -2L, NULL, NULL) v(url, event_id, cached_at, expires_at)")
    began = time.time()
    for part in (first, second.unionByName(bare)):
        part.coalesce(2).write.mode("append").parquet(landing)
        J.ttl_cache_stream(spark.readStream.schema(ENTRY).parquet(landing), log, cp).awaitTermination()
    took = time.time() - began
    want = {(f"u{k}", k + n) for k in range(0, n, 2)} | {(f"u{k}", k) for k in range(3, n, 6)} | {("bare", -2)}

    def alive():
        return {(r.url, r.row_id) for r in J.ttl_cache_state(spark.read.parquet(log)).collect()}

    assert alive() == want
    changes = spark.read.parquet(log).groupBy("alive").count().collect()
    gone = sum(1 for k in range(1, n, 2) if k % 3)
    assert {r["alive"]: r["count"] for r in changes} == {True: n + n // 2 + 1, False: gone}
    # the last batch was written, but its commit was lost
    last = max(int(f) for f in os.listdir(f"{cp}/commits") if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{cp}/commits/{f}"):
            os.remove(f"{cp}/commits/{f}")
    J.ttl_cache_stream(spark.readStream.schema(ENTRY).parquet(landing), log, cp).awaitTermination()
    assert alive() == want and spark.read.parquet(log).count() == n + n // 2 + 1 + gone
    assert took < 60


def test_cache_query_on_odd_events(spark, tmp_path):
    """Events without an id, a user or a time, and none at all."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    rows = [(None, "2024-01-01 00:00:00", 1), (None, "2024-01-29 23:00:00", 2), (3, None, 3), (4, "2024-01-30 00:00:00", None), (5, "2024-01-01 00:00:00", 5), (6, "2024-01-30 01:00:00", 6)]
    for k, some in enumerate((rows, [])):
        folder = f"{tmp_path}/{k}"
        events = spark.createDataFrame([(e, t, u, None, None, None) for e, t, u in some], schema.replace("timestamp", "string"))
        events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{folder}/out")
        part = next(f for f in os.listdir(f"{folder}/out") if f.endswith(".parquet"))
        shutil.copy(f"{folder}/out/{part}", f"{folder}/events.parquet")
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
        oracle = all_oracles()["ttl_cache_stream"]
        assert compare(all_queries()["ttl_cache_stream"](spark, folder), con, oracle) is None
