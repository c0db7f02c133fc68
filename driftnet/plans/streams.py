"""Registered stages of the discovery pipeline, as batches with SQL twins and as streams over the same data."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftnet.operators.catalog import spread
from driftnet.plans import name_sql as Q
from driftnet.plans.parsing import FILED
from driftnet.plans.registry import query
from driftnet.sources.derived import view
from driftnet.streaming import pipeline as P
from driftnet.streaming import timed as T

NOW = 1_704_153_600
SOME = "part_c AS (SELECT * FROM catalog WHERE k % 3 != 0)"
ROUTE = f"""WITH {SOME}, rejects AS (SELECT DISTINCT info_hash FROM discoveries WHERE event_type = 'error'), a AS (SELECT DISTINCT info_hash FROM discoveries)
SELECT a.info_hash, CASE WHEN c.info_hash IS NULL AND r.info_hash IS NOT NULL THEN 'drop' WHEN c.info_hash IS NULL OR n_files = 0 THEN 'fetch' WHEN seeders + leechers = 0 OR {NOW} - coalesce(updated_at, 0) > 2592000 THEN 'scrape' ELSE 'drop' END AS route
FROM a LEFT JOIN part_c c USING (info_hash) LEFT JOIN rejects r USING (info_hash)"""


def arrivals(spark, d):
    return view(spark, d, "discoveries")


@query(ROUTE, "catalog discoveries")
def triage_route(spark, d):
    a = arrivals(spark, d)
    return P.triage(a, view(spark, d, "catalog").filter("k % 3 != 0"), a.filter("event_type = 'error'"), NOW)


@query()
def triage_stream(spark, d):
    """The same routes, batch by batch of a stream without repeated hashes."""
    catalog, rejects = view(spark, d, "catalog").filter("k % 3 != 0"), arrivals(spark, d).filter("event_type = 'error'")
    return P.drain_batches(P.unseen(P.stream(spark, d)), lambda batch, k: P.triage(batch, catalog, rejects, NOW))


@query("SELECT info_hash, count(*) = 1 AS once FROM (SELECT DISTINCT info_hash FROM discoveries) GROUP BY 1", "discoveries")
def seen_set_stream(spark, d):
    seen = P.drain(P.unseen(P.stream(spark, d), "4000 days").select("info_hash"))
    return seen.groupBy("info_hash").agg((F.count("*") == 1).alias("once"))


RATE = "s AS (SELECT seen_at, count(*) AS n FROM discoveries GROUP BY 1) SELECT seen_at AS at, sum(n) OVER (ORDER BY seen_at RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) / 60 AS rate FROM s"


@query(f"WITH {RATE}", "discoveries")
def rate_trailing_60s(spark, d):
    return P.trailing_rate(arrivals(spark, d).select(F.col("seen_at").alias("at")))


@query("SELECT CAST(floor(seen_at / 10) * 10 - 10 * i AS BIGINT) AS start, count(*) AS n FROM discoveries, range(0, 6) t(i) GROUP BY 1", "discoveries")
def sliding_window_batch(spark, d):
    return P.sliding_counts(arrivals(spark, d).select(F.timestamp_seconds("seen_at").alias("at")))


@query("SELECT CAST(floor(seen_at / 10) * 10 - 10 * i AS BIGINT) AS start, count(*) AS n FROM discoveries, range(0, 6) t(i) GROUP BY 1", "discoveries")
def sliding_window_stream(spark, d):
    return P.drain_updates(P.sliding_counts(P.stream(spark, d)), ["start"], "n")


#: Ten minutes of the table stand for a second, so that requests and answers lie near each other.
TXN = "SELECT event_id % 3 AS txn, seen_at // 600 AS seen_at, event_id FROM discoveries WHERE event_type {0} 'view'"
PAIRS = f"SELECT q.event_id AS request_id, a.event_id AS answer_id FROM ({TXN.format('=')}) q JOIN ({TXN.format('!=')}) a ON q.txn = a.txn AND a.seen_at BETWEEN q.seen_at AND q.seen_at + 4"


@query(PAIRS, "discoveries")
def txn_interval_join(spark, d):
    rows = arrivals(spark, d).select((F.col("event_id") % 3).alias("txn"), F.timestamp_seconds(F.floor(F.col("seen_at") / 600)).alias("at"), "event_id", "event_type")
    return P.correlate(rows.filter("event_type = 'view'"), rows.filter("event_type != 'view'"))


@query(PAIRS, "discoveries")
def txn_interval_join_stream(spark, d):
    rows = P.stream(spark, d).withColumn("txn", F.col("event_id") % 3).withColumn("at", F.timestamp_seconds(F.floor(F.unix_seconds("at") / 600)))
    return P.drain(P.correlate(rows.filter("event_type = 'view'"), rows.filter("event_type != 'view'")))


@query()
def routing_table_stream(spark, d):
    """Admissions into a routing table, kept from micro-batch to micro-batch."""
    nodes = P.stream(spark, d).select(F.sha1(F.col("node_id").cast("string")).alias("id"), "at")
    return P.admissions(nodes, "0" * 40)


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(value > 50 AS INTEGER)) AS BIGINT) AS big FROM discoveries GROUP BY 1", "discoveries")
def counters(spark, d):
    return arrivals(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("big"))


@query(f"{FILED}, v AS (SELECT k, name, {Q.adult()} OR ({Q.any_of('name', Q.R.JUNK_NAME)} AND NOT {Q.signals()}) OR {Q.junk_files()} AS junk, {Q.category()} AS category, {Q.quality_words('name')} AS quality, title, year, name_imdb AS imdb_id, total > 0 AND coalesce(video / total > 0.80, FALSE) AS media FROM filed) SELECT k, CASE WHEN junk THEN 'junk' WHEN category = 'unknown' AND NOT media THEN 'no media' ELSE 'keep' END AS verdict, category, quality, title, year, imdb_id FROM v", "catalog files")
def build_rows(spark, d):
    files = view(spark, d, "files").groupBy("k").agg(F.collect_list(F.struct("path", "size")).alias("files"))
    rows = spread(view(spark, d, "catalog").select("k", "info_hash", "name", "size"), "k").join(files, "k", "left")
    return P.build_rows(rows).select("k", "verdict", "category", "quality", "title", "year", "imdb_id")


@query(f"{FILED}, v AS (SELECT k, {Q.adult()} OR ({Q.any_of('name', Q.R.JUNK_NAME)} AND NOT {Q.signals()}) OR {Q.junk_files()} AS junk, {Q.category()} AS category, total > 0 AND coalesce(video / total > 0.80, FALSE) AS media FROM filed) SELECT sha1(CAST(k AS VARCHAR)) AS info_hash, NOT junk AND (category != 'unknown' OR media) AS kept FROM v", "catalog files")
def persist_batch(spark, d):
    """Each hash arrives twice; the first arrival decides whether it becomes a row or a reject."""
    files = view(spark, d, "files").groupBy("k").agg(F.collect_list(F.struct("path", "size")).alias("files"))
    own = spread(view(spark, d, "catalog").select("k", "info_hash", "name", "size"), "k").join(files, "k", "left").withColumn("arrival", F.lit(0))
    again = own.withColumns({"arrival": F.lit(1), "name": F.lit("later"), "files": F.lit(None).cast("array<struct<path:string,size:bigint>>")})
    rows, rejects = P.persist(own.unionByName(again))
    return rows.select("info_hash", F.lit(True).alias("kept")).unionByName(rejects.select("info_hash", F.lit(False).alias("kept")))


@query("SELECT k, concat_ws('; ', CASE WHEN octet_length(encode(name)) < 8 THEN 'name too short' END, CASE WHEN size < 1024 THEN 'size too small' END) AS errors FROM (SELECT k, substr(name, 1, CAST(k % 20 + 1 AS BIGINT)) AS name, size % 5000 AS size FROM catalog)", "catalog")
def metainfo_validation(spark, d):
    rows = view(spark, d, "catalog").select("k", F.substring(F.col("name"), F.lit(1), (F.col("k") % 20 + 1).cast("int")).alias("name"), (F.col("size") % 5000).alias("size"))
    return rows.select("k", P.validation_errors(F.col("name"), F.col("size"), F.lit(None).cast("array<struct<path:string,size:bigint>>")).alias("errors"))


@query("SELECT event_id, seen_at + 30 AS retry_at FROM discoveries WHERE event_type = 'error' AND event_id % 2 = 0", "discoveries")
def delayed_retry(spark, d):
    rows = arrivals(spark, d).filter("event_type = 'error'").select("event_id", F.timestamp_seconds("seen_at").alias("at"), (F.col("event_id") % 2).cast("int").alias("n_retries"))
    return P.retries(rows).select("event_id", F.col("at").cast("long").alias("retry_at"))


@query("SELECT CAST(event_id AS VARCHAR) AS item, CASE event_id % 2 WHEN 1 THEN 'failed' ELSE 'retry' END AS what, (seen_at + CASE event_id % 2 WHEN 1 THEN 0 ELSE 30 END) * 1000 AS at_ms FROM discoveries WHERE event_type = 'error' AND (event_id % 2 = 1 OR seen_at + 30 <= (SELECT max(seen_at) - 1 FROM discoveries WHERE event_type = 'error'))", "discoveries")
def timed_retry_stream(spark, d):
    """Failures come back by timer 30 seconds after they failed, once; those whose time had not come when the stream ended are still held."""
    failed = P.stream(spark, d).filter("event_type = 'error'").select(F.col("event_id").cast("string").alias("item"), (F.col("event_id") % 2).cast("int").alias("n_retries"), F.date_trunc("second", "at").alias("at"))
    return T.with_timers(spark, lambda: P.drain(T.timed_retries(failed, most=1_000_000)))


@query()
def size_or_time_batches(spark, d):
    """Discoveries in batches of 50 items or 12 days of a slot: how many items each has and what closed it."""
    items = P.stream(spark, d).select(F.col("event_id").cast("string").alias("item"), "at")
    out = T.with_timers(spark, lambda: P.drain(T.timed_batches(items, most=50, wait_ms=12 * 86_400_000)))
    return out.groupBy("slot", "batch", "why").agg(F.count("*").alias("n"), F.countDistinct("item").alias("n_distinct"))


@query("SELECT node_id, seen_at, count(*) AS n, greatest(count(*) - 2, 0) AS over_limit FROM discoveries GROUP BY 1, 2", "discoveries")
def keyed_rate_limit(spark, d):
    """Replay of a limit of two a second and key."""
    n = arrivals(spark, d).groupBy("node_id", "seen_at").agg(F.count("*").alias("n"))
    return n.withColumn("over_limit", F.greatest(F.col("n") - 2, F.lit(0)))


KIND = "CASE event_id % 6 WHEN 0 THEN 'ping' WHEN 1 THEN 'find_node' WHEN 2 THEN 'get_peers' WHEN 3 THEN 'announce_peer' WHEN 4 THEN 'sample' ELSE 'other' END"


@query(f"""WITH q AS (SELECT event_id AS id, {KIND} AS kind, info_hash AS target, CAST(node_id AS VARCHAR) AS addr FROM discoveries), p AS (SELECT info_hash AS target, count(DISTINCT node_id % 9) AS n FROM discoveries WHERE event_type = 'click' GROUP BY 1)
SELECT id, CASE kind WHEN 'get_peers' THEN CASE WHEN n IS NOT NULL THEN 'peers' ELSE 'nodes' END WHEN 'find_node' THEN 'nodes' WHEN 'ping' THEN 'pong' WHEN 'announce_peer' THEN 'pong' WHEN 'sample' THEN 'samples' ELSE 'error' END AS answer,
  CASE WHEN kind = 'get_peers' THEN md5(concat_ws('|', 'k', target, addr)) END AS token, CASE WHEN kind = 'find_node' OR (kind = 'get_peers' AND n IS NULL) THEN 2 END AS n_nodes, CASE WHEN kind = 'get_peers' THEN CAST(n AS INTEGER) END AS n_values FROM q LEFT JOIN p USING (target)""", "discoveries")
def query_responder(spark, d):
    a = arrivals(spark, d)
    queries = a.select(F.col("event_id").alias("id"), F.expr(KIND).alias("kind"), F.col("info_hash").alias("target"), F.col("node_id").cast("string").alias("addr"))
    peers = a.filter("event_type = 'click'").groupBy(F.col("info_hash").alias("target")).agg(F.collect_set(F.col("node_id") % 9).alias("values"))
    nearest = a.select(F.col("info_hash").alias("target")).distinct().withColumn("nodes", F.array(F.lit("a"), F.lit("b")))
    return P.responses(queries, peers, nearest, "k")
