"""Registered tracker and status queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftnet.operators import catalog as C
from driftnet.operators import tracker as T
from driftnet.plans.reads import rejected
from driftnet.plans.registry import query
from driftnet.sources.derived import view


@query("WITH f AS (SELECT info_hash, CAST(node_id AS VARCHAR) AS peer, min(event_id) AS seq FROM discoveries GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY info_hash ORDER BY seq, peer) AS place FROM f) SELECT info_hash, string_agg(peer, ',' ORDER BY place) AS peers FROM r WHERE place <= 3 GROUP BY 1", "discoveries")
def distinct_peers_capped(spark, d):
    seen = view(spark, d, "discoveries").select("info_hash", F.col("event_id").alias("seq"), F.col("node_id").cast("string").alias("peer"))
    return T.distinct_peers(seen, 3).select("info_hash", F.concat_ws(",", "peers").alias("peers"))


@query("SELECT sha1(CAST(l_orderkey AS VARCHAR)) AS info_hash, arg_min(l_partkey, (l_suppkey, l_linenumber, l_partkey)) AS result FROM lineitem WHERE l_linenumber <= 5 AND l_returnflag = 'R' GROUP BY 1")
def first_success(spark, d):
    rows = view(spark, d, "lineitem").select(F.sha1(F.col("l_orderkey").cast("string")).alias("info_hash"), F.col("l_linenumber").alias("place"), F.col("l_suppkey").alias("arrival"), (F.col("l_returnflag") == "R").alias("ok"), F.col("l_partkey").alias("result"))
    return T.first_success(rows)


@query("SELECT sha1(CAST(l_orderkey AS VARCHAR)) AS info_hash, arg_min(l_partkey, (l_linenumber, l_partkey)) AS answer FROM lineitem WHERE l_linenumber <= 3 AND l_returnflag != 'R' GROUP BY 1")
def scrape_closest_retry(spark, d):
    rows = view(spark, d, "lineitem").select(F.sha1(F.col("l_orderkey").cast("string")).alias("info_hash"), F.col("l_linenumber").alias("rank"), F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("answer"))
    return T.closest_retry(rows)


@query("SELECT count(*) FILTER (l_returnflag != 'R') AS scraped, count(*) FILTER (l_returnflag != 'R' AND l_quantity > 25) AS updated, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) AS total FROM lineitem")
def scrape_summary(spark, d):
    return T.scrape_summary(view(spark, d, "lineitem").select((F.col("l_returnflag") != "R").alias("ok"), (F.col("l_quantity") > 25).alias("grown")))


@query("SELECT s_name AS host, CASE WHEN s_suppkey % 2 = 0 THEN 'udp' ELSE 'http' END AS protocol, CAST(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 40 ELSE 74 END AS INTEGER) AS \"limit\", CAST(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 7 ELSE 0 END AS INTEGER) AS successes FROM supplier")
def tracker_listing(spark, d):
    own = view(spark, d, "supplier").select(F.col("s_name").alias("host"), F.when(F.col("s_suppkey") % 2 == 0, "udp").otherwise("http").alias("protocol"), "s_suppkey")
    state = own.filter("s_suppkey % 3 = 0").select("host", (F.col("s_suppkey") % 40).cast("int").alias("limit"), (F.col("s_suppkey") % 7).cast("int").alias("successes"))
    return T.tracker_listing(own, state, F.lit(74))


@query("""SELECT concat('{"catalog":{"total":', (SELECT count(*) FROM catalog), '},"rejects":{"rejected":', (SELECT count(DISTINCT info_hash) FROM discoveries WHERE event_type = 'error'), '}}') AS status""", "catalog discoveries")
def status_document(spark, d):
    return T.status_document(catalog=C.stats(view(spark, d, "catalog"), rejected(spark, d)).select("total"), rejects=rejected(spark, d).agg(F.count("*").alias("rejected")))
