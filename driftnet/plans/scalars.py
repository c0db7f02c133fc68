"""Registered scalar functions that no other area has."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftnet.functions import binary as B
from driftnet.functions import text as T
from driftnet.plans.registry import query
from driftnet.sources.derived import view

URL = "CASE p_partkey % 5 WHEN 0 THEN concat('udp://t', p_partkey, '.org:6969/announce') WHEN 1 THEN concat('http://t.net/x', p_partkey, '/announce?key=1') WHEN 2 THEN 'udp://t.org' WHEN 3 THEN 'https://t.io/scrape' ELSE 'ftp://t/announce' END"


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'udp' WHEN 1 THEN 'http' WHEN 2 THEN 'udp' WHEN 3 THEN 'https' END AS protocol, CASE p_partkey % 5 WHEN 0 THEN concat('t', p_partkey, '.org:6969') WHEN 1 THEN 't.net' WHEN 2 THEN 't.org:80' WHEN 3 THEN 't.io' END AS host,
  CASE p_partkey % 5 WHEN 1 THEN concat('http://t.net/x', p_partkey, '/scrape?key=1') END AS scrape FROM part""")
def url_announce_to_scrape(spark, d):
    u = F.expr(URL)
    return view(spark, d, "part").select("p_partkey", T.tracker_protocol(u).alias("protocol"), T.tracker_host(u).alias("host"), T.scrape_url(u).alias("scrape"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN sha1(CAST(c_custkey AS VARCHAR)) END AS h FROM customer")
def info_hash_parse(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" URN:BTIH:"), F.upper(F.sha1(k.cast("string"))))).when(k % 3 == 1, F.sha1(k.cast("string"))).otherwise("zz")
    return view(spark, d, "customer").select("c_custkey", B.parse_info_hash(raw).alias("h"))


@query("SELECT k, strftime(make_timestamp(discovered_at * 1000000), '%a, %d %b %Y %H:%M:%S +0000') AS rfc1123, strftime(make_timestamp(discovered_at * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS rfc3339 FROM catalog", "catalog")
def time_formats(spark, d):
    at = F.col("discovered_at")
    return view(spark, d, "catalog").select("k", T.rfc1123(at).alias("rfc1123"), T.rfc3339(at).alias("rfc3339"))


@query("SELECT k, CASE WHEN size < 1024 THEN concat(size, ' B') WHEN size < 1048576 THEN concat(CAST(round(size * 10 / 1024) AS BIGINT) // 10, '.', CAST(round(size * 10 / 1024) AS BIGINT) % 10, ' KB') WHEN size < 1073741824 THEN concat(CAST(round(size * 10 / 1048576) AS BIGINT) // 10, '.', CAST(round(size * 10 / 1048576) AS BIGINT) % 10, ' MB') ELSE concat(CAST(round(size * 10 / 1073741824) AS BIGINT) // 10, '.', CAST(round(size * 10 / 1073741824) AS BIGINT) % 10, ' GB') END AS shown, CASE WHEN k < 60 THEN concat(k, 's ago') WHEN k < 3600 THEN concat(k // 60, 'm ago') WHEN k < 86400 THEN concat(k // 3600, 'h ago') ELSE concat(k // 86400, 'd ago') END AS age, greatest(1, CAST(ceil(k / 50) AS BIGINT)) AS pages FROM catalog", "catalog")
def display_formats(spark, d):
    k = F.col("k")
    return view(spark, d, "catalog").select("k", T.show_bytes(F.col("size")).alias("shown"), T.show_age(k).alias("age"), T.page_count(k, 50).alias("pages"))


@query("SELECT k, CASE WHEN octet_length(encode(name)) > 20 THEN concat(substr(name, 1, 20), '...') ELSE name END AS short FROM catalog", "catalog")
def truncate_names(spark, d):
    return view(spark, d, "catalog").select("k", T.truncate(F.col("name"), 20).alias("short"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 4 ELSE 8 END AS n FROM customer")
def adaptive_limit(spark, d):
    """A batch limit folded over ordered outcomes: halved on failure, a quarter more after a hundred successes."""
    outcomes = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.array_repeat(F.lit(True), 100), F.array(F.lit(False), F.lit(True)))).otherwise(F.array_repeat(F.lit(True), 250))
    return view(spark, d, "customer").select("c_custkey", T.adaptive_limit(outcomes, 8).alias("n"))


@query("SELECT doc_id, CAST(length(text) * 100 / 7 AS BIGINT) // 100 AS rate, CAST(floor(100.0 * doc_id / (SELECT count(*) FROM documents)) AS BIGINT) AS pct FROM documents")
def progress_ratios(spark, d):
    docs = view(spark, d, "documents").select("doc_id", "text")
    total = docs.agg(F.count("*").alias("total"))
    return docs.crossJoin(F.broadcast(total)).select("doc_id", F.floor(F.floor(F.length("text") * 100 / 7 + F.lit(0.5)) / 100).cast("long").alias("rate"), F.floor(F.lit(100.0) * F.col("doc_id") / F.col("total")).cast("long").alias("pct"))


@query("SELECT user_id, list_aggregate(list(value ORDER BY ts DESC, event_id DESC)[:60], 'count') AS kept FROM events GROUP BY user_id")
def bounded_history(spark, d):
    ordered = F.sort_array(F.collect_list(F.struct("ts", "event_id", "value")), asc=False)
    return view(spark, d, "events").groupBy("user_id").agg(F.size(F.slice(ordered, 1, 60)).cast("long").alias("kept"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_field(spark, d):
    return view(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
