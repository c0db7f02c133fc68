"""Registered mutations: each returns the state of the table after the change."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftnet.operators import mutate as M
from driftnet.operators import settings as C
from driftnet.plans.registry import query
from driftnet.session import shared_dir
from driftnet.sources.derived import view

STATE = "info_hash, name, discovered_at, seeders"
HALF = "old AS (SELECT info_hash, name, discovered_at, seeders FROM catalog WHERE k % 2 = 0)"
BATCH = "batch AS (SELECT info_hash, concat('new ', name) AS name, discovered_at + seq AS discovered_at, CAST(seq AS INTEGER) AS seeders FROM catalog, (VALUES (1), (2)) AS s(seq) WHERE k % 3 = 0)"
LAST = "last AS (SELECT * FROM batch WHERE seeders = 2)"
NOW = 1_000_000_000


def old(spark, d):
    return view(spark, d, "catalog").filter("k % 2 = 0").select("info_hash", "name", "discovered_at", "seeders")


def batch(spark, d):
    rows = view(spark, d, "catalog").filter("k % 3 = 0").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
    return rows.select("info_hash", F.concat(F.lit("new "), "name").alias("name"), (F.col("discovered_at") + F.col("seq")).alias("discovered_at"), F.col("seq").alias("seeders"))


@query(f"WITH {HALF}, {BATCH}, {LAST} SELECT {STATE} FROM old WHERE info_hash NOT IN (SELECT info_hash FROM last) UNION ALL SELECT {STATE} FROM last", "catalog")
def upsert_last_wins(spark, d):
    return M.upsert(old(spark, d), M.checked(batch(spark, d)), [F.desc("seeders")])


@query(f"""WITH {HALF}, {BATCH}, {LAST} SELECT {STATE} FROM old WHERE info_hash NOT IN (SELECT info_hash FROM last)
UNION ALL SELECT l.info_hash, l.name, coalesce(o.discovered_at, l.discovered_at), l.seeders FROM last l LEFT JOIN old o USING (info_hash)""", "catalog")
def upsert_keep_discovered(spark, d):
    return M.upsert(old(spark, d), batch(spark, d), [F.desc("seeders")], keep=["discovered_at"])


@query("SELECT info_hash, name FROM catalog WHERE k % 5 != 0", "catalog")
def delete_by_key(spark, d):
    rows = view(spark, d, "catalog")
    return M.delete(rows.select("info_hash", "name"), rows.filter("k % 5 = 0"))


@query("""WITH r AS (SELECT info_hash, min(seen_at) AS rejected_at FROM discoveries WHERE event_type = 'error' AND event_id % 2 = 0 GROUP BY info_hash),
n AS (SELECT info_hash, min(seen_at) AS rejected_at FROM discoveries WHERE event_type = 'error' AND event_id % 2 = 1 GROUP BY info_hash)
SELECT * FROM r UNION ALL SELECT * FROM n WHERE info_hash NOT IN (SELECT info_hash FROM r)""", "discoveries")
def reject_first_wins(spark, d):
    errors = view(spark, d, "discoveries").filter("event_type = 'error'").withColumn("rejected_at", F.col("seen_at"))
    first = errors.filter("event_id % 2 = 0").groupBy("info_hash").agg(F.min("rejected_at").alias("rejected_at"))
    return M.insert_ignore(first, errors.filter("event_id % 2 = 1"))


MATCH_COLUMNS = "info_hash, imdb_id, tmdb_id, media_year, match_status, match_attempts, match_after, updated_at"


@query(f"""WITH u AS (SELECT info_hash AS h, CASE WHEN k % 14 = 0 THEN imdb_id END AS i FROM catalog WHERE k % 7 = 0)
SELECT info_hash, CASE WHEN h IS NULL THEN imdb_id ELSE i END AS imdb_id, CASE WHEN h IS NULL THEN tmdb_id ELSE 7 END AS tmdb_id, CASE WHEN h IS NULL THEN media_year END AS media_year,
  CASE WHEN h IS NULL THEN match_status ELSE 1 END AS match_status, CASE WHEN h IS NULL THEN match_attempts ELSE match_attempts + 1 END AS match_attempts, CASE WHEN h IS NULL THEN match_after ELSE 0 END AS match_after,
  CASE WHEN h IS NULL THEN updated_at ELSE {NOW} END AS updated_at FROM catalog LEFT JOIN u ON info_hash = h""", "catalog")
def update_match_result(spark, d):
    rows = view(spark, d, "catalog").select("k", *MATCH_COLUMNS.split(", "))
    found = rows.filter("k % 7 = 0").select("info_hash", F.expr("CASE WHEN k % 14 = 0 THEN imdb_id END").alias("imdb_id"), F.lit(7).alias("tmdb_id"), F.lit(None).cast("int").alias("media_year"), F.lit(1).alias("match_status"), F.lit(0).cast("long").alias("match_after"))
    return M.apply_match(rows.drop("k"), found, NOW)


@query("SELECT info_hash, CASE WHEN k % 11 = 0 THEN 3 ELSE category END AS category FROM catalog", "catalog")
def update_category(spark, d):
    rows = view(spark, d, "catalog")
    return M.update(rows.select("info_hash", "category"), rows.filter("k % 11 = 0").select("info_hash", F.lit(3).alias("category")), ["category"])


RESULTS = "SELECT sha1(CAST(l_orderkey AS VARCHAR)) AS info_hash, max(CAST(l_quantity AS INTEGER)) AS complete, max(CAST(l_suppkey % 50 AS INTEGER)) AS incomplete FROM lineitem GROUP BY 1"


def scraped(spark, d):
    return view(spark, d, "lineitem").select(F.sha1(F.col("l_orderkey").cast("string")).alias("info_hash"), F.col("l_quantity").cast("int").alias("complete"), (F.col("l_suppkey") % 50).cast("int").alias("incomplete"))


@query(f"SELECT info_hash, greatest(complete, 0) AS complete, greatest(incomplete, 0) AS incomplete FROM ({RESULTS})")
def max_merge_counters(spark, d):
    return scraped(spark, d).groupBy("info_hash").agg(F.greatest(F.max("complete"), F.lit(0)).alias("complete"), F.greatest(F.max("incomplete"), F.lit(0)).alias("incomplete"))


@query(f"""SELECT c.info_hash, greatest(seeders, complete, 0) AS seeders, greatest(leechers, incomplete, 0) AS leechers FROM catalog c JOIN ({RESULTS}) r ON r.info_hash = c.info_hash
WHERE greatest(seeders, complete, 0) > seeders OR greatest(leechers, incomplete, 0) > leechers""", "catalog")
def counters_grown(spark, d):
    return M.merge_counters(view(spark, d, "catalog"), scraped(spark, d))


@query(f"SELECT c.info_hash, coalesce(complete, seeders) AS seeders, coalesce(incomplete, leechers) AS leechers, CASE WHEN complete IS NULL THEN updated_at ELSE {NOW} END AS updated_at FROM catalog c LEFT JOIN ({RESULTS}) r ON r.info_hash = c.info_hash", "catalog")
def update_counters(spark, d):
    best = max_merge_counters(spark, d).select("info_hash", F.col("complete").alias("seeders"), F.col("incomplete").alias("leechers"))
    rows = view(spark, d, "catalog").select("info_hash", "seeders", "leechers", "updated_at")
    return M.update(rows, best, ["seeders", "leechers"], also={"updated_at": F.lit(NOW).cast("long")})


@query("SELECT info_hash, CASE match_status WHEN 2 THEN 0 ELSE match_status END AS match_status, CASE match_status WHEN 2 THEN 0 ELSE match_attempts END AS match_attempts, CASE match_status WHEN 2 THEN 0 ELSE match_after END AS match_after FROM catalog", "catalog")
def reset_failed(spark, d):
    return M.reset_failed(view(spark, d, "catalog").select("info_hash", "match_status", "match_attempts", "match_after"))


@query("SELECT info_hash, min(seen_at) AS rejected_at FROM discoveries GROUP BY info_hash HAVING min(seen_at) >= 1704153600 - 90 * 86400 + 7776000", "discoveries")
def purge_rejects(spark, d):
    rows = view(spark, d, "discoveries").groupBy("info_hash").agg(F.min("seen_at").alias("rejected_at"))
    return M.purge_rejects(rows, 1704153600 + 7776000)


@query("SELECT info_hash, match_after + CASE WHEN k % 9 = 0 THEN 3153600000 ELSE 0 END AS match_after FROM catalog WHERE match_after + CASE WHEN k % 9 = 0 THEN 3153600000 ELSE 0 END <= 1000000000::BIGINT + 50 * 365 * 86400", "catalog")
def purge_junk_marked(spark, d):
    rows = view(spark, d, "catalog").select("info_hash", F.expr("match_after + CASE WHEN k % 9 = 0 THEN 3153600000 ELSE 0 END").alias("match_after"))
    return M.purge_junk_marked(rows, NOW)


@query("WITH s AS (SELECT n_name AS key, 'old' AS value FROM nation UNION ALL SELECT r_name, 'r' FROM region) SELECT key, CASE WHEN key = 'NEW' THEN 'x' ELSE value END AS value FROM s WHERE key NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 1) UNION ALL SELECT n_name, concat('new', n_nationkey) FROM nation WHERE n_regionkey = 1")
def set_settings(spark, d):
    nation = view(spark, d, "nation")
    before = nation.select(F.col("n_name").alias("key"), F.lit("old").alias("value")).unionByName(view(spark, d, "region").select(F.col("r_name").alias("key"), F.lit("r").alias("value")))
    new = nation.filter("n_regionkey = 1").select(F.col("n_name").alias("key"), F.concat(F.lit("new"), F.col("n_nationkey").cast("string")).alias("value"))
    return M.upsert(before, new, [F.desc("value")], key="key")


@query("SELECT n_name AS key, n_regionkey AS value FROM nation ORDER BY 1")
def settings_map(spark, d):
    """All settings as one map, read back by key."""
    one = view(spark, d, "nation").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_regionkey"))).alias("m"))
    return one.select(F.explode("m").alias("key", "value"))


@query("SELECT info_hash, name, discovered_at FROM catalog", "catalog")
def migrate_copy(spark, d):
    rows = view(spark, d, "catalog").select("info_hash", "name", "discovered_at", "k")
    return M.copy_all(rows.drop("k"), rows.filter("k % 4 = 0").withColumn("name", F.lit("stale")).drop("k"))


@query("SELECT count(*) AS copied, sum(CAST(size AS BIGINT))::BIGINT AS bytes FROM catalog", "catalog")
def backup_roundtrip(spark, d):
    rows = view(spark, d, "catalog").select("info_hash", "size", "discovered_at")
    return spark.read.parquet(M.publish(rows, shared_dir(spark))).agg(F.count("*").alias("copied"), F.sum("size").alias("bytes"))


@query("SELECT name, last_run, CASE WHEN every > 0 THEN last_run + every ELSE 0 END AS next_run, failed FROM (SELECT event_type AS name, max(seen_at) AS last_run, CASE event_type WHEN 'view' THEN 60 ELSE 0 END AS every, arg_max(user_even, (seen_at, event_id)) AS failed FROM (SELECT *, node_id % 2 = 0 AS user_even FROM discoveries) GROUP BY event_type)", "discoveries")
def task_registry(spark, d):
    runs = view(spark, d, "discoveries").select(F.col("event_type").alias("name"), "seen_at", "event_id", (F.col("node_id") % 2 == 0).alias("failed"))
    last = runs.groupBy("name").agg(F.max("seen_at").alias("seen_at"), F.max_by("failed", F.struct("seen_at", "event_id")).alias("failed"))
    every = F.when(F.col("name") == "view", 60).otherwise(0)
    return last.select("name", F.col("seen_at").alias("last_run"), F.when(every > 0, F.col("seen_at") + every).otherwise(0).alias("next_run"), "failed")


@query(f"""SELECT c.info_hash, greatest(seeders, complete, 0) AS seeders, greatest(leechers, incomplete, 0) AS leechers FROM catalog c JOIN ({RESULTS}) r ON r.info_hash = c.info_hash
WHERE greatest(seeders, complete, 0) > seeders OR greatest(leechers, incomplete, 0) > leechers""", "catalog")
def refresh_on_arrival(spark, d):
    from driftnet.streaming import pipeline as P

    return P.refresh_on_arrival(view(spark, d, "catalog"), scraped(spark, d))


@query("SELECT k AS hash_key, addr, max(seen_at) AS seen_at FROM (SELECT info_hash AS k, CAST(node_id % 50 AS VARCHAR) AS addr, seen_at FROM discoveries) GROUP BY ALL", "discoveries")
def announce_peers(spark, d):
    seen = view(spark, d, "discoveries").select(F.col("info_hash").alias("hash_key"), (F.col("node_id") % 50).cast("string").alias("addr"), "seen_at")
    return seen.groupBy("hash_key", "addr").agg(F.max("seen_at").alias("seen_at"))


KINDS = "VALUES ('f', 'flag', NULL, NULL), ('n', 'number', 1L, 10L), ('d', 'duration', NULL, NULL), ('l', 'lines', NULL, NULL), ('v', 'level', NULL, NULL) AS t(key, kind, least, most)"


@query("""WITH s AS (SELECT o_orderkey, o_orderkey % 5 AS r, o_custkey AS c, o_orderstatus AS st, trim(o_orderpriority) AS pr FROM orders),
t AS (SELECT o_orderkey, CASE r WHEN 0 THEN 'flag' WHEN 1 THEN 'number' WHEN 2 THEN 'duration' WHEN 3 THEN 'lines' ELSE 'level' END AS kind, CASE WHEN r = 0 AND c % 3 < 2 THEN c % 3 = 0 END AS flag,
CAST(CASE WHEN r = 1 AND c % 20 - 5 BETWEEN 1 AND 10 THEN c % 20 - 5 WHEN r = 2 AND c % 7 > 0 THEN ((c % 30) * 3600 + (c % 60) * 60) * 1000000000 + 500000 END AS BIGINT) AS number,
CASE WHEN r = 3 THEN concat(pr, ',', st) END AS lines, CASE WHEN r = 4 THEN CASE st WHEN 'F' THEN 'warn' WHEN 'O' THEN 'info' END END AS level FROM s)
SELECT *, flag IS NOT NULL OR number IS NOT NULL OR lines IS NOT NULL OR level IS NOT NULL AS fits FROM t""")
def settings_coerced(spark, d):
    """Texts of settings, one for each order, in the types of their kinds; texts that do not fit have none."""
    text = """CASE o_orderkey % 5 WHEN 0 THEN element_at(array('true', 'F', 'yes'), CAST(o_custkey % 3 + 1 AS INT)) WHEN 1 THEN CAST(o_custkey % 20 - 5 AS STRING)
    WHEN 2 THEN IF(o_custkey % 7 = 0, '90', concat(o_custkey % 30, 'h', o_custkey % 60, 'm.5ms')) WHEN 3 THEN concat(' ', o_orderpriority, ' \n\n', o_orderstatus) ELSE CASE o_orderstatus WHEN 'F' THEN 'WARN' WHEN 'O' THEN 'info' ELSE 'loud' END END"""
    key = F.element_at(F.array(*map(F.lit, "fndlv")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = view(spark, d, "orders").select("o_orderkey", key.alias("key"), F.expr(text).alias("value"))
    return C.coerce(rows, spark.sql(f"SELECT * FROM {KINDS}")).drop("key").withColumn("lines", F.array_join("lines", ","))
