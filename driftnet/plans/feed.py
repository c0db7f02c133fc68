"""Registered feed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftnet import schema
from driftnet.functions import feed as X
from driftnet.operators import catalog as C
from driftnet.plans.name_sql import contains_any, first_rule
from driftnet.plans.registry import query
from driftnet.functions import rules as R
from driftnet.sources.derived import view

FLAGS = f"flags AS MATERIALIZED (SELECT *, {first_rule('name', R.SOURCE)} = 'bluray' OR {contains_any('name', ['bluray', 'blu-ray'])} AS b, {first_rule('name', R.SOURCE)} = 'web-dl' OR {contains_any('name', ['web-dl', 'webdl'])} AS w FROM catalog)"
LEVEL = "CASE quality WHEN 1 THEN {0}030 WHEN 2 THEN {0}040 WHEN 3 THEN {0}040 WHEN 4 THEN {0}045 ELSE CASE WHEN {1} THEN {2} END END"
IDS = f"""ids AS MATERIALIZED (SELECT *, list_filter(CASE category WHEN 0 THEN [2000, CASE WHEN b THEN 2060 END, CASE WHEN w THEN 2080 END, {LEVEL.format(2, 'NOT b AND NOT w', 2020)}]
  WHEN 1 THEN [5000, CASE WHEN w THEN 5010 END, {LEVEL.format(5, 'NOT w', 5050)}] WHEN 2 THEN [5000, 5070] ELSE [7000] END, lambda x: x IS NOT NULL) AS ids FROM flags)"""


@query(f"WITH {FLAGS}, {IDS} SELECT k, array_to_string(ids, ',') AS ids FROM ids", "catalog")
def feed_categories(spark, d):
    return X.with_feed_columns(view(spark, d, "catalog")).select("k", F.concat_ws(",", F.transform("ids", lambda i: i.cast("string"))).alias("ids"))


@query(f"""WITH {FLAGS}, {IDS} SELECT k, concat_ws(';', array_to_string(list_transform(ids, lambda i: concat('category=', i)), ';'), CASE WHEN imdb_id IS NOT NULL THEN concat('imdb=', substr(imdb_id, 3)) END, CASE WHEN tmdb_id > 0 THEN concat('tmdbid=', tmdb_id) END,
  concat('seeders=', seeders), concat('peers=', seeders + leechers), 'downloadvolumefactor=0', 'uploadvolumefactor=1') AS attrs FROM ids""", "catalog")
def feed_attributes(spark, d):
    flat = F.concat_ws(";", F.transform("attrs", lambda a: F.concat(a["name"], F.lit("="), a["value"])))
    return X.with_feed_columns(view(spark, d, "catalog")).select("k", flat.alias("attrs"))


@query("SELECT info_hash, category, quality FROM catalog WHERE category IN (0, 1) AND quality IN (1, 2, 3) ORDER BY discovered_at DESC, info_hash LIMIT 40", "catalog")
def feed_filter_cross_product(spark, d):
    categories, qualities = X.filters_of(X.parse_category_list("2030, x,5040,9999"))
    rows = C.select_by(view(spark, d, "catalog"), categories, qualities)
    return rows.orderBy(*C.total_order("discovered_at")).limit(40).select("info_hash", "category", "quality")


@query("""SELECT k, concat('{"info_hash":"', info_hash, '","name":', to_json(name), ',"category":"', CASE category WHEN 0 THEN 'movie' WHEN 1 THEN 'tv' WHEN 2 THEN 'anime' ELSE 'unknown' END, '"', CASE WHEN imdb_id IS NULL THEN '' ELSE concat(',"imdb_id":"', imdb_id, '"') END,
  CASE WHEN tmdb_id IS NULL THEN '' ELSE concat(',"tmdb_id":', tmdb_id) END, ',"seeders":', seeders, '}') AS json FROM catalog""", "catalog")
def json_rows(spark, d):
    c = F.col
    return view(spark, d, "catalog").select("k", X.json_row({"info_hash": c("info_hash"), "name": c("name"), "category": schema.category_name(c("category")), "imdb_id": c("imdb_id"), "tmdb_id": c("tmdb_id"), "seeders": c("seeders")}).alias("json"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN concat('imdb:tt', c_custkey) WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN concat('tmdb:', c_custkey) WHEN c_custkey % 5 = 0 THEN concat('tvdb:', c_custkey) END AS id FROM customer")
def external_id_precedence(spark, d):
    k = F.col("c_custkey").cast("string")
    imdb = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("tt"), k)).otherwise("ttx")
    tmdb = F.when((F.col("c_custkey") % 3 == 1) & (F.col("c_custkey") % 2 == 0), k).otherwise("none")
    return view(spark, d, "customer").select("c_custkey", X.external_id(imdb, tmdb, F.when(F.col("c_custkey") % 5 == 0, k)).alias("id"))


@query("SELECT o_orderkey AS k, CASE WHEN n IS NULL OR o_orderkey % 7 = 0 THEN 0 ELSE n END AS n, CASE WHEN n IS NULL OR o_orderkey % 7 = 0 THEN 0 ELSE total END AS total FROM orders LEFT JOIN (SELECT k, CAST(count(*) AS INTEGER) AS n, CAST(sum(size) AS BIGINT) AS total FROM files GROUP BY k) f ON f.k = o_orderkey", "files")
def stored_files(spark, d):
    """File lists written as JSON and read back; every seventh is broken on the way."""
    files = view(spark, d, "files").groupBy("k").agg(F.collect_list(F.struct("path", "size")).alias("files"))
    rows = view(spark, d, "orders").select(F.col("o_orderkey").alias("k")).join(files, "k", "left").withColumn("stored", X.files_json(F.col("files")))
    broken = F.when(F.col("k") % 7 == 0, F.substring("stored", 1, 9)).otherwise(F.col("stored"))
    back = rows.select("k", X.files_of(broken).alias("back"))
    return back.select("k", F.size("back").alias("n"), F.aggregate("back", F.lit(0).cast("long"), lambda a, f: a + f["size"]).alias("total"))


@query()
def feed_rss(spark, d):
    rows = X.with_feed_columns(view(spark, d, "catalog")).select("info_hash", "name", "size", "attrs", "discovered_at")
    page = rows.orderBy(*C.total_order("discovered_at")).limit(50).collect()
    return spark.createDataFrame([(X.rss(page), X.capabilities())], "feed string, caps string")
