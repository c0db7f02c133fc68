"""Registered reads of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftnet import schema
from driftnet.operators import catalog as C
from driftnet.plans.registry import query
from driftnet.sources.derived import view

COLUMNS = "k, info_hash, name, size, category, quality, imdb_id, tmdb_id, media_year, match_status, seeders, leechers, discovered_at, updated_at"
PAGE = "info_hash, name, discovered_at"
REJECTED = "rejected AS (SELECT info_hash, min(seen_at) AS rejected_at FROM discoveries WHERE event_type = 'error' GROUP BY info_hash)"


def rejected(spark, d):
    return view(spark, d, "discoveries").filter("event_type = 'error'").groupBy("info_hash").agg(F.min("seen_at").alias("rejected_at"))


@query("SELECT k, info_hash, name, coalesce(size, 0) AS size, coalesce(updated_at, 0) AS updated_at FROM catalog", "catalog")
def scan_defaults(spark, d):
    return C.with_defaults(view(spark, d, "catalog").select("k", "info_hash", "name", "size", "updated_at"))


@query(f"SELECT {', '.join(C.API_COLUMNS)} FROM catalog", "catalog")
def api_projection(spark, d):
    return view(spark, d, "catalog").select(*C.API_COLUMNS)


@query(f"SELECT {PAGE} FROM catalog WHERE discovered_at > 800000000 OR (discovered_at = 800000000 AND info_hash > '8') ORDER BY discovered_at, info_hash LIMIT 200", "catalog")
def keyset_page(spark, d):
    return C.keyset_page(view(spark, d, "catalog").select("info_hash", "name", "discovered_at"), 800000000, "8", 200)


@query("SELECT info_hash, name, size FROM catalog WHERE info_hash = sha1('77')", "catalog")
def lookup_point(spark, d):
    return C.by_hash(view(spark, d, "catalog").select("info_hash", "name", "size"), "D321D6F7CCF98B51540EC9D933F20898AF3BD71E")


@query("SELECT info_hash, name FROM catalog WHERE info_hash IN (SELECT info_hash FROM discoveries)", "catalog discoveries")
def lookup_in_list(spark, d):
    return C.by_hashes(view(spark, d, "catalog").select("info_hash", "name"), view(spark, d, "discoveries"))


@query("SELECT pos, c.info_hash, c.name FROM (VALUES (0, sha1('77')), (1, sha1('4')), (2, sha1('77'))) AS a(pos, info_hash) JOIN catalog c ON c.info_hash = a.info_hash", "catalog")
def lookup_bulk_ordered(spark, d):
    import hashlib

    keys = [hashlib.sha1(str(k).encode()).hexdigest() for k in (77, 4, 77)] + ["0" * 40]
    return C.by_hashes_in_order(view(spark, d, "catalog").select("info_hash", "name"), keys, spark)


@query("SELECT k, category, quality FROM catalog WHERE category IN (0, 1) AND quality IN (2, 3)", "catalog")
def filter_category_quality(spark, d):
    return C.select_by(view(spark, d, "catalog"), [0, 1], [2, 3]).select("k", "category", "quality")


@query("SELECT k, media_year FROM catalog WHERE media_year >= 1980 AND media_year <= 1999", "catalog")
def filter_year_range(spark, d):
    return C.select_by(view(spark, d, "catalog"), min_year=1980, max_year=1999).select("k", "media_year")


@query("SELECT k, imdb_id FROM catalog WHERE imdb_id = 'tt0000042'", "catalog")
def external_id_imdb(spark, d):
    return C.by_external_id(view(spark, d, "catalog"), "imdb", "tt0000042").select("k", "imdb_id")


@query("SELECT k, tmdb_id FROM catalog WHERE tmdb_id = 44", "catalog")
def external_id_tmdb(spark, d):
    return C.by_external_id(view(spark, d, "catalog"), "tmdb", "44").select("k", "tmdb_id")


@query("SELECT info_hash, discovered_at, match_attempts FROM catalog WHERE match_status IN (0, 2) AND match_after < 900000500 AND match_attempts < 4 ORDER BY discovered_at DESC, info_hash LIMIT 100", "catalog")
def queue_unmatched(spark, d):
    return C.match_queue(view(spark, d, "catalog"), 900000500).select("info_hash", "discovered_at", "match_attempts")


@query("SELECT info_hash, updated_at, (SELECT count(*) FROM catalog WHERE match_status = 2) AS total FROM catalog WHERE match_status = 2 ORDER BY updated_at DESC NULLS LAST, info_hash LIMIT 20 OFFSET 5", "catalog")
def page_status(spark, d):
    return C.with_status(view(spark, d, "catalog").select("info_hash", "updated_at", "match_status"), 2, offset=5).drop("match_status")


@query("SELECT info_hash, updated_at FROM catalog WHERE updated_at > 0 AND match_status = 1 ORDER BY updated_at DESC, info_hash LIMIT 200", "catalog")
def recently_updated(spark, d):
    return C.recently_updated(view(spark, d, "catalog"), 500).select("info_hash", "updated_at")


@query(f"SELECT {PAGE}, (SELECT count(*) FROM catalog) AS total FROM catalog ORDER BY discovered_at DESC, info_hash LIMIT 50", "catalog")
def page_recent(spark, d):
    return C.recent(view(spark, d, "catalog").select("info_hash", "name", "discovered_at"))


@query(f"SELECT {PAGE}, (SELECT count(*) FROM catalog WHERE category = 1) AS total FROM catalog WHERE category = 1 ORDER BY discovered_at DESC, info_hash LIMIT 30 OFFSET 60", "catalog")
def page_recent_category(spark, d):
    rows = C.select_by(view(spark, d, "catalog").select("info_hash", "name", "discovered_at", "category", "quality", "media_year"), [1])
    return C.recent(rows.select("info_hash", "name", "discovered_at"), 30, 60)


@query(f"WITH {REJECTED} SELECT r.info_hash FROM rejected r WHERE r.info_hash IN (SELECT info_hash FROM catalog)", "catalog discoveries")
def reject_membership(spark, d):
    return C.by_hashes(rejected(spark, d), view(spark, d, "catalog")).select("info_hash")


@query(f"""WITH {REJECTED} SELECT count(*) AS total, count(*) FILTER (match_status = 0) AS unmatched, count(*) FILTER (match_status = 1) AS matched, count(*) FILTER (match_status = 2) AS failed,
  coalesce(max(discovered_at), 0) AS last_crawl, (SELECT count(*) FROM rejected) AS rejected FROM catalog""", "catalog discoveries")
def stats_onepass(spark, d):
    return C.stats(view(spark, d, "catalog"), rejected(spark, d))


@query("SELECT info_hash, updated_at FROM catalog WHERE match_status = 1", "catalog")
def matched_oldest_first(spark, d):
    return C.matched_oldest_first(view(spark, d, "catalog")).select("info_hash", "updated_at")


@query()
def storage_size(spark, d):
    return C.storage_size(view(spark, d, "orders"))


@query("""SELECT k, CASE category WHEN 0 THEN 'movie' WHEN 1 THEN 'tv' WHEN 2 THEN 'anime' ELSE 'unknown' END AS category_name,
  CASE quality WHEN 1 THEN 'sd' WHEN 2 THEN 'hd' WHEN 3 THEN 'fhd' WHEN 4 THEN 'uhd' ELSE 'unknown' END AS quality_name FROM catalog""", "catalog")
def enum_decode(spark, d):
    return view(spark, d, "catalog").select("k", schema.category_name(F.col("category")).alias("category_name"), schema.quality_name(F.col("quality")).alias("quality_name"))


@query("""SELECT p_partkey, CASE p_type WHEN 'movies' THEN 0 WHEN 'television' THEN 1 ELSE 3 END AS code FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'movies' WHEN 1 THEN 'television' WHEN 2 THEN 'other' ELSE p_type END AS p_type FROM part)""")
def enum_encode(spark, d):
    word = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'Movies' WHEN 1 THEN 'Television' WHEN 2 THEN 'other' ELSE p_type END")
    return view(spark, d, "part").select("p_partkey", schema.encode(word, schema.R.CATEGORIES, schema.CATEGORY_ALIASES, "unknown").alias("code"))
