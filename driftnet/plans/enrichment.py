"""Registered enrichment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftnet.functions import names as N
from driftnet.operators import enrich as E
from driftnet.plans import name_sql as Q
from driftnet.plans.registry import query
from driftnet.sources.derived import view

NOW = 900_000_500
NORM = "regexp_replace(lower({0}), '[^a-z0-9\\p{{L}}\\p{{N}}]+', '', 'g')"
SOURCE = f"src AS MATERIALIZED (SELECT {NORM.format('p_name')} AS norm, CAST(1950 + p_partkey % 75 AS INTEGER) AS year, min(CAST(p_partkey + 1 AS INTEGER)) AS id FROM part GROUP BY 1, 2)"
ROWS = f"rows AS MATERIALIZED (SELECT c_custkey, {NORM.format('p_name')} AS norm, CAST(1950 + c_custkey % 75 AS INTEGER) AS year FROM customer JOIN part ON p_partkey = c_custkey % 150)"


def source(spark, d):
    part = view(spark, d, "part").select(E.normalize_key(F.col("p_name")).alias("norm"), (1950 + F.col("p_partkey") % 75).cast("int").alias("year"), (F.col("p_partkey") + 1).cast("int").alias("id"))
    return part.groupBy("norm", "year").agg(F.min("id").alias("id"))


def rows(spark, d):
    customer, part = view(spark, d, "customer"), view(spark, d, "part")
    joined = customer.join(part, F.col("p_partkey") == F.col("c_custkey") % 150)
    return joined.select("c_custkey", E.normalize_key(F.col("p_name")).alias("norm"), (1950 + F.col("c_custkey") % 75).cast("int").alias("year"))


@query(f"WITH {SOURCE}, {ROWS}, loose AS (SELECT norm, min(id) AS id FROM src GROUP BY norm) SELECT c_custkey, coalesce(src.id, loose.id) AS id FROM rows LEFT JOIN src ON rows.norm = src.norm AND rows.year = src.year LEFT JOIN loose ON rows.norm = loose.norm")
def match_title_year(spark, d):
    return E.match_by_title(rows(spark, d), source(spark, d)).select("c_custkey", "id")


CACHE = "cache AS MATERIALIZED (SELECT concat('m:', norm, ':', year) AS key, CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS id, id % 3 = 0 AS is_negative, 900000000 + id % 1000 AS expires_at FROM src WHERE id % 2 = 0)"


def cache(spark, d):
    s = source(spark, d).filter("id % 2 = 0")
    return s.select(F.concat(F.lit("m:"), "norm", F.lit(":"), F.col("year").cast("string")).alias("key"), F.expr("CASE WHEN id % 3 = 0 THEN NULL ELSE id END").alias("id"), (F.col("id") % 3 == 0).alias("is_negative"), (900000000 + F.col("id") % 1000).cast("long").alias("expires_at"))


@query(f"""WITH {SOURCE}, {ROWS}, {CACHE}, alt AS (SELECT norm, min(id) AS id FROM src WHERE id % 5 = 0 GROUP BY norm),
j AS (SELECT c_custkey, cache.id AS c, is_negative, alt.id AS a, src.id AS s FROM rows LEFT JOIN cache ON cache.key = concat('m:', rows.norm, ':', rows.year) AND expires_at > {NOW} LEFT JOIN alt ON alt.norm = rows.norm LEFT JOIN src ON src.norm = rows.norm AND src.year = rows.year)
SELECT c_custkey, CASE WHEN is_negative THEN NULL ELSE coalesce(c, a, s) END AS found, CASE WHEN is_negative THEN 'negative' WHEN c IS NOT NULL THEN 'cache' WHEN a IS NOT NULL THEN 'alternative' WHEN s IS NOT NULL THEN 'source' ELSE 'none' END AS origin FROM j""")
def cache_cascade(spark, d):
    keyed = rows(spark, d).withColumn("key", F.concat(F.lit("m:"), "norm", F.lit(":"), F.col("year").cast("string")))
    alt = source(spark, d).filter("id % 5 = 0").groupBy("norm").agg(F.min("id").alias("id"))
    return E.cached_lookup(keyed, cache(spark, d), alt, source(spark, d), NOW).select("c_custkey", "found", "origin")


@query(f"""WITH {SOURCE}, {CACHE}, n AS (SELECT concat('m:', norm, ':', year) AS key, CASE WHEN id % 4 = 0 THEN id END AS id FROM src WHERE id % 7 = 0)
SELECT key, id, is_negative, expires_at FROM cache WHERE expires_at > {NOW} AND key NOT IN (SELECT key FROM n) UNION ALL SELECT key, id, id IS NULL, {NOW} + CASE WHEN id IS NULL THEN 21600 ELSE 86400 END FROM n""")
def cache_write(spark, d):
    new = source(spark, d).filter("id % 7 = 0").select(F.concat(F.lit("m:"), "norm", F.lit(":"), F.col("year").cast("string")).alias("key"), F.expr("CASE WHEN id % 4 = 0 THEN id END").alias("id"))
    return E.write_cache(cache(spark, d), new, NOW)


@query(f"WITH {SOURCE}, {CACHE} SELECT key, id, is_negative, CASE WHEN NOT is_negative AND id % 5 = 0 THEN {NOW} + 86400 ELSE expires_at END AS expires_at FROM cache WHERE expires_at > {NOW}")
def cache_touch(spark, d):
    c = cache(spark, d)
    return E.touch(c, c.filter("id % 5 = 0"), NOW)


@query(f"WITH t AS (SELECT CAST(p_partkey AS INTEGER) AS id, p_size AS year, unnest([p_name, p_brand, '--']) AS title FROM part), n AS (SELECT *, {NORM.format('title')} AS norm FROM t) SELECT norm, min(id) AS id, arg_min(year, id) AS year FROM n WHERE norm != '' GROUP BY norm")
def reverse_titles(spark, d):
    entries = view(spark, d, "part").select(F.col("p_partkey").cast("int").alias("id"), F.col("p_size").alias("year"), F.array("p_name", "p_brand", F.lit("--")).alias("titles"))
    return E.reverse_titles(entries, [F.asc("id"), F.asc("title")])


@query(f"SELECT p_partkey, concat('movie:', {NORM.format('p_name')}, ':', p_size) AS key FROM part")
def cache_keys(spark, d):
    return view(spark, d, "part").select("p_partkey", E.cache_key("movie:", F.col("p_name"), F.col("p_size")).alias("key"))


@query("SELECT k, CASE WHEN k % 6 - 1 < 0 THEN 0 WHEN k % 6 - 1 = 0 THEN 1 WHEN k % 6 - 1 = 1 THEN 6 ELSE 24 END AS hours FROM catalog", "catalog")
def backoff(spark, d):
    return view(spark, d, "catalog").select("k", E.backoff_hours(F.col("k") % 6 - 1).alias("hours"))


@query("SELECT k, CASE WHEN k >= 5000 THEN 35 WHEN k >= 1000 THEN 20 WHEN k >= 100 THEN 10 ELSE 4 END AS rate, CASE WHEN k >= 5000 THEN 10 WHEN k >= 1000 THEN 6 WHEN k >= 100 THEN 4 ELSE 1 END AS workers, least(greatest(CASE WHEN k >= 5000 THEN 175 WHEN k >= 1000 THEN 100 WHEN k >= 100 THEN 50 ELSE 20 END, 1), 100) AS fetch FROM catalog", "catalog")
def scale_tiers(spark, d):
    rate = E.tier(F.col("k"), 1)
    return view(spark, d, "catalog").select("k", rate.alias("rate"), E.tier(F.col("k"), 3).alias("workers"), E.fetch_size(rate, 10, 100).alias("fetch"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1950 + p_size ELSE 0 END AS year FROM part")
def year_of_date(spark, d):
    date = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(1950 + p_size, '-01-02') WHEN 1 THEN '19' ELSE 'n/a--' END")
    return view(spark, d, "part").select("p_partkey", E.year_of(date).alias("year"))


@query(f"""WITH slim AS (SELECT k, info_hash, name, category, coalesce(match_attempts, 0) AS match_attempts FROM catalog WHERE match_status IN (0, 2) AND match_after < {NOW} AND match_attempts < 4), {Q.parsed_cte('slim')}, {SOURCE},
loose AS (SELECT norm, min(id) AS id FROM src GROUP BY norm), sh AS (SELECT norm, year, id + 1000000 AS id FROM src WHERE id % 2 = 0), shl AS (SELECT norm, min(id) AS id FROM sh GROUP BY norm),
an AS (SELECT norm, min(id) + 2000000 AS id FROM src WHERE id % 10 = 0 GROUP BY norm), im AS (SELECT concat('tt', lpad(CAST(p_partkey AS VARCHAR), 7, '0')) AS imdb, CAST(p_partkey + 1 AS INTEGER) AS id FROM part WHERE p_partkey % 2 = 0),
q AS (SELECT parsed.*, {NORM.format('title')} AS norm FROM parsed),
j AS (SELECT q.*, im.id AS i, coalesce(src.id, loose.id) AS m, coalesce(sh.id, shl.id) AS t, an.id AS a, CASE WHEN q.category = 3 AND an.id IS NOT NULL THEN 2 ELSE q.category END AS cat FROM q LEFT JOIN im ON im.imdb = q.name_imdb LEFT JOIN src ON src.norm = q.norm AND src.year = q.year
  LEFT JOIN loose ON loose.norm = q.norm LEFT JOIN sh ON sh.norm = q.norm AND sh.year = q.year LEFT JOIN shl ON shl.norm = q.norm LEFT JOIN an ON an.norm = q.norm),
f AS (SELECT *, coalesce(i, CASE cat WHEN 0 THEN m WHEN 1 THEN t WHEN 2 THEN coalesce(a, t) ELSE coalesce(m, t) END) AS found FROM j)
SELECT info_hash, CASE WHEN found IS NULL THEN 3 ELSE cat END AS category, CAST(found AS INTEGER) AS tmdb_id, CASE WHEN found IS NOT NULL THEN coalesce(nullif(name_imdb, ''), CASE WHEN found <= 1000000 THEN concat('tt', lpad(CAST(found - 1 AS VARCHAR), 7, '0')) END) END AS imdb_id, CASE WHEN found IS NULL THEN 2 ELSE 1 END AS match_status,
  match_attempts + 1 AS match_attempts, CAST(CASE WHEN found IS NOT NULL THEN 0 ELSE {NOW} + 3600 * CASE WHEN match_attempts < 0 THEN 0 WHEN match_attempts = 0 THEN 1 WHEN match_attempts = 1 THEN 6 ELSE 24 END END AS BIGINT) AS match_after FROM f""", "catalog")
def enrichment_batch(spark, d):
    """The whole enrichment of a queue in one plan."""
    due = view(spark, d, "catalog").filter(f"match_status IN (0, 2) AND match_after < {NOW} AND match_attempts < 4")
    s = F.col("s")
    parsed = due.select("*", N.once(N.parts(F.col("name"))).alias("s"))
    queue = parsed.select("info_hash", "category", s["imdb_id"].alias("imdb"), N.once(N.title(F.col("name"), s)).alias("title"), s["year"].alias("year"), F.col("match_attempts").alias("attempts"))
    movies = source(spark, d)
    shows = movies.filter("id % 2 = 0").withColumn("id", F.col("id") + 1000000)
    anime = movies.filter("id % 10 = 0").groupBy("norm").agg((F.min("id") + 2000000).alias("id"))
    part = view(spark, d, "part").select(F.concat(F.lit("tt"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("imdb"), (F.col("p_partkey") + 1).cast("int").alias("id"), "p_partkey")
    by_imdb = part.filter("p_partkey % 2 = 0").select("imdb", F.col("id").alias("movie_id"), F.lit(None).cast("int").alias("tv_id"))
    ext = part.select("id", F.col("imdb").alias("imdb_id"))
    return E.enrich(queue, by_imdb, movies, shows, anime, ext, NOW)


@query("SELECT r_regionkey AS id, title FROM (SELECT r_regionkey, unnest(['a', concat('b', r_regionkey)]) AS title FROM region) WHERE r_regionkey % 2 = 0 UNION ALL SELECT r_regionkey, 'c' FROM region WHERE r_regionkey % 2 = 1")
def alternative_titles(spark, d):
    """Titles of API answers: `titles`, else `results`, each title or name, empty ones dropped."""
    body = F.expr("""CASE WHEN r_regionkey % 2 = 0 THEN concat('{"titles":[{"title":"a"},{"title":""},{"name":"b', r_regionkey, '"}]}') ELSE '{"results":[{"title":"c"}]}' END""")
    kind = "titles array<struct<title: string, name: string>>, results array<struct<title: string, name: string>>"
    rows = view(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.from_json(body, kind).alias("j"))
    each = rows.select("id", F.explode(F.coalesce("j.titles", "j.results")).alias("t"))
    return each.select("id", F.coalesce(F.nullif("t.title", F.lit("")), "t.name").alias("title")).filter("title != ''")
