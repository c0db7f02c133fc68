"""The derived catalog: the driver tables seen as a release catalog, in SQL that both Spark and DuckDB run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"]
EPOCH = {
    "spark": "CAST(unix_date(CAST({0} AS DATE)) AS BIGINT) * 86400 + hour({0}) * 3600 + minute({0}) * 60 + CAST(floor(second({0})) AS BIGINT)",
    "duckdb": "CAST(floor(epoch({0})) AS BIGINT)",
}

FILES = """SELECT l_orderkey AS k, l_linenumber AS file_no,
  concat('disc', cast(l_linenumber AS VARCHAR(9)), CASE l_partkey % 7 WHEN 0 THEN '.rar' WHEN 1 THEN '.mp4' WHEN 2 THEN '.flac' WHEN 3 THEN '.srt' WHEN 4 THEN '.nfo' ELSE '.mkv' END) AS path,
  cast(floor(l_extendedprice) AS BIGINT) * 1000 AS size FROM lineitem"""

CATALOG = """SELECT o.k AS k, sha1(cast(o.k AS VARCHAR(20))) AS info_hash,
  CASE o.k % 8
    WHEN 0 THEN concat(tt, '.', yr, '.', res, '.', src, '.', codec, '-GRP')
    WHEN 1 THEN concat(tt, '.S', lpad(cast(o.k % 12 + 1 AS VARCHAR(2)), 2, '0'), 'E', lpad(cast(o.k % 23 + 1 AS VARCHAR(2)), 2, '0'), '.', res, '.', src, '.', codec, '-GRP')
    WHEN 2 THEN concat('[SubGrp] ', p_name, ' - ', lpad(cast(o.k % 23 + 1 AS VARCHAR(2)), 2, '0'), ' [', res, '].mkv')
    WHEN 3 THEN concat(p_name, ' (', yr, ') ', res, ' ', src)
    WHEN 4 THEN concat(tt, '.Season.', cast(o.k % 9 + 1 AS VARCHAR(1)), '.', res, '.', src, '-GRP_tt', lpad(cast(p_partkey AS VARCHAR(7)), 7, '0'))
    WHEN 5 THEN concat(p_name, ' - Discography (320kbps) MP3')
    WHEN 6 THEN concat(p_name, ' v2.1 x64 setup keygen ')
    ELSE tt END AS name,
  coalesce(g.size, 0) AS size, coalesce(g.n_files, 0) AS n_files, cast(o.k % 4 AS INT) AS category, cast(o.k % 5 AS INT) AS quality,
  CASE WHEN o.k % 3 = 0 THEN NULL ELSE concat('tt', lpad(cast(p_partkey AS VARCHAR(7)), 7, '0')) END AS imdb_id,
  CASE WHEN o.k % 2 = 0 THEN NULL ELSE cast(p_partkey + 1 AS INT) END AS tmdb_id,
  CASE WHEN o.k % 5 = 0 THEN NULL ELSE cast(p_partkey % 50 + 1 AS INT) END AS tvdb_id,
  CASE WHEN o.k % 4 = 0 THEN NULL ELSE cast(1950 + o.k % 75 AS INT) END AS media_year,
  CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS match_status, pri AS match_attempts,
  cast(900000000 + o.k % 1000 AS BIGINT) AS match_after, cast(coalesce(q, 0) % 97 AS INT) AS seeders, cast(coalesce(q, 0) % 31 AS INT) AS leechers,
  {epoch} AS discovered_at, CASE WHEN o.k % 6 = 0 THEN NULL ELSE {epoch} + o.k % 97 END AS updated_at, cast(o.k % 2 AS INT) AS source
FROM (SELECT o_orderkey AS k, o_orderstatus, o_orderdate, p_partkey, p_name, cast(substr(o_orderpriority, 1, 1) AS INT) AS pri, replace(p_name, ' ', '.') AS tt,
    cast(1950 + o_orderkey % 75 AS VARCHAR(4)) AS yr,
    CASE o_orderkey % 5 WHEN 0 THEN '2160p' WHEN 1 THEN '1080p' WHEN 2 THEN '720p' WHEN 3 THEN '480p' ELSE 'SD' END AS res,
    CASE o_custkey % 5 WHEN 0 THEN 'BluRay' WHEN 1 THEN 'WEB-DL' WHEN 2 THEN 'WEBRip' WHEN 3 THEN 'HDTV' ELSE 'DVDRip' END AS src,
    CASE o_custkey % 4 WHEN 0 THEN 'x264' WHEN 1 THEN 'x265' WHEN 2 THEN 'AV1' ELSE 'XviD' END AS codec
  FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)) o
LEFT JOIN (SELECT l_orderkey AS k, cast(sum(cast(floor(l_extendedprice) AS BIGINT) * 1000) AS BIGINT) AS size, cast(floor(sum(l_quantity)) AS BIGINT) AS q, count(*) AS n_files
  FROM lineitem GROUP BY l_orderkey) g ON g.k = o.k"""

DISCOVERIES = """SELECT event_id, {epoch} AS seen_at, user_id AS node_id, event_type, value, sha1(cast(user_id * 37 % 211 AS VARCHAR(20))) AS info_hash, props FROM events"""


def text(name: str, engine: str) -> str:
    """A derived view's SQL for spark or duckdb."""
    return {"catalog": CATALOG.format(epoch=EPOCH[engine].format("o_orderdate")), "files": FILES, "discoveries": DISCOVERIES.format(epoch=EPOCH[engine].format("ts"))}[name]


def ctes(*names: str) -> str:
    """WITH-list entries of derived views for DuckDB."""
    return ", ".join(f"{n} AS MATERIALIZED ({text(n, 'duckdb')})" for n in names)


def views(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a driver table, as a DataFrame."""
    if name not in ("catalog", "files", "discoveries"):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    views(spark, sf_dir)
    return spark.sql(text(name, "spark"))
