"""Reads of the catalog: look-ups, filters, pages, counts. Each takes and returns DataFrames; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: External ids that may be searched, with the column of each.
EXTERNAL_IDS = {"imdb": "imdb_id", "tmdb": "tmdb_id", "tvdb": "tvdb_id", "anilist": "anilist_id", "kitsu": "kitsu_id"}
API_COLUMNS = ["info_hash", "name", "size", "category", "quality", "imdb_id", "tmdb_id", "tvdb_id", "media_year", "seeders", "leechers", "discovered_at"]


def total_order(column: str) -> list[Column]:
    """Newest first, ties by key."""
    return [F.desc(column), F.asc("info_hash")]


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Deals rows by a key over as many tasks as a shuffle has, and at least one a core: parsing a name costs far more than moving it, and neither small
    files nor adaptive coalescing, which go by bytes, may leave it to a few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def with_defaults(rows: DataFrame) -> DataFrame:
    """Null sizes and update times read as 0."""
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("size", "updated_at") if c in rows.columns})


def clamp(limit: int, default: int, most: int = 1000) -> int:
    return default if limit <= 0 else min(limit, most)


def by_hash(rows: DataFrame, info_hash: str) -> DataFrame:
    return rows.filter(F.col("info_hash") == info_hash.lower()).limit(1)


def by_hashes(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose info_hash is among keys."""
    return rows.join(keys.select("info_hash").distinct(), "info_hash", "left_semi")


def by_hashes_in_order(rows: DataFrame, keys: Iterable[str], spark) -> DataFrame:
    """One row for each key that exists, in the order of the request, repeated keys repeated; column pos is the place."""
    asked = spark.createDataFrame([(k, h.lower()) for k, h in enumerate(keys)], "pos int, info_hash string")
    return asked.join(rows, "info_hash").orderBy("pos")


def select_by(rows: DataFrame, categories: Iterable[int] = (), qualities: Iterable[int] = (), min_year: int = 0, max_year: int = 0) -> DataFrame:
    """All given filters hold; empty sets and years of 0 filter nothing; a null year fails a year filter."""
    categories, qualities = list(categories), list(qualities)
    rows = rows.filter(F.col("category").isin(categories)) if categories else rows
    rows = rows.filter(F.col("quality").isin(qualities)) if qualities else rows
    rows = rows.filter(F.col("media_year") >= min_year) if min_year > 0 else rows
    return rows.filter(F.col("media_year") <= max_year) if max_year > 0 else rows


def by_external_id(rows: DataFrame, kind: str, value: str) -> DataFrame:
    column = EXTERNAL_IDS[kind]
    return rows.filter(F.col(column) == F.lit(value).try_cast(dict(rows.dtypes)[column]))


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page with the total of all rows beside each; the total is a second, narrow aggregate over the same rows."""
    every = rows.agg(F.count("*").alias("total"))  # one row
    return rows.orderBy(*order).offset(max(offset, 0)).limit(limit).crossJoin(F.broadcast(every))


def recent(rows: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
    return page(rows, total_order("discovered_at"), clamp(limit, 50), offset)


def with_status(rows: DataFrame, status: int, limit: int = 0, offset: int = 0) -> DataFrame:
    return page(rows.filter(F.col("match_status") == status), total_order("updated_at"), clamp(limit, 20), offset)


def recently_updated(rows: DataFrame, limit: int = 0) -> DataFrame:
    return rows.filter("updated_at > 0 AND match_status = 1").orderBy(*total_order("updated_at")).limit(clamp(limit, 20, 200))


def match_queue(rows: DataFrame, as_of: int, limit: int = 0, most_attempts: int = 4) -> DataFrame:
    due = rows.filter(F.col("match_status").isin(0, 2) & (F.col("match_after") < as_of) & (F.col("match_attempts") < most_attempts))
    return due.orderBy(*total_order("discovered_at")).limit(limit if limit > 0 else 100)


def keyset_page(rows: DataFrame, after_time: int, after_hash: str, limit: int) -> DataFrame:
    a, b = F.col("discovered_at"), F.col("info_hash")
    return rows.filter((a > after_time) | ((a == after_time) & (b > after_hash))).orderBy(a, b).limit(limit)


def matched_oldest_first(rows: DataFrame) -> DataFrame:
    return rows.filter("match_status = 1").orderBy(F.asc("updated_at"), F.asc("info_hash"))


def stats(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """All counts in one pass over each table."""
    own = rows.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("match_status") == k).alias(n) for k, n in enumerate(("unmatched", "matched", "failed"))], F.coalesce(F.max("discovered_at"), F.lit(0)).alias("last_crawl")
    )
    return own.crossJoin(rejected.agg(F.count("*").alias("rejected")))


def storage_size(rows: DataFrame) -> DataFrame:
    """Bytes of the files that a table is read from."""
    files = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).distinct()
    return files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def exclude(rows: DataFrame, gone: DataFrame, key: str = "info_hash") -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def first_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the order; the order should be total."""
    return rows.withColumn("own_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("own_place = 1").drop("own_place")
