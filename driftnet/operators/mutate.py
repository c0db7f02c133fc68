"""Mutations as DataFrame -> DataFrame: the new state of a table from the old one and a batch of changes.

Parquet has no MERGE, so a keyed change reads a snapshot and gives the next one; `publish` writes it to a new version and moves the pointer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftnet.operators.catalog import exclude, first_wins

DAY, YEAR = 86_400, 365 * 86_400


def valid_hash(column: str = "info_hash") -> Column:
    return F.coalesce(F.col(column).rlike(r"^[0-9a-f]{40}\z"), F.lit(False))


def checked(batch: DataFrame) -> DataFrame:
    """Fails the batch at the first hash that is not 40 hexadecimal digits."""
    ok = F.when(valid_hash(), F.col("info_hash")).otherwise(F.raise_error(F.lit("info_hash must be 20 bytes")))
    return batch.withColumn("info_hash", ok)


def upsert(rows: DataFrame, batch: DataFrame, order: list[Column], key: str = "info_hash", keep: list[str] = ()) -> DataFrame:
    """Whole rows replace rows of the same key, the last of a batch wins; columns in `keep` retain the old value of a known key.

    order sorts a batch from last to first. Untouched rows are never compared: they pass an anti join against the batch's keys.
    """
    last = first_wins(batch, [key], order)
    if keep:
        old = rows.select(key, *[F.col(c).alias(f"old_{c}") for c in keep])
        last = last.join(old, key, "left").withColumns({c: F.coalesce(f"old_{c}", c) for c in keep})
    return exclude(rows, last, key).unionByName(last.select(*rows.columns))


def delete(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return exclude(rows, keys)


def insert_ignore(rows: DataFrame, batch: DataFrame, at: str = "rejected_at", key: str = "info_hash") -> DataFrame:
    """Known keys keep their first time; new ones get the least of the batch."""
    new = exclude(batch, rows, key).groupBy(key).agg(F.min(at).alias(at))
    return rows.select(key, at).unionByName(new)


def update(rows: DataFrame, changes: DataFrame, columns: list[str], key: str = "info_hash", also: dict[str, Column] | None = None) -> DataFrame:
    """Overwrites columns of the keys in changes, nulls included; unknown keys change nothing. also: further columns of changed rows.

    changes has each key at most once.
    """
    new = changes.select(F.col(key), F.lit(True).alias("is_new"), *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = rows.join(new, key, "left")
    out = {c: F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in columns}
    out |= {c: F.when(F.col("is_new"), v).otherwise(F.col(c)) for c, v in (also or {}).items()}
    return joined.withColumns(out).select(*rows.columns)


def apply_match(rows: DataFrame, results: DataFrame, now: int) -> DataFrame:
    ids = ["imdb_id", "tmdb_id", "tvdb_id", "media_year", "match_status", "match_after"]
    own = [c for c in ids if c in results.columns and c in rows.columns]
    return update(rows, results, own, also={"match_attempts": F.col("match_attempts") + 1, "updated_at": F.lit(now).cast("long")})


def reset_failed(rows: DataFrame) -> DataFrame:
    failed = F.col("match_status") == 2
    return rows.withColumns({"match_status": F.when(failed, 0).otherwise(F.col("match_status")), "match_attempts": F.when(failed, 0).otherwise(F.col("match_attempts")), "match_after": F.when(failed, F.lit(0)).otherwise(F.col("match_after")).cast("long")})


def purge_rejects(rejected: DataFrame, now: int, days: int = 90) -> DataFrame:
    return rejected.filter(F.col("rejected_at") >= now - days * DAY)


def purge_junk_marked(rows: DataFrame, now: int, years: int = 50) -> DataFrame:
    return rows.filter(F.coalesce(F.col("match_after"), F.lit(0)) <= now + years * YEAR)


def merge_counters(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose seeders or leechers grow: info_hash and the greater values."""
    best = seen.groupBy("info_hash").agg(F.max("complete").alias("c"), F.max("incomplete").alias("i"))
    both = rows.select("info_hash", "seeders", "leechers").join(best, "info_hash")
    new = both.select("info_hash", F.greatest("seeders", "c", F.lit(0)).alias("new_seeders"), F.greatest("leechers", "i", F.lit(0)).alias("new_leechers"), "seeders", "leechers")
    return new.filter("new_seeders > seeders OR new_leechers > leechers").select("info_hash", F.col("new_seeders").alias("seeders"), F.col("new_leechers").alias("leechers"))


def publish(df: DataFrame, root: str) -> str:
    """Writes a new version below root (Parquet, zstd, sorted by time within files, with a bloom filter on the key) and returns its path."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    writer = df.sortWithinPartitions("discovered_at") if "discovered_at" in df.columns else df
    writer.write.option("compression", "zstd").option("parquet.bloom.filter.enabled#info_hash", "true").parquet(path)
    return path


def copy_all(rows: DataFrame, into: DataFrame) -> DataFrame:
    """A migration: every row of one table upserted into another, as a set."""
    return upsert(into, rows, [F.desc("discovered_at")])
