"""Enrichment as a cascade of joins: look-up tables stand for the external catalogs, cached answers go before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftnet.operators.catalog import first_wins

HIT_SECONDS, MISS_SECONDS = 24 * 3600, 6 * 3600
#: Hours to wait after the first, second and any further failure.
BACKOFF_HOURS = [1, 6, 24]
#: Backlog from which a tier holds: requests a second, burst, workers.
TIERS = [(5000, 35, 35, 10), (1000, 20, 20, 6), (100, 10, 10, 4), (0, 4, 4, 1)]


def normalize_key(title: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(title), r"[^a-z0-9\p{L}\p{N}]+", "")


def cache_key(prefix: str, title: Column, year: Column) -> Column:
    return F.concat(F.lit(prefix), normalize_key(title), F.lit(":"), F.coalesce(year, F.lit(0)).cast("string"))


def backoff_hours(attempts: Column) -> Column:
    out = F.when(attempts < 0, 0)
    for k, h in enumerate(BACKOFF_HOURS[:-1]):
        out = out.when(attempts == k, h)
    return out.otherwise(BACKOFF_HOURS[-1])


def tier(backlog: Column, place: int) -> Column:
    """Of the tier of a backlog: requests a second (1), burst (2) or workers (3)."""
    out = None
    for t in TIERS:
        out = F.when(backlog >= t[0], t[place]) if out is None else out.when(backlog >= t[0], t[place])
    return out.otherwise(TIERS[-1][place])


def fetch_size(rate: Column, seconds: int, batch: int) -> Column:
    return F.least(F.greatest(F.floor(rate * seconds / 2), F.lit(1)), F.lit(batch)).cast("int")


def year_of(date: Column) -> Column:
    """The first four characters as a number; shorter or other text gives 0."""
    return F.when(F.length(date) >= 4, F.coalesce(F.substring(date, 1, 4).try_cast("int"), F.lit(0))).otherwise(0)


def live(cache: DataFrame, now: int) -> DataFrame:
    return cache.filter(F.col("expires_at") > now)


def cached_lookup(rows: DataFrame, cache: DataFrame, alternatives: DataFrame, source: DataFrame, now: int) -> DataFrame:
    """rows with found and origin: a live cached answer, else an alternative title, else the source.

    rows: key, norm, year. cache: key, id, is_negative, expires_at, one row a key. alternatives: norm, id; source: norm, year, id. A negative answer
    ends the search before the alternatives are asked.
    """
    hit = live(cache, now).select("key", F.col("id").alias("cached"), "is_negative")
    alt = alternatives.select("norm", F.col("id").alias("alternative"))
    src = source.select("norm", "year", F.col("id").alias("fetched"))
    all_three = rows.join(hit, "key", "left").join(alt, "norm", "left").join(src, ["norm", "year"], "left")
    negative = F.coalesce("is_negative", F.lit(False))
    origin = F.when(negative, "negative").when(F.col("cached").isNotNull(), "cache").when(F.col("alternative").isNotNull(), "alternative").when(F.col("fetched").isNotNull(), "source").otherwise("none")
    found = F.when(~negative, F.coalesce("cached", "alternative", "fetched"))
    return all_three.select(*rows.columns, found.alias("found"), origin.alias("origin"))


def write_cache(cache: DataFrame, answers: DataFrame, now: int) -> DataFrame:
    """The cache after answers (key, id or null): hits live a day, misses six hours, and a live positive entry that is not answered anew stays."""
    life = F.when(F.col("id").isNull(), MISS_SECONDS).otherwise(HIT_SECONDS)
    new = answers.select("key", "id", F.col("id").isNull().alias("is_negative"), (F.lit(now) + life).cast("long").alias("expires_at"))
    return live(cache, now).join(new.select("key"), "key", "left_anti").select("key", "id", "is_negative", "expires_at").unionByName(new)


def touch(cache: DataFrame, used: DataFrame, now: int) -> DataFrame:
    """Live positive entries that were used live for another day."""
    keys = used.select("key").distinct().withColumn("was_used", F.lit(True))
    renewed = F.when(F.col("was_used") & ~F.col("is_negative"), F.lit(now + HIT_SECONDS).cast("long")).otherwise(F.col("expires_at"))
    return live(cache, now).join(keys, "key", "left").withColumn("expires_at", renewed).drop("was_used")


def reverse_titles(entries: DataFrame, order: list[Column]) -> DataFrame:
    """norm, id, year for every distinct non-empty normalised title; the first entry in the order has it. entries: id, year, titles."""
    each = entries.select("id", "year", F.explode("titles").alias("title")).withColumn("norm", normalize_key(F.col("title"))).filter("norm != ''")
    return first_wins(each, ["norm"], order).select("norm", "id", "year")


def match_by_title(queue: DataFrame, source: DataFrame) -> DataFrame:
    """queue with id: by title and year, else by title alone (the least id). queue: norm, year."""
    exact = source.select("norm", "year", F.col("id").alias("by_year"))
    loose = source.groupBy("norm").agg(F.min("id").alias("by_title"))
    return queue.join(exact, ["norm", "year"], "left").join(loose, "norm", "left").withColumn("id", F.coalesce("by_year", "by_title")).drop("by_year", "by_title")


def enrich(queue: DataFrame, by_imdb: DataFrame, movies: DataFrame, shows: DataFrame, anime: DataFrame, ext_ids: DataFrame, now: int) -> DataFrame:
    """Match results for a queue of parsed rows (info_hash, category, imdb, title, year, attempts).

    By imdb id first; unknown rows in the anime index become anime; else by category, unknown ones as movie, then as show.
    A failure turns the category to unknown (3) and waits by the number of attempts.
    """
    rows = queue.withColumn("norm", normalize_key(F.col("title")))
    ids = by_imdb.groupBy("imdb").agg(F.coalesce(F.min("movie_id"), F.min("tv_id")).alias("found_by_imdb"))
    titled = lambda queue, source, name: match_by_title(queue, source).withColumnRenamed("id", name)
    both = titled(titled(rows.join(ids, "imdb", "left"), movies, "movie_id"), shows, "tv_id").join(anime.select("norm", F.col("id").alias("anime_id")), "norm", "left")
    category = F.when((F.col("category") == 3) & F.col("anime_id").isNotNull(), 2).otherwise(F.col("category"))
    by_category = F.when(category == 0, F.col("movie_id")).when(category == 1, F.col("tv_id")).when(category == 2, F.coalesce("anime_id", "tv_id")).otherwise(F.coalesce("movie_id", "tv_id"))
    found = F.coalesce("found_by_imdb", by_category)
    expanded = both.withColumns({"found": found, "new_category": category}).join(ext_ids.select(F.col("id").alias("found"), F.col("imdb_id").alias("ext_imdb")), "found", "left")
    ok = F.col("found").isNotNull()
    wait = backoff_hours(F.col("attempts")) * 3600
    return expanded.select(
        "info_hash", F.when(ok, F.col("new_category")).otherwise(3).alias("category"), F.col("found").alias("tmdb_id"), F.when(ok, F.coalesce(F.nullif("imdb", F.lit("")), "ext_imdb")).alias("imdb_id"),
        F.when(ok, 1).otherwise(2).alias("match_status"), (F.col("attempts") + 1).alias("match_attempts"), F.when(ok, F.lit(0)).otherwise(F.lit(now) + wait).cast("long").alias("match_after"),
    )
