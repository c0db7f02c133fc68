"""The offline title index: two dumps merged, titles normalised, looked up with up to three words trimmed off the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftnet.functions import rules as R

# Prefixes of source links with the column of the id behind each.
ID_LINKS = [("https://anilist.co/anime/", "anilist_id"), ("https://kitsu.app/anime/", "kitsu_id"), ("https://kitsu.io/anime/", "kitsu_id"), ("https://myanimelist.net/anime/", "mal_id"), ("https://anidb.net/anime/", "anidb_id")]
DUMP = "data array<struct<sources: array<string>, title: string, synonyms: array<string>, animeSeason: struct<year: int>>>"
SHORT_WORD, SHORT_TRIM, TRIMS = 4, 8, 3


def normalize(title: Column) -> Column:
    t = F.lower(title)
    for pattern in R.ANIME_SPACED:
        t = F.regexp_replace(t, pattern, " ")
    t = F.trim(t)
    for pattern in R.ANIME_TAILS:
        t = F.regexp_replace(t, pattern + r"\z", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def admitted(norm: Column) -> Column:
    return (norm != "") & (norm.contains(" ") | (F.octet_length(norm) >= SHORT_WORD))


def candidates(norm: Column) -> Column:
    """The title and its beginnings with one to three words less, until one is a single short word."""
    words = F.split(norm, " ")
    cut = F.transform(F.sequence(F.lit(0), F.least(F.lit(TRIMS), F.size(words) - 1)), lambda i: F.array_join(F.slice(words, F.lit(1), F.size(words) - i), " "))
    short = lambda c: ~c.contains(" ") & (F.octet_length(c) < SHORT_TRIM)
    return F.filter(cut, lambda c, i: (norm != "") & ((i == 0) | ~short(c)))


def parse_dump(rows: DataFrame, column: str = "value") -> DataFrame:
    """anilist_id, kitsu_id, mal_id, anidb_id, titles, year of each entry of a JSON dump; the last link of a kind counts, ids from 1 up."""
    entry = rows.select(F.explode(F.from_json(column, DUMP)["data"]).alias("e"))
    ids = {}
    for name in dict.fromkeys(n for _, n in ID_LINKS):
        links = "^(?:" + "|".join(p.replace(".", r"\.") for p, n in ID_LINKS if n == name) + r")(\d+)\z"
        numbers = F.transform(F.coalesce("e.sources", F.array().cast("array<string>")), lambda s: F.regexp_extract(s, links, 1).try_cast("int"))  # noqa: B023
        found = F.filter(numbers, lambda i: i > 0)
        ids[name] = F.try_element_at(found, F.lit(-1))
    titles = F.filter(F.concat(F.array("e.title"), F.coalesce("e.synonyms", F.array().cast("array<string>"))), lambda t: t.isNotNull() & (t != ""))
    return entry.select(*[c.alias(n) for n, c in ids.items()], titles.alias("titles"), F.coalesce("e.animeSeason.year", F.lit(0)).alias("year"))


def parse_titles(lines: DataFrame, column: str = "value") -> DataFrame:
    """anidb_id, titles from lines id|type|lang|title; blank lines, comments, bad ids and empty titles are skipped."""
    line = F.trim(column)
    parts = F.split(line, r"\|", 4)
    rows = lines.filter((line != "") & ~line.startswith("#") & (F.size(parts) == 4)).select(parts[0].try_cast("int").alias("anidb_id"), F.trim(parts[3]).alias("title"))
    return rows.filter("anidb_id > 0 AND title != ''").groupBy("anidb_id").agg(F.sort_array(F.collect_list("title")).alias("titles"))


def merge_titles(entries: DataFrame, extra: DataFrame) -> DataFrame:
    """Entries with the titles of the second dump appended."""
    more = extra.select("anidb_id", F.col("titles").alias("more"))
    return entries.join(more, "anidb_id", "left").withColumn("titles", F.concat("titles", F.coalesce("more", F.array().cast("array<string>")))).drop("more")


def title_index(entries: DataFrame, entry_id: str, order: str) -> DataFrame:
    """norm, entry_id: the first entry, by order and place of the title, that has a normalised title."""
    titles = entries.select(F.col(entry_id).alias("entry_id"), F.col(order).alias("rank"), F.posexplode("titles").alias("pos", "title"))
    norm = titles.withColumn("norm", normalize(F.col("title"))).filter(admitted(F.col("norm")))
    return norm.groupBy("norm").agg(F.min_by("entry_id", F.struct("rank", "pos")).alias("entry_id"))


def lookup(rows: DataFrame, index: DataFrame, key: str, title: str) -> DataFrame:
    """key, entry_id for the rows whose title, or the longest trimmed beginning of it, is in the index."""
    tried = rows.select(key, F.posexplode(candidates(normalize(F.col(title)))).alias("rank", "norm"))
    return tried.join(index, "norm").groupBy(key).agg(F.min_by("entry_id", "rank").alias("entry_id"))
