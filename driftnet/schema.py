"""Schemas of the catalog tables, enumerations at rest and at the edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftnet.functions import rules as R

FILES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType())]))
TORRENTS = T.StructType(
    [T.StructField("info_hash", T.StringType(), False), T.StructField("name", T.StringType()), T.StructField("size", T.LongType())]
    + [T.StructField(n, T.IntegerType()) for n in ("category", "quality")]
    + [T.StructField("files", FILES), T.StructField("imdb_id", T.StringType())]
    + [T.StructField(n, T.IntegerType()) for n in ("tmdb_id", "tvdb_id", "anilist_id", "kitsu_id", "media_year", "match_status", "match_attempts")]
    + [T.StructField("match_after", T.LongType())]
    + [T.StructField(n, T.IntegerType()) for n in ("seeders", "leechers", "source")]
    + [T.StructField("discovered_at", T.LongType()), T.StructField("updated_at", T.LongType())]
)
REJECTED = "info_hash string, rejected_at long"
SETTINGS = "key string, value string"
#: Spellings that parse to a value besides the value itself.
CATEGORY_ALIASES = {"movies": "movie", "television": "tv", "other": "unknown"}
QUALITY_ALIASES = {"480p": "sd", "480i": "sd", "720p": "hd", "1080p": "fhd", "1080i": "fhd", "4k": "uhd", "2160p": "uhd"}


def encode(value: Column, values: list[str], aliases: dict[str, str] | None = None, default: str | None = None) -> Column:
    """The ordinal of a value or alias, without regard to case; the default's ordinal for anything else."""
    low, out = F.lower(F.trim(value)), None
    for word, target in [*((v, v) for v in values), *(aliases or {}).items()]:
        out = F.when(low == word, values.index(target)) if out is None else out.when(low == word, values.index(target))
    return out.otherwise(values.index(default or values[0])).cast("int")


def decode(ordinal: Column, values: list[str], default: str | None = None) -> Column:
    out = None
    for k, v in enumerate(values):
        out = F.when(ordinal == k, v) if out is None else out.when(ordinal == k, v)
    return out.otherwise(default or values[0])


def category_name(ordinal: Column) -> Column:
    return decode(ordinal, R.CATEGORIES, "unknown")


def quality_name(ordinal: Column) -> Column:
    return decode(ordinal, R.QUALITIES, "unknown")
