"""Building of name and word lists from raw pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BYTES = 4


def normalize_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"\([^)]*\)", " "), r"\s+", " "))


def is_full_name(name: Column) -> Column:
    """At least four bytes, two words, and a word of two or more letters that is no initial."""
    words = F.filter(F.split(name, " "), lambda w: w != "")
    return (F.octet_length(name) >= LEAST_BYTES) & name.contains(" ") & F.exists(words, lambda w: F.length(F.regexp_replace(w, r"[^\p{L}]", "")) >= 2)


def names(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(normalize_name(F.col(column)).alias("name")).filter(is_full_name(F.col("name"))).distinct()


def words(rows: DataFrame, column: str, stop: DataFrame) -> DataFrame:
    """Trimmed lower-case words of at least four bytes that the stop list has not."""
    own = rows.select(F.lower(F.trim(column)).alias("word")).filter(F.octet_length("word") >= LEAST_BYTES).distinct()
    return own.join(stop.select(F.lower("word").alias("word")).distinct(), "word", "left_anti")
