"""Full-text search over names: folded word tokens, the last query token as a prefix, scans and an inverted index."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Latin letters with one mark that fold to their base; the folding of any other letter is left to the collation.
FOLDED = "".join(c for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in FOLDED)


def fold(text: Column) -> Column:
    """Lower case without accents, in built-in expressions."""
    return F.regexp_replace(F.lower(F.translate(text, FOLDED, PLAIN)), r"\p{Mn}+", "")


def tokens(text: Column) -> Column:
    """Words of a text: runs of letters and digits, folded."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def query_tokens(query: str) -> list[str]:
    """The words of a query, folded like the words of names."""
    plain = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if unicodedata.category(c) != "Mn")
    return re.findall(r"[^\W_]+", plain)


def matches(words: Column, query: list[str]) -> Column:
    """Every token but the last equals a word, the last begins one; an empty query matches nothing."""
    if not query:
        return F.lit(False)
    out = F.exists(words, lambda w: w.startswith(query[-1]))
    for t in query[:-1]:
        out = out & F.array_contains(words, t)
    return out


def search(rows: DataFrame, query: str, column: str = "name") -> DataFrame:
    """Rows that match, by a scan."""
    return rows.filter(matches(tokens(F.col(column)), query_tokens(query)))


def inverted_index(rows: DataFrame, key: str = "info_hash", column: str = "name") -> DataFrame:
    """token, key: one row for each distinct word of a row. Write it bucketed or sorted by token to prune reads."""
    return rows.select(F.explode(F.array_distinct(tokens(F.col(column)))).alias("token"), key)


def search_index(index: DataFrame, query: str, key: str = "info_hash") -> DataFrame:
    """Keys that match, from the index alone: one pass counts the query tokens that a key has."""
    words = query_tokens(query)
    if not words:
        return index.select(key).limit(0)
    full, last = sorted(set(words[:-1])), words[-1]
    hit = F.col("token").startswith(last)
    own = index.filter(hit | F.col("token").isin(full)) if full else index.filter(hit)
    n_full = F.count_if(F.col("token").isin(full)) if full else F.lit(0)
    return own.groupBy(key).agg(n_full.alias("n_full"), F.count_if(hit).alias("n_last")).filter((F.col("n_full") == len(full)) & (F.col("n_last") > 0)).select(key)
