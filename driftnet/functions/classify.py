"""Category, junk and adult rules over names and file lists, as column expressions.

File lists are array<struct<path: string, size: bigint>>; null counts as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftnet.functions import names as N
from driftnet.functions import rules as R


@dataclass(frozen=True)
class Filters:
    """Which junk rules are on."""

    adult_patterns: bool = True
    junk_names: bool = True
    adult_names: bool = True


def is_anime(name: Column) -> Column:
    numbered = N.has(name, R.ANIME_EPISODE)
    return (N.contains_any(name, R.ANIME_KEYWORDS) & numbered) | (N.has(name, R.SUBGROUP) & numbered) | N.any_of(name, R.ANIME)


def is_tv(name: Column) -> Column:
    return N.any_of(name, R.TV) | N.contains_any(name, R.TV_KEYWORDS)


def signals(name: Column) -> Column:
    """N.parts and whether the name looks like anime, a show, a film (by the patterns alone), as one struct. A plan that asks several rules computes it
    once for each row, through N.once, and hands it to them as s; without s a rule computes what it needs."""
    s = N.parts(name)
    own = [s[c].alias(c) for c in ("numbers", "year", "resolution", "by_words", "subgroup", "imdb_id")]
    return F.struct(*own, is_anime(name).alias("anime"), N.any_of(name, R.TV).alias("tv"), N.any_of(name, R.MOVIE).alias("movie"))


def has_number(s: Column) -> Column:
    return (s["numbers"]["season"] != -1) | (s["numbers"]["episode"] != -1)


def year_and_quality(name: Column, s: Column) -> Column:
    return (s["year"] > 0) & (N.quality(name, s) != "unknown")


def is_movie(name: Column, s: Column | None = None) -> Column:
    if s is None:
        return N.let(signals(name), lambda own: is_movie(name, own))
    worded = N.contains_any(name, R.MOVIE_KEYWORDS) & (s["year"] > 0)
    return ~has_number(s) & (s["movie"] | worded | year_and_quality(name, s))


def media_signals(name: Column, s: Column | None = None) -> Column:
    if s is None:
        return N.let(signals(name), lambda own: media_signals(name, own))
    return year_and_quality(name, s) | has_number(s) | s["movie"] | s["tv"]


def is_adult(name: Column, s: Column | None = None) -> Column:
    anime = is_anime(name) if s is None else s["anime"]
    return (~anime & N.any_of(name, R.ADULT[:2])) | N.any_of(name, R.ADULT[2:])


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def file_sums(files: Column) -> Column:
    """One struct of sums over a file list: n_files, n_video, total, video, junk, audio, has_subtitles, n_episodes."""
    files = F.coalesce(files, F.array().cast("array<struct<path:string,size:bigint>>"))
    told = F.transform(files, lambda f: F.struct(extension(f["path"]).alias("extension"), f["path"].alias("path"), F.coalesce(f["size"], F.lit(0)).alias("size")))
    return N.let(told, sums_of)


def sums_of(files: Column) -> Column:
    """The sums of file_sums over files whose extensions are known."""
    of = lambda kind: F.filter(files, lambda f: f["extension"].isin(kind))
    add = lambda own: F.aggregate(own, F.lit(0).cast("long"), lambda a, f: a + f["size"])
    pick = lambda video: F.struct(
        F.size(files).alias("n_files"), F.size(video).alias("n_video"), add(files).alias("total"), add(video).alias("video"), add(of(R.JUNK_EXTENSIONS)).alias("junk"),
        add(of(R.AUDIO_EXTENSIONS)).alias("audio"), F.exists(files, lambda f: f["extension"].isin(R.SUBTITLE_EXTENSIONS)).alias("has_subtitles"),
        F.size(F.filter(video, lambda f: N.any_of(f["path"], R.EPISODE_FILE))).alias("n_episodes"),
    )
    return N.let(of(R.VIDEO_EXTENSIONS), pick)


def has_media_files(sums: Column) -> Column:
    """Video makes more than four fifths of all bytes."""
    return (sums["total"] > 0) & (sums["video"] / F.nullif(sums["total"], F.lit(0)) > 0.80)


def guess_from_files(sums: Column) -> Column:
    """Category by the number of videos, or null without confidence."""
    n, few = sums["n_video"], sums["n_video"].between(2, 5)
    tv = (few & (sums["n_episodes"] >= F.floor(n / 2))) | (n > 5)
    movie = (n == 1) | (few & (n / sums["n_files"] > 0.5))
    return F.when(n == 0, F.lit(None)).when(tv, "tv").when(movie, "movie")


def category(name: Column, sums: Column, s: Column | None = None) -> Column:
    if s is None:
        return N.let(signals(name), lambda own: category(name, sums, own))
    guess = F.when(F.coalesce(has_media_files(sums), F.lit(False)), guess_from_files(sums))
    return F.when(s["anime"], "anime").when(s["tv"] | N.contains_any(name, R.TV_KEYWORDS), "tv").when(is_movie(name, s), "movie").otherwise(F.coalesce(guess, F.lit("unknown")))


def adult_check_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(N.without_watermarks(name)), "._-~", "    "), r"\s+", " "))


def ngrams(text: Column, n: int) -> Column:
    words = F.filter(F.split(text, " "), lambda w: w != "")
    spots = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def is_adult_name(name: Column, performers: list[str], studios: list[str], keywords: list[str]) -> Column:
    """The whole name is a performer or studio, a word is a keyword, or two or three words make a performer."""
    low = adult_check_name(name)
    spelled = lambda words: F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    pairs = F.concat(ngrams(low, 2), ngrams(low, 3))
    return (low != "") & (low.isin(performers + studios) | F.arrays_overlap(ngrams(low, 1), spelled(keywords)) | F.arrays_overlap(pairs, spelled(performers)))


def junk_name(name: Column, s: Column | None = None) -> Column:
    return N.any_of(name, R.JUNK_NAME) & ~media_signals(name, s)


def junk_files(name: Column, sums: Column, s: Column | None = None) -> Column:
    total = sums["total"]
    silent = (sums["video"] == 0) & ((sums["audio"] == 0) | (~sums["has_subtitles"] & ~media_signals(name, s)))
    return (sums["n_files"] > 0) & (total > 0) & ((sums["junk"] / F.nullif(total, F.lit(0)) > 0.50) | silent)


def is_junk(name: Column, sums: Column, filters: Filters = Filters(), performers: list[str] = (), studios: list[str] = (), keywords: list[str] = (), s: Column | None = None) -> Column:
    if s is None:
        return N.let(signals(name), lambda own: is_junk(name, sums, filters, performers, studios, keywords, own))
    out = junk_files(name, sums, s)
    if filters.adult_patterns:
        out = out | is_adult(name, s)
    if filters.junk_names:
        out = out | junk_name(name, s)
    if filters.adult_names and (performers or studios or keywords):  # empty lists name nobody
        out = out | (~media_signals(name, s) & is_adult_name(name, list(performers), list(studios), list(keywords)))
    return F.coalesce(out, F.lit(False))
