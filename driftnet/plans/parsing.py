"""Registered parsing, classification and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftnet.functions import classify as K
from driftnet.functions import names as N
from driftnet.operators.catalog import spread
from driftnet.plans import name_sql as Q
from driftnet.plans.registry import query
from driftnet.sources.derived import view

PARSED = Q.parsed_cte("catalog")
SUMS = Q.file_sums_cte("files")
ROWS = """rows AS MATERIALIZED (SELECT parsed.*, coalesce(n_files_1, 0) AS n_files_all, coalesce(f.n_files, 0) AS nf, f.* EXCLUDE (k, n_files) FROM parsed LEFT JOIN (SELECT *, n_files AS n_files_1 FROM sums) f ON f.k = parsed.k)"""
#: A wider set of names: catalog names, and document beginnings with tags put on.
PERFORMERS, STUDIOS, KEYWORDS = ["small ring", "green tin ring"], ["large box"], ["steel"]


def names(spark, d):
    return spread(view(spark, d, "catalog").select("k", "name"), "k")


def one(column, give):
    """Rules that read other parts of the name get them as a column, computed once for each row."""

    def run(spark, d):
        n = F.col("name")
        if give not in STAGED:
            return names(spark, d).select("k", give(n).alias(column))
        return names(spark, d).select("k", "name", N.once(STAGED[give](n)).alias("s")).select("k", give(n, F.col("s")).alias(column))

    return run


STAGED = {N.title: N.parts, N.quality: N.parts, K.is_movie: K.signals, K.media_signals: K.signals, K.is_adult: K.signals}


SIMPLE = {
    "parse_season": ("season", lambda n: N.season_episode(n)["season"], "season"), "parse_episode": ("episode", lambda n: N.season_episode(n)["episode"], "episode"),
    "parse_year": ("year", N.year, "year"), "parse_resolution": ("resolution", N.resolution, "resolution"), "parse_source": ("source", N.source, "source"),
    "parse_codec": ("codec", N.codec, "codec"), "parse_audio": ("audio", N.audio, "audio"), "parse_hdr": ("hdr", N.hdr, "hdr"), "parse_subgroup": ("subgroup", N.subgroup, "subgroup"),
    "parse_imdb_id": ("imdb", N.imdb_id, "name_imdb"), "parse_quality": ("quality", N.quality, "name_quality"), "parse_group": ("release_group", N.release_group, "release_group"),
    "parse_title": ("title", N.title, "title"), "quality_by_words": ("quality", N.quality_by_words, Q.quality_words("name")), "classify_is_anime": ("flag", K.is_anime, Q.anime()),
    "classify_is_tv": ("flag", K.is_tv, Q.tv()), "classify_is_movie": ("flag", K.is_movie, Q.movie()), "media_signals": ("flag", K.media_signals, Q.signals()), "adult_patterns": ("flag", K.is_adult, Q.adult()),
}
for _name, (_column, _give, _sql) in SIMPLE.items():
    _f = one(_column, _give)
    _f.__name__ = _name
    query(f"WITH slim AS (SELECT k, name FROM catalog), {Q.parsed_cte('slim')} SELECT k, {_sql} AS {_column} FROM parsed", "catalog")(_f)


@query(f"WITH slim AS (SELECT k, name FROM catalog), {Q.parsed_cte('slim')} SELECT k, is_remux, is_bluray, is_webdl, is_webrip FROM parsed", "catalog")
def parse_flags(spark, d):
    return names(spark, d).select("k", *[c.alias(n) for n, c in N.flags(F.col("name")).items()])


def filed(spark, d):
    """Catalog names with their file lists."""
    files = view(spark, d, "files").groupBy("k").agg(F.collect_list(F.struct("path", "size")).alias("files"))
    return names(spark, d).join(files, "k", "left").select("k", "name", N.once(K.file_sums(F.col("files"))).alias("sums"))


def signalled(spark, d):
    return filed(spark, d).select("*", N.once(K.signals(F.col("name"))).alias("s"))


FILED = f"WITH slim AS (SELECT k, name FROM catalog), {Q.parsed_cte('slim')}, {SUMS}, filed AS MATERIALIZED (SELECT parsed.*, coalesce(n_files, 0) AS n_files, coalesce(n_video, 0) AS n_video, coalesce(total, 0) AS total, coalesce(video, 0) AS video, coalesce(junk, 0) AS junk, coalesce(audio_size, 0) AS audio_size, coalesce(has_subtitles, FALSE) AS has_subtitles, coalesce(n_episodes, 0) AS n_episodes FROM parsed LEFT JOIN sums USING (k))"


@query(f"{FILED} SELECT k, n_files, n_video, total, video, junk, audio_size AS audio, has_subtitles, n_episodes FROM filed", "catalog files")
def file_sums(spark, d):
    return filed(spark, d).select("k", "sums.*")


@query(f"{FILED} SELECT k, total > 0 AND coalesce(video / total > 0.80, FALSE) AS flag FROM filed", "catalog files")
def files_media_share(spark, d):
    return filed(spark, d).select("k", F.coalesce(K.has_media_files(F.col("sums")), F.lit(False)).alias("flag"))


@query(f"{FILED} SELECT k, {Q.category()} AS category FROM filed", "catalog files")
def classify_category(spark, d):
    return signalled(spark, d).select("k", K.category(F.col("name"), F.col("sums"), F.col("s")).alias("category"))


@query(f"{FILED} SELECT k, {Q.junk_files()} AS by_files, {Q.any_of('name', Q.R.JUNK_NAME)} AND NOT {Q.signals()} AS by_name, {Q.adult()} OR ({Q.any_of('name', Q.R.JUNK_NAME)} AND NOT {Q.signals()}) OR {Q.junk_files()} AS junk FROM filed", "catalog files")
def junk_verdict(spark, d):
    n, sums, s = F.col("name"), F.col("sums"), F.col("s")
    return signalled(spark, d).select("k", F.coalesce(K.junk_files(n, sums, s), F.lit(False)).alias("by_files"), K.junk_name(n, s).alias("by_name"), K.is_junk(n, sums, s=s).alias("junk"))


@query(f"{FILED} SELECT k, {Q.junk_files()} AS files_only, {Q.adult()} OR {Q.junk_files()} AS adult_only, ({Q.any_of('name', Q.R.JUNK_NAME)} AND NOT {Q.signals()}) OR {Q.junk_files()} AS names_only FROM filed", "catalog files")
def junk_toggles(spark, d):
    """Verdicts with all rules off, and with one of them on."""
    n, sums, s = F.col("name"), F.col("sums"), F.col("s")
    given = {"files_only": K.Filters(False, False, False), "adult_only": K.Filters(True, False, False), "names_only": K.Filters(False, True, False)}
    return signalled(spark, d).select("k", *[K.is_junk(n, sums, f, s=s).alias(c) for c, f in given.items()])


CHECKED = f"regexp_split_to_array(trim(regexp_replace(translate(lower({Q.watermarks_off('name')}), '._-~', '    '), '\\s+', ' ', 'g')), ' ')"


@query(f"""WITH slim AS (SELECT k, name FROM catalog), {Q.parsed_cte('slim')}, w AS (SELECT *, {CHECKED} AS ws FROM parsed),
g AS (SELECT *, array_to_string(ws, ' ') AS low, list_concat(list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i : i + 1], ' ')), list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' '))) AS grams FROM w)
SELECT k, low, low IN ('small ring', 'green tin ring', 'large box') OR list_contains(ws, 'steel') OR list_has_any(grams, ['small ring', 'green tin ring']) AS flag FROM g""", "catalog")
def adult_names(spark, d):
    n = F.col("name")
    return names(spark, d).select("k", K.adult_check_name(n).alias("low"), K.is_adult_name(n, PERFORMERS, STUDIOS, KEYWORDS).alias("flag"))
