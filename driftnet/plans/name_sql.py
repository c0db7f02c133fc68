"""DuckDB expressions for the name and file rules, written from the same rule tables."""

from __future__ import annotations

from driftnet.functions import rules as R


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re(pattern: str, fold: bool = True) -> str:
    return q(("(?i)" if fold else "") + pattern)


def has(s: str, p: str) -> str:
    return f"regexp_matches({s}, {re(p)})"


def any_of(s: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(has(s, p) for p in patterns) + ")"


def contains_any(s: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({s}), {q(w)})" for w in words) + ")"


def strip(s: str, p: str, by: str = "", fold: bool = True) -> str:
    return f"regexp_replace({s}, {re(p, fold)}, {q(by)}, 'g')"


def first_rule(s: str, table) -> str:
    return "CASE " + " ".join(f"WHEN {has(s, p)} THEN {q(v)}" for v, p in table) + " ELSE '' END"


def number(s: str) -> str:
    return f"CASE WHEN regexp_extract({s}, '^\\s*(\\d*)', 1) = '' THEN 0 ELSE TRY_CAST(regexp_extract({s}, '^\\s*(\\d*)', 1) AS INTEGER) END"


def group(s: str, p: str, k: int = 1) -> str:
    return f"regexp_extract({s}, {re(p)}, {k})"


def quality_words(s: str) -> str:
    return "CASE " + " ".join(f"WHEN {contains_any(s, w)} THEN {q(v)}" for v, w in R.QUALITY_WORDS) + " ELSE 'unknown' END"


def watermarks_off(s: str) -> str:
    return strip(strip(strip(s, R.WATERMARKS[0]), R.WATERMARKS[1], fold=False), R.WATERMARKS[2], fold=False)


def parsed_cte(source: str, name: str = "parsed") -> str:
    """CTEs over a relation with columns k and name; the last one is called `name` and adds every parsed part."""
    n = "name"
    seasons = "CASE " + " ".join(f"WHEN {has(n, p)} THEN {number(group(n, p, 1))}" for p in R.SEASON_EPISODE) + " ELSE -1 END"

    def episode(p):
        return "-1" if p.count("(") - p.count("(?:") < 2 else f"CASE WHEN {group(n, p, 2)} != '' THEN {number(group(n, p, 2))} ELSE -1 END"

    loose = f"coalesce(list_filter(list_transform(regexp_extract_all({strip(n, R.SUBGROUP)}, {re(R.ANIME_EPISODE)}, 1), lambda x: TRY_CAST(x AS INTEGER)), lambda x: x > 0 AND x < 10000)[1], -1)"
    episodes = "CASE " + " ".join(f"WHEN {has(n, p)} THEN {episode(p)}" for p in R.SEASON_EPISODE) + f" WHEN {group(n, R.SUBGROUP)} != '' THEN {loose} ELSE -1 END"
    years = f"list_filter(list_transform(regexp_extract_all({n}, {re(R.YEAR)}, 1), lambda x: CAST(x AS INTEGER)), lambda y: y BETWEEN 1900 AND 2100)[-1]"
    inner = f"TRY_CAST({group(n, R.YEAR_IN_PARENTHESES)} AS INTEGER)"
    res = first_rule(n, R.RESOLUTION)
    res_quality = "CASE resolution " + " ".join(f"WHEN {q(r)} THEN {q(v)}" for r, v in R.QUALITY_OF_RESOLUTION.items()) + " END"
    base = strip(strip(strip(strip(n, r"\.mkv$", fold=False), r"\.mp4$", fold=False), r"\.avi$", fold=False), R.TITLE_TAIL)
    cuts = R.SEASON_EPISODE + R.EPISODE_ONLY
    cut = "CASE WHEN season = -1 AND episode = -1 THEN t2 " + " ".join(f"WHEN {has('t2', p)} THEN regexp_replace(t2, {q('(?is)(?:' + p + ').*')}, '')" for p in cuts) + " ELSE t2 END"
    loose_off = strip(strip("t3", r"[\s._-]-[\s._]*\d+(?:v\d)?[\s._~-]*", " "), r"[\s._~-]+\d+(?:v\d)?[\s._~-]+", " ")
    trim = strip(strip("translate(t7, '._', '  ')", r"\s+", " "), r"^[-_.~\s]+|[-_.~\s]+$")
    return f"""{name}_a AS MATERIALIZED (SELECT *, {seasons} AS season, {episodes} AS episode, CASE WHEN {inner} BETWEEN 1900 AND 2100 THEN {inner} ELSE coalesce({years}, 0) END AS year,
  {res} AS resolution, {first_rule(n, R.SOURCE)} AS source, {first_rule(n, R.CODEC)} AS codec, {first_rule(n, R.AUDIO)} AS audio, {first_rule(n, R.HDR)} AS hdr,
  {group(n, R.SUBGROUP)} AS subgroup, {group(n, R.IMDB_ID)} AS name_imdb, {base} AS b, {has(n, R.REMUX)} AS is_remux FROM {source}),
{name}_b AS MATERIALIZED (SELECT *, CASE WHEN resolution != '' THEN {res_quality} ELSE {quality_words(n)} END AS name_quality,
  source = 'bluray' OR {contains_any(n, ['bluray', 'blu-ray'])} AS is_bluray, source = 'web-dl' OR {contains_any(n, ['web-dl', 'webdl'])} AS is_webdl, source = 'webrip' OR {contains_any(n, ['webrip'])} AS is_webrip,
  list_filter(regexp_split_to_array(b, '[-_]'), lambda x: x != '') AS parts, {strip(watermarks_off(n), r"[.](mkv|mp4|avi|wmv|ts|m2ts)$", fold=False)} AS t0 FROM {name}_a),
{name}_c AS MATERIALIZED (SELECT *, CASE WHEN {group('b', R.GROUP)} != '' THEN {group('b', R.GROUP)} WHEN len(parts) >= 2 AND octet_length(encode(parts[-1])) BETWEEN 2 AND 20 THEN parts[-1] ELSE '' END AS release_group,
  CASE WHEN subgroup != '' AND starts_with(lower(t0), concat('[', lower(subgroup), ']')) THEN {strip('t0', r"^[[][^]]+[]]\s*")} ELSE t0 END AS t1 FROM {name}_b),
{name}_d AS MATERIALIZED (SELECT *, {strip(strip('t1', r"\s*\[[^\]]*\]\s*", " "), r"\s*\([^\)]*\)\s*", " ")} AS t2 FROM {name}_c),
{name}_e AS MATERIALIZED (SELECT *, {cut} AS t3 FROM {name}_d),
{name}_f AS MATERIALIZED (SELECT *, CASE WHEN subgroup != '' AND episode != -1 THEN {loose_off} ELSE t3 END AS t4 FROM {name}_e),
{name}_g AS MATERIALIZED (SELECT *, {strip(strip("CASE WHEN name_imdb != '' THEN regexp_replace(t4, concat('(?i)', name_imdb), ' ', 'g') ELSE t4 END", R.TITLE_TAIL), r"[\s._-]mkv[\s._-]?$")} AS t5 FROM {name}_f),
{name}_h AS MATERIALIZED (SELECT *, CASE WHEN year > 0 THEN regexp_replace(t5, concat('[\\s._-]', year, '[\\s._-]?$'), '', 'g') ELSE t5 END AS t6 FROM {name}_g),
{name}_i AS MATERIALIZED (SELECT *, CASE WHEN year > 0 THEN regexp_replace(t6, concat('[\\s._-]', year, '[\\s._-]'), ' ', 'g') ELSE t6 END AS t7 FROM {name}_h),
{name} AS MATERIALIZED (SELECT * EXCLUDE (b, parts, t0, t1, t2, t3, t4, t5, t6, t7), {trim} AS title FROM {name}_i)"""


def ext(path: str) -> str:
    return f"lower(regexp_extract({path}, '([.][^./]*)$', 1))"


def listed(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def file_sums_cte(source: str, name: str = "sums") -> str:
    """One row per k of a relation (k, path, size)."""
    video = f"{ext('path')} IN {listed(R.VIDEO_EXTENSIONS)}"
    return f"""{name} AS MATERIALIZED (SELECT k, CAST(count(*) AS INTEGER) AS n_files, CAST(count(*) FILTER ({video}) AS INTEGER) AS n_video, CAST(sum(size) AS BIGINT) AS total,
  CAST(coalesce(sum(size) FILTER ({video}), 0) AS BIGINT) AS video, CAST(coalesce(sum(size) FILTER ({ext('path')} IN {listed(R.JUNK_EXTENSIONS)}), 0) AS BIGINT) AS junk,
  CAST(coalesce(sum(size) FILTER ({ext('path')} IN {listed(R.AUDIO_EXTENSIONS)}), 0) AS BIGINT) AS audio_size, count(*) FILTER ({ext('path')} IN {listed(R.SUBTITLE_EXTENSIONS)}) > 0 AS has_subtitles,
  CAST(count(*) FILTER ({video} AND {any_of('path', R.EPISODE_FILE)}) AS INTEGER) AS n_episodes FROM {source} GROUP BY k)"""


def anime(s: str = "name") -> str:
    return f"(({contains_any(s, R.ANIME_KEYWORDS)} AND {has(s, R.ANIME_EPISODE)}) OR ({has(s, R.SUBGROUP)} AND {has(s, R.ANIME_EPISODE)}) OR {any_of(s, R.ANIME)})"


def tv(s: str = "name") -> str:
    return f"({any_of(s, R.TV)} OR {contains_any(s, R.TV_KEYWORDS)})"


def movie(s: str = "name") -> str:
    return f"(season = -1 AND episode = -1 AND ({any_of(s, R.MOVIE)} OR ({contains_any(s, R.MOVIE_KEYWORDS)} AND year > 0) OR (year > 0 AND name_quality != 'unknown')))"


def signals(s: str = "name") -> str:
    return f"((year > 0 AND name_quality != 'unknown') OR season != -1 OR episode != -1 OR {any_of(s, R.MOVIE + R.TV)})"


def adult(s: str = "name") -> str:
    return f"((NOT {anime(s)} AND {any_of(s, R.ADULT[:2])}) OR {any_of(s, R.ADULT[2:])})"


def category() -> str:
    """Over parsed columns joined with file sums."""
    guess = "CASE WHEN n_video = 0 THEN NULL WHEN (n_video BETWEEN 2 AND 5 AND n_episodes >= n_video // 2) OR n_video > 5 THEN 'tv' WHEN n_video = 1 OR (n_video BETWEEN 2 AND 5 AND n_video / n_files > 0.5) THEN 'movie' END"
    return f"CASE WHEN {anime()} THEN 'anime' WHEN {tv()} THEN 'tv' WHEN {movie()} THEN 'movie' WHEN total > 0 AND video / total > 0.80 THEN coalesce({guess}, 'unknown') ELSE 'unknown' END"


def junk_files() -> str:
    return f"coalesce(n_files > 0 AND total > 0 AND (junk / total > 0.50 OR (video = 0 AND (audio_size = 0 OR (NOT has_subtitles AND NOT {signals()})))), FALSE)"
