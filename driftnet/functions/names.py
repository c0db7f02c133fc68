"""Release-name parsing as plain column expressions, built from the rule tables.

No Python runs on the data: every function takes and returns columns. RE2 patterns are turned into Java's dialect: letters fold over all of
Unicode and $ means the very end of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftnet.functions import rules as R


def java(pattern: str, fold: bool = True) -> str:
    """A rule pattern for Java: (?iu) for case, \\z for an end that means the end."""
    return ("(?iu)" if fold else "") + pattern.replace("|$)", r"|\z)").removesuffix("$") + (r"\z" if pattern.endswith("$") else "")


def has(name: Column, pattern: str) -> Column:
    return name.rlike(java(pattern))


def any_of(name: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | has(name, p)
    return out


def contains_any(name: Column, words: list[str]) -> Column:
    low = F.lower(name)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def first_rule(name: Column, table: list[tuple[str, str]]) -> Column:
    """The value of the first rule whose pattern is found, '' if none is."""
    out = None
    for value, pattern in table:
        out = F.when(has(name, pattern), value) if out is None else out.when(has(name, pattern), value)
    return out.otherwise("")


def group(name: Column, pattern: str, k: int = 1) -> Column:
    return F.regexp_extract(name, java(pattern), k)


def strip(text: Column, pattern: str, by: str = "", fold: bool = True) -> Column:
    return F.regexp_replace(text, java(pattern, fold), by)


def whole_number(text: Column) -> Column:
    """Leading digits as an integer; '' gives 0 and what is too long gives null."""
    digits = F.regexp_extract(text, r"^\s*(\d*)", 1)
    return F.when(digits == "", 0).otherwise(digits.try_cast("int"))


def subgroup(name: Column) -> Column:
    return group(name, R.SUBGROUP)


def anime_episode(name: Column) -> Column:
    """The first number of two to four digits behind the group's brackets that is above 0, or -1."""
    rest = strip(name, R.SUBGROUP)
    found = F.transform(F.regexp_extract_all(rest, F.lit(java(R.ANIME_EPISODE)), F.lit(1)), lambda x: x.try_cast("int"))
    return F.coalesce(F.try_element_at(F.filter(found, lambda x: (x > 0) & (x < 10000)), F.lit(1)), F.lit(-1))


def season_episode(name: Column) -> Column:
    """struct(season, episode) of the first season pattern, of the anime rule for bracket groups, -1 where there is none."""
    both = lambda s, e: F.struct(s.alias("season"), e.alias("episode"))
    out = None
    for p in R.SEASON_EPISODE:
        e = F.when(group(name, p, 2) != "", whole_number(group(name, p, 2))).otherwise(-1) if p.count("(") - p.count("(?:") > 1 else F.lit(-1)
        value = both(whole_number(group(name, p, 1)), e)
        out = F.when(has(name, p), value) if out is None else out.when(has(name, p), value)
    return out.otherwise(both(F.lit(-1), F.when(subgroup(name) != "", anime_episode(name)).otherwise(-1)))


def year(name: Column) -> Column:
    """The first year in parentheses, else the last one between separators, within 1900 to 2100; else 0."""
    inner = group(name, R.YEAR_IN_PARENTHESES).try_cast("int")
    all_years = F.transform(F.regexp_extract_all(name, F.lit(java(R.YEAR)), F.lit(1)), lambda x: x.cast("int"))
    valid = F.filter(all_years, lambda y: y.between(1900, 2100))
    return F.when(inner.between(1900, 2100), inner).otherwise(F.coalesce(F.try_element_at(valid, F.lit(-1)), F.lit(0)))


def resolution(name: Column) -> Column:
    return first_rule(name, R.RESOLUTION)


def source(name: Column) -> Column:
    return first_rule(name, R.SOURCE)


def codec(name: Column) -> Column:
    return first_rule(name, R.CODEC)


def audio(name: Column) -> Column:
    return first_rule(name, R.AUDIO)


def hdr(name: Column) -> Column:
    return first_rule(name, R.HDR)


def imdb_id(name: Column) -> Column:
    return group(name, R.IMDB_ID)


def release_group(name: Column) -> Column:
    """The last word once tags are off, else the last of two or more parts between dashes, of 2 to 20 bytes."""
    base = name
    for ext in (r"\.mkv$", r"\.mp4$", r"\.avi$"):
        base = strip(base, ext, fold=False)
    base = strip(base, R.TITLE_TAIL)
    parts = F.filter(F.split(base, "[-_]"), lambda x: x != "")
    last = F.try_element_at(parts, F.lit(-1))
    found = group(base, R.GROUP)
    return F.when(found != "", found).when((F.size(parts) >= 2) & F.octet_length(last).between(2, 20), last).otherwise("")


def quality_by_words(name: Column) -> Column:
    out = None
    for value, words in R.QUALITY_WORDS:
        hit = contains_any(name, words)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise("unknown")


def quality_of_resolution(res: Column) -> Column:
    out = F.when(F.lit(False), "")
    for r, q in R.QUALITY_OF_RESOLUTION.items():
        out = out.when(F.lower(res) == r, q)
    return out.otherwise("unknown")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parts(name: Column) -> Column:
    """What several rules ask of a name, as one struct: numbers (season, episode), year, resolution, by_words, subgroup, imdb_id."""
    return F.struct(
        season_episode(name).alias("numbers"), year(name).alias("year"), resolution(name).alias("resolution"), quality_by_words(name).alias("by_words"),
        subgroup(name).alias("subgroup"), imdb_id(name).alias("imdb_id"),
    )


def quality(name: Column, s: Column | None = None) -> Column:
    """s, here and below: the parts of the name as a column, where a plan has them already."""
    if s is None:
        return let(resolution(name), lambda r: F.when(r != "", quality_of_resolution(r)).otherwise(quality_by_words(name)))
    return F.when(s["resolution"] != "", quality_of_resolution(s["resolution"])).otherwise(s["by_words"])


def without_watermarks(name: Column) -> Column:
    return strip(strip(strip(name, R.WATERMARKS[0]), R.WATERMARKS[1], fold=False), R.WATERMARKS[2], fold=False)


def title(name: Column, s: Column | None = None) -> Column:
    """What is left of the name without watermarks, brackets, episode, numbers, ids, tags and year."""
    return let(parts(name), lambda own: title(name, own)) if s is None else let(unbracketed(name, s["subgroup"]), lambda t: cut_title(t, s))


def unbracketed(name: Column, sub: Column) -> Column:
    t = strip(without_watermarks(name), r"\.(mkv|mp4|avi|wmv|ts|m2ts)$", fold=False)
    own = (sub != "") & F.lower(t).startswith(F.concat(F.lit("["), F.lower(sub), F.lit("]")))
    t = F.when(own, strip(t, r"^\[[^\]]+\]\s*")).otherwise(t)
    return strip(strip(t, r"\s*\[[^\]]*\]\s*", " "), r"\s*\([^\)]*\)\s*", " ")


def cut_title(t: Column, s: Column) -> Column:
    numbers, imdb, sub, y = s["numbers"], s["imdb_id"], s["subgroup"], s["year"]
    has_number = (numbers["season"] != -1) | (numbers["episode"] != -1)
    cut = None
    for p in R.SEASON_EPISODE + R.EPISODE_ONLY:
        before = F.regexp_replace(t, "(?s)" + java(f"(?:{p})") + ".*", "")
        cut = F.when(has(t, p), before) if cut is None else cut.when(has(t, p), before)
    t = F.when(has_number, cut.otherwise(t)).otherwise(t)
    loose = strip(strip(t, r"[\s._-]-[\s._]*\d+(?:v\d)?[\s._~-]*", " "), r"[\s._~-]+\d+(?:v\d)?[\s._~-]+", " ")
    t = F.when((sub != "") & (numbers["episode"] != -1), loose).otherwise(t)
    t = F.when(imdb != "", F.regexp_replace(t, F.concat(F.lit("(?i)"), imdb), F.lit(" "))).otherwise(t)
    t = strip(strip(t, R.TITLE_TAIL), r"[\s._-]mkv[\s._-]?$")
    digits = y.cast("string")
    t = F.when(y > 0, F.regexp_replace(t, F.concat(F.lit(r"[\s._-]"), digits, F.lit(r"[\s._-]?\z")), F.lit(""))).otherwise(t)
    t = F.when(y > 0, F.regexp_replace(t, F.concat(F.lit(r"[\s._-]"), digits, F.lit(r"[\s._-]")), F.lit(" "))).otherwise(t)
    t = strip(F.translate(t, "._", "  "), r"\s+", " ")
    return F.regexp_replace(t, r"^[-_.~\s]+|[-_.~\s]+\z", "")


def flags(name: Column) -> dict[str, Column]:
    low, src = F.lower(name), source(name)
    return {
        "is_remux": has(name, R.REMUX),
        "is_bluray": (src == "bluray") | low.contains("bluray") | low.contains("blu-ray"),
        "is_webdl": (src == "web-dl") | low.contains("web-dl") | low.contains("webdl"),
        "is_webrip": (src == "webrip") | low.contains("webrip"),
    }


def once(value: Column) -> Column:
    """A generator of just this value: what stands above uses the result and does not repeat the expression."""
    return F.explode(F.array(value))


def parse(name: Column, s: Column | None = None) -> Column:
    """All parts of a release name as one struct. A null name gives null parts."""
    if s is None:
        return let(parts(name), lambda own: parse(name, own))
    told = {
        "title": title(name, s), "year": s["year"], "season": s["numbers"]["season"], "episode": s["numbers"]["episode"], "quality": quality(name, s),
        "source": source(name), "codec": codec(name), "audio": audio(name), "hdr": hdr(name), "release_group": release_group(name),
        "imdb_id": s["imdb_id"], "resolution": s["resolution"], "subgroup": s["subgroup"], **flags(name),
    }
    return F.struct(*[c.alias(n) for n, c in told.items()])
