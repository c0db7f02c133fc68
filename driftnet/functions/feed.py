"""Feed mapping: category codes both ways, item attributes, JSON and RSS items, request values."""

from __future__ import annotations

from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftnet.functions import names as N

# The numbers of the feed's categories.
MOVIE = {"all": 2000, "other": 2020, "sd": 2030, "hd": 2040, "uhd": 2045, "bluray": 2060, "webdl": 2080}
TV = {"all": 5000, "webdl": 5010, "sd": 5030, "hd": 5040, "uhd": 5045, "other": 5050, "anime": 5070}
OTHER = 7000
#: id -> (categories, qualities) as ordinals.
FILTERS = {
    MOVIE["all"]: ([0], []), MOVIE["sd"]: ([0], [1]), MOVIE["hd"]: ([0], [2, 3]), MOVIE["uhd"]: ([0], [4]), MOVIE["bluray"]: ([0], []), MOVIE["webdl"]: ([0], []), MOVIE["other"]: ([0], []),
    TV["all"]: ([1, 2], []), TV["sd"]: ([1], [1]), TV["hd"]: ([1], [2, 3]), TV["uhd"]: ([1], [4]), TV["webdl"]: ([1], []), TV["other"]: ([1], []), TV["anime"]: ([2], []),
}


def parse_category_list(text: str) -> list[int]:
    """Numbers of a comma list; parts that are none are skipped."""
    return [int(p) for p in (x.strip() for x in text.split(",")) if p.lstrip("+-").isdigit()]


def filters_of(ids: list[int]) -> tuple[list[int], list[int]]:
    """The category set and the quality set of request ids; unknown ids add nothing, the sets combine as a cross product."""
    known = [FILTERS[i] for i in ids if i in FILTERS]
    return sorted({c for cs, _ in known for c in cs}), sorted({q for _, qs in known for q in qs})


def category_ids(category: Column, quality: Column, is_bluray: Column, is_webdl: Column) -> Column:
    """Feed categories of a row, parents first."""
    level = lambda kind, bare: F.when(quality == 1, kind["sd"]).when(quality.isin(2, 3), kind["hd"]).when(quality == 4, kind["uhd"]).otherwise(F.when(bare, kind["other"]))
    movie = F.array(F.lit(MOVIE["all"]), F.when(is_bluray, MOVIE["bluray"]), F.when(is_webdl, MOVIE["webdl"]), level(MOVIE, ~is_bluray & ~is_webdl))
    tv = F.array(F.lit(TV["all"]), F.when(is_webdl, TV["webdl"]), level(TV, ~is_webdl))
    return F.array_compact(F.when(category == 0, movie).when(category == 1, tv).when(category == 2, F.array(F.lit(TV["all"]), F.lit(TV["anime"]))).otherwise(F.array(F.lit(OTHER))))


def item_attributes(ids: Column, imdb_id: Column, tmdb_id: Column, seeders: Column, leechers: Column) -> Column:
    """array<struct<name, value>> in the order of the feed; ids that a row has not are left out."""
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    fixed = F.array(
        F.when(F.coalesce(imdb_id, F.lit("")) != "", pair("imdb", F.regexp_replace(imdb_id, "^tt", ""))), F.when(F.coalesce(tmdb_id, F.lit(0)) > 0, pair("tmdbid", tmdb_id)),
        pair("seeders", seeders), pair("peers", seeders + leechers), pair("downloadvolumefactor", F.lit("0")), pair("uploadvolumefactor", F.lit("1")),
    )
    return F.concat(F.transform(ids, lambda i: pair("category", i)), F.array_compact(fixed))


def with_feed_columns(rows: DataFrame) -> DataFrame:
    """rows with ids and attrs; the name is parsed anew, as the feed shows what it says."""
    flags = N.flags(F.col("name"))
    ids = category_ids(F.col("category"), F.col("quality"), flags["is_bluray"], flags["is_webdl"])
    rows = rows.withColumn("ids", ids)
    return rows.withColumn("attrs", item_attributes(F.col("ids"), F.col("imdb_id"), F.col("tmdb_id"), F.col("seeders"), F.col("leechers")))


def json_row(columns: dict[str, Column]) -> Column:
    """One JSON object; null fields are left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]))


FILES = "array<struct<path: string, size: bigint>>"


def files_json(files: Column) -> Column:
    """A file list as it is stored; none is null."""
    return F.when(F.size(F.coalesce(files, F.array().cast(FILES))) > 0, F.to_json(files))


def files_of(stored: Column) -> Column:
    """The file list of a stored one; null, empty and broken text give an empty list."""
    return F.coalesce(F.from_json(stored, FILES), F.array().cast(FILES))


def search_suffix(season: int | None, episode: int | None) -> str:
    """What a season and an episode add to a search text; 0 counts as absent."""
    return (f"S{season:02d}" if season else "") + (f"E{episode:02d}" if episode else "")


def external_id(imdb: Column, tmdb: Column, tvdb: Column) -> Column:
    """The first id given, as kind:value; imdb digits get their tt."""
    digits = F.regexp_extract(imdb, r"^(?:tt)?(\d+)\z", 1)
    number = lambda c: F.when(c.rlike(r"^\d+\z"), c)
    return F.coalesce(F.when(digits != "", F.concat(F.lit("imdb:tt"), digits)), F.concat(F.lit("tmdb:"), number(tmdb)), F.concat(F.lit("tvdb:"), number(tvdb)))


def rss(page: list, title: str = "catalog") -> str:
    """An RSS document of one collected page of rows (a page is bounded by the page size)."""
    root = ElementTree.Element("rss", version="2.0")
    channel = ElementTree.SubElement(root, "channel")
    ElementTree.SubElement(channel, "title").text = title
    for r in page:
        item = ElementTree.SubElement(channel, "item")
        for tag, value in (("title", r["name"]), ("guid", r["info_hash"]), ("size", str(r["size"]))):
            ElementTree.SubElement(item, tag).text = value
        for a in r["attrs"]:
            ElementTree.SubElement(item, "attr", name=a["name"], value=a["value"])
    return ElementTree.tostring(root, encoding="unicode")


def capabilities() -> str:
    """The static description of what the feed can search."""
    root = ElementTree.Element("caps")
    ElementTree.SubElement(root, "limits", max="1000", default="100")
    searching = ElementTree.SubElement(root, "searching")
    for kind, params in (("search", "q"), ("tv-search", "q,season,ep,tvdbid,imdbid"), ("movie-search", "q,imdbid,tmdbid")):
        ElementTree.SubElement(searching, kind, available="yes", supportedParams=params)
    categories = ElementTree.SubElement(root, "categories")
    for kind, table in (("Movies", MOVIE), ("TV", TV)):
        top = ElementTree.SubElement(categories, "category", id=str(table["all"]), name=kind)
        for name, i in table.items():
            if name != "all":
                ElementTree.SubElement(top, "subcat", id=str(i), name=f"{kind}/{name}")
    ElementTree.SubElement(categories, "category", id=str(OTHER), name="Other")
    return ElementTree.tostring(root, encoding="unicode")
