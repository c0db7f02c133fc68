"""Expected parts of release names."""

import pytest
from pyspark.sql import functions as F

from driftnet.functions import classify as K
from driftnet.functions import names as N

PARSED = [
    ("Copper.Harbor.2011.2160p.WEB-DL.DDP5.1.Atmos.DV.H.265-NORTH", {"title": "Copper Harbor", "year": 2011, "season": -1, "quality": "uhd", "source": "web-dl", "codec": "hevc", "audio": "atmos", "hdr": "dolby-vision", "resolution": "2160p", "is_webdl": True, "is_bluray": False}),
    ("A.Quiet.Ledger.1974.1080p.BluRay.REMUX.DTS-HD.MA.AVC-QED", {"title": "A Quiet Ledger", "year": 1974, "quality": "fhd", "source": "bluray", "codec": "h264", "audio": "dts-ma", "is_remux": True, "is_bluray": True}),
    ("Lantern.Road.Two.2019.720p.HDTV.x264-AB_tt7654321", {"title": "Lantern Road Two", "year": 2019, "imdb_id": "tt7654321", "codec": "h264", "source": "hdtv"}),
    ("The.Glass.Orchard.S03E07.480p.WEBRip.XviD-ZZ", {"title": "The Glass Orchard", "year": 0, "season": 3, "episode": 7, "quality": "sd", "is_webrip": True}),
    ("Salt.of.the.River.S11E204.2008.1080p.WEB-DL-QQ", {"title": "Salt of the River", "year": 2008, "season": 11, "episode": 204}),
    ("[Kumo] Paper Comets - 14 [720p].mkv", {"title": "Paper Comets", "season": -1, "episode": 14, "quality": "hd", "subgroup": "Kumo"}),
    ("[Kumo] Paper Comets - 15v3 [2160p][HEVC].mkv", {"title": "Paper Comets", "episode": 15, "quality": "uhd"}),
    ("www.Example.org    -    Winter.Tollbooth.1988.480p.DVDRip.x265-RR", {"title": "Winter Tollbooth", "year": 1988, "quality": "sd", "source": "dvdrip"}),
]
CATEGORIES = [
    ("The.Glass.Orchard.S03E07.480p.WEBRip-ZZ", [], "tv"), ("Copper.Harbor.2011.2160p.WEB-DL-NORTH", [], "movie"), ("[Kumo] Paper Comets - 14 [720p].mkv", [], "anime"),
    ("Paper.Comets.S02.Dual.Audio.720p-KM", [], "anime"), ("Plain Words Only", [("feature.mkv", 2 * 10**9)], "movie"), ("Other.Plain.Words", [(f"Episode1{k}.mkv", 3 * 10**8) for k in range(1, 8)], "tv"),
    ("nothing-to-see-in-this-one", [], "unknown"), ("[abc] Nothing Either", [], "unknown"),
]


@pytest.mark.parametrize(("name", "parts"), PARSED)
def test_parse(spark, name, parts):
    row = spark.createDataFrame([(name,)], "name string").select(N.parse(F.col("name")).alias("p")).first()["p"]
    assert {k: row[k] for k in parts} == parts


def test_classify(spark):
    rows = spark.createDataFrame([(n, f) for n, f, _ in CATEGORIES], "name string, files array<struct<path:string,size:bigint>>")
    found = {r["name"]: r["c"] for r in rows.select("name", K.category(F.col("name"), K.file_sums(F.col("files"))).alias("c")).collect()}
    assert found == {n: c for n, _, c in CATEGORIES}


def test_nulls(spark):
    rows = spark.createDataFrame([(None,), ("",)], "name string")
    out = rows.select(N.parse(F.col("name")).alias("p"), K.is_junk(F.col("name"), K.file_sums(F.lit(None).cast("array<struct<path:string,size:bigint>>"))).alias("j")).collect()
    assert [r["j"] for r in out] == [False, False] and out[1]["p"]["title"] == ""
