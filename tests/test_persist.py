"""The persist stream: batches see what those before them left, and a repeated batch changes nothing."""

import pytest
from pyspark.sql import functions as F

from driftnet.operators.stored import StoredTable
from driftnet.streaming import persist as P

NOW = 1_700_000_000


def metadata(spark):
    names = {"a": "Some.Movie.2019.1080p.BluRay.x264-GRP", "b": "Other Show S01E02 720p HDTV", "c": "Tool v2.1 x64 setup keygen", "d": "plain words", "e": "Last.Film.2001.DVDRip.XviD"}
    video = [("f.mkv", 10**9)]
    rows = [(k.ljust(40, "0"), n, 10**9, video if k != "d" else [("f.txt", 5)]) for k, n in names.items()]
    return spark.createDataFrame(rows, "info_hash string, name string, size long, files array<struct<path:string,size:bigint>>")


def arrive(spark, at, k, letters):
    spark.createDataFrame([(x.ljust(40, "0"),) for x in letters], "info_hash string").coalesce(1).write.mode("append").parquet(f"{at}/in")
    return spark.readStream.schema("info_hash string").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")


def state(catalog, rejects):
    rows = {r["info_hash"][0]: (r["category"], r["discovered_at"]) for r in catalog.read().collect()}
    return rows, {r["info_hash"][0]: r["rejected_at"] for r in rejects.read().collect()}


@pytest.mark.parametrize("broken", ["catalog", "rejects"])
def test_replay_after_failure(spark, tmp_path, monkeypatch, broken):
    at = f"file://{tmp_path}"
    catalog, rejects = P.tables(spark, f"{at}/{broken}", 1)
    meta = metadata(spark)
    run = lambda stream, now: P.persist_stream(stream, meta, catalog, rejects, now, f"{at}/state")
    run(arrive(spark, at, 0, "abc"), NOW)
    first = state(catalog, rejects)
    assert first == ({"a": ("movie", NOW), "b": ("tv", NOW)}, {"c": NOW})
    stream, real = arrive(spark, at, 1, "acde"), StoredTable.commit
    with monkeypatch.context() as m:  # the batch fails at one of its sinks
        m.setattr(StoredTable, "commit", lambda self, held: (_ for _ in ()).throw(OSError("lost")) if self.root.endswith(f"/{broken}") and held.batches.get(P.STREAM) == 1 else real(self, held))
        with pytest.raises(Exception, match="lost"):
            run(stream, NOW + 5)
    assert catalog.snapshot().batches == {P.STREAM: 0}
    run(stream, NOW + 5)
    want = ({"a": ("movie", NOW), "b": ("tv", NOW), "e": ("movie", NOW + 5)}, {"c": NOW, "d": NOW + 5})
    assert state(catalog, rejects) == want
    versions = catalog.snapshot().version, rejects.snapshot().version
    # the batch once more, as after a failure behind the last sink
    P.persist_batch(spark.createDataFrame([(x.ljust(40, "0"),) for x in "acde"], "info_hash string"), 1, meta, catalog, rejects, NOW + 9)
    assert state(catalog, rejects) == want and versions == (catalog.snapshot().version, rejects.snapshot().version)


def test_repeated_hashes_in_a_batch(spark, tmp_path):
    catalog, rejects = P.tables(spark, f"file://{tmp_path}", 1)
    meta = metadata(spark)
    twice = meta.unionByName(meta.withColumn("name", F.lit("zz later.2001.DVDRip")))
    P.persist_batch(meta.select("info_hash").unionByName(meta.select("info_hash")), 0, twice, catalog, rejects, NOW)
    rows, bad = state(catalog, rejects)
    assert sorted([*rows, *bad]) == list("abcde")
