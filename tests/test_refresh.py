"""A dimension exchanged under a running stream, and settings that get their types."""

import pytest
from pyspark.sql import functions as F

from driftnet.operators import settings as C
from driftnet.streaming import refresh as R


def entries(spark, rows):
    return spark.createDataFrame(rows, "norm string, entry_id int")


def test_versions_are_swapped_between_batches(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}"
    dimension = R.Dimension(spark, f"{at}/titles", "norm string, entry_id int", "norm", parts=3)
    dimension.replace(entries(spark, [("a", 1), ("b", 2)]), 100)
    for k in range(4):  # one file a micro-batch
        spark.createDataFrame([(10 * k + i, n) for i, n in enumerate(["a", "b", "c", None])], "id int, norm string").coalesce(1).write.mode("append").parquet(f"{at}/in")

    def refresh(k):
        if k == 1:  # one that breaks off before its commit
            with monkeypatch.context() as m:
                m.setattr(R.Dimension, "commit", lambda self, held: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(OSError):
                    dimension.replace(entries(spark, [("a", 77)]), 150)
        if k == 2:
            dimension.replace(entries(spark, [("b", 20), ("c", 30)]), 200)

    stream = spark.readStream.schema("id int, norm string").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    R.lookup_stream(stream, dimension, "norm", f"{at}/out", f"{at}/state", refresh)
    seen = {}
    for r in spark.read.parquet(f"{at}/out").collect():
        seen.setdefault((r["batch"], r["version"]), {})[r["norm"]] = r["entry_id"]
    old, new = {"a": 1, "b": 2, "c": None, None: None}, {"a": None, "b": 20, "c": 30, None: None}
    assert seen == {(0, 1): old, (1, 1): old, (2, 2): new, (3, 2): new}


def test_refresh_when_due(spark, tmp_path):
    dimension = R.Dimension(spark, f"file://{tmp_path}", "norm string, entry_id int", "norm")
    assert dimension.read().count() == 0
    load = lambda n: lambda: entries(spark, [("a", n), (None, 0)])
    assert dimension.refresh(load(1), 1000, every=60) and not dimension.refresh(load(2), 1059, every=60)
    assert {tuple(r) for r in dimension.read().collect()} == {("a", 1), (None, 0)}
    assert dimension.refresh(load(3), 1060, every=60) and ("a", 3) in {tuple(r) for r in dimension.read().collect()}
    dimension.replace(entries(spark, []), 2000)
    assert dimension.read().count() == 0


def test_settings_get_their_types(spark):
    kinds = spark.createDataFrame([("on", "flag", None, None), ("size", "number", 1, 10), ("wait", "duration", None, None), ("hosts", "lines", None, None), ("log", "level", None, None)], "key string, kind string, least long, most long")

    def one(key, value):
        r = C.coerce(spark.createDataFrame([(key, value), ("unknown", "1")], "key string, value string"), kinds).collect()
        return None if len(r) != 1 or not r[0]["fits"] else next(r[0][c] for c in ("flag", "number", "lines", "level") if r[0][c] is not None)

    rows = [("on", "T", True), ("on", "0", False), ("on", "yes", None), ("on", None, None), ("size", "+7", 7), ("size", "11", None), ("size", "0", None), ("size", " 5", None), ("size", "9" * 30, None), ("wait", "1h30m", 5400 * 10**9), ("wait", "-1.5s", -15 * 10**8), ("wait", "0", 0), ("wait", "5", None), ("wait", "", None), ("wait", ".5ms", 500_000), ("hosts", " a \n\nb", ["a", "b"]), ("hosts", "", []), ("log", "WARN", "warn"), ("log", "loud", None)]
    many = C.coerce(spark.createDataFrame([(f"{k}", v) for k, (_, v, _) in enumerate(rows)], "key string, value string"), kinds.join(spark.createDataFrame([(f"{k}", key) for k, (key, _, _) in enumerate(rows)], "n string, key string"), "key").drop("key").withColumnRenamed("n", "key"))
    got = {r["key"]: next((r[c] for c in ("flag", "number", "lines", "level") if r[c] is not None), None) for r in many.collect() if r["fits"]}
    assert got == {f"{k}": want for k, (_, _, want) in enumerate(rows) if want is not None}
    assert one("unknown", "1") is None and one("log", "Info") == "info"
    assert C.coerce(spark.createDataFrame([], "key string, value string"), kinds).filter(F.col("fits")).count() == 0
