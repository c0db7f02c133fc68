"""Timers and bounded state on streams whose clock the test moves: each file is a micro-batch, its times move the watermark."""

import pytest
from pyspark.sql import functions as F

from driftnet.streaming import timed as T


@pytest.fixture
def run(spark, tmp_path):
    """Feeds rows (key, item, seconds, tries) file by file to a stage and gives what the sink has in the end."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", T.STATE_STORE)

    def feed(stage, *files):
        kinds = "addr string, item string, s long, n_retries int"
        for k, rows in enumerate(files):
            spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
            stream = spark.readStream.schema(kinds).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("at", F.timestamp_seconds("s"))
            put = lambda df, b: df.write.mode("overwrite").parquet(f"{tmp_path}/out/sink={b}")
            stage(stream).writeStream.outputMode("update" if stage.__name__ == "addresses" else "append").foreachBatch(put).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return [r.asDict() for r in spark.read.parquet(f"{tmp_path}/out").collect()]

    yield feed
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_retry_after_its_delay(run):
    one = lambda item, s, tries=0: ("", item, s, tries)

    def stage(stream):
        return T.timed_retries(stream, most=2, slots=1)

    out = run(stage, [one("a", 100), one("b", 110), one("c", 111), one("d", 112, 1)], [one("z", 125, 1)], [one("y", 132, 1)], [one("x", 142, 1)], [one("e", 143)], [one("w", 180, 1)])
    told = {(r["item"], r["what"], r["at_ms"] // 1000) for r in out}
    # c found the queue full; e came when there was room again
    assert told == {("a", "retry", 130), ("b", "retry", 140), ("c", "failed", 111), ("e", "retry", 173), *((i, "failed", s) for i, s in (("d", 112), ("z", 125), ("y", 132), ("x", 142), ("w", 180)))}
    assert [r["sink"] for r in out if r["item"] == "a"] > [r["sink"] for r in out if r["item"] == "c"]


def test_batches_by_size_or_time(run):
    rows = lambda start, n, s: [("", f"i{k:03d}", s, 0) for k in range(start, start + n)]

    def stage(stream):
        return T.timed_batches(stream, most=10, wait_ms=5000, slots=1)

    out = run(stage, rows(0, 7, 100), rows(7, 5, 101), rows(12, 23, 103), rows(35, 2, 200), rows(37, 1, 300))
    batches = {}
    for r in out:
        batches.setdefault((r["slot"], r["batch"], r["why"]), []).append(r["item"])
    assert all(len(v) == 10 for (_, _, why), v in batches.items() if why == "size") and {why for _, _, why in batches} == {"size", "time"}
    found = [i for v in batches.values() for i in v]
    assert sorted(found) == [f"i{k:03d}" for k in range(37)] and sorted(len(v) for (_, _, why), v in batches.items() if why == "time") == [2, 5]


def test_address_map_keeps_its_bounds(run):
    first = [(f"addr{k:02d}", f"h{j}", 100 + k, 0) for k in range(30) for j in range(9)]

    def addresses(stream):
        return T.address_map(stream, most=10, hashes=4, keep_ms=1_000_000, slots=1)

    out = run(addresses, first, [("addr29", "h1", 200, 0), ("new", "h", 201, 0)], [("late", "h", 5000, 0)])
    last = {}
    for r in sorted(out, key=lambda r: r["sink"]):
        last[r["addr"]] = r
    assert max(r["n_hashes"] for r in out) == 4
    by_batch = {b: sum(r["kept"] for r in out if r["sink"] == b) for b in {r["sink"] for r in out}}
    assert by_batch[min(by_batch)] == 10
    assert {a for a, r in last.items() if r["kept"]} == {"late"} and last["new"]["kept"] is False  # the rest aged out
