"""Queries over tables that have grown: full filters, keys that come again, state that does not lengthen each step."""

import os
import time

import pytest
from pyspark.sql import functions as F

from driftnet.functions import binary as B
from driftnet.plans import registry
from driftnet.streaming import pipeline as P
from driftnet.streaming import timed as T
from tests.compare import connection, same


@pytest.fixture
def grown(small, tmp_path):
    """A folder with the small tables but for those that are given."""

    def put(**tables):
        for name in os.listdir(small):
            if name.removesuffix(".parquet") not in tables:
                (tmp_path / name).symlink_to(f"{small}/{name}")
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def matches(spark, name, where):
    return same(spark, connection(where), registry.queries()[name], registry.oracle_sql()[name], where)


def test_full_filters(spark, small, grown):
    customer = spark.read.parquet(f"{small}/customer.parquet")
    where = grown(customer=customer.crossJoin(spark.range(600)).withColumn("c_custkey", F.col("c_custkey") + F.col("id") * 150).drop("id"))
    assert matches(spark, "bloom_merge", where) == 5 and matches(spark, "bloom_estimates", where) == 25
    full = spark.range(1).select(B.bloom_estimate(F.lit(2048)).alias("n"), B.bloom_estimate(F.lit(0)).alias("none")).first()
    assert full["n"] == float("inf") and full["none"] < 1


def test_answers_of_an_id_that_comes_again(spark, tmp_path):
    """All requests and answers carry one id: none may meet all the others."""
    rows = spark.range(40_000).select(F.lit(0).alias("txn"), F.timestamp_seconds(F.floor(F.col("id") / 2) * 10 + F.col("id") % 2 * 4 + 10).alias("at"), F.col("id").alias("event_id"))
    rows.write.parquet(f"{tmp_path}/rows")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/rows")
    own = [(i, i + 1) for i in range(0, 40_000, 2)]
    for source, run in ((rows, lambda df: df), (stream, P.drain)):
        began = time.time()
        pairs = run(P.correlate(source.filter("event_id % 2 = 0"), source.filter("event_id % 2 = 1"))).collect()
        assert sorted(map(tuple, pairs)) == own and time.time() - began < 60


def test_answers_at_the_edges_of_the_timeout(spark):
    micros = [0, 1, 3_999_999, 4_000_000, 4_000_001, 7_999_999, 8_000_000, 8_000_001, -1, -4_000_000, -4_000_001]
    rows = spark.createDataFrame([(t, m) for t in range(2) for m in micros], "txn int, event_id long").withColumn("at", F.timestamp_micros("event_id"))
    for seconds in (0, 4):
        found = sorted(map(tuple, P.correlate(rows.filter("txn = 0").withColumn("txn", F.lit(1)), rows.filter("txn = 1"), seconds).collect()))
        assert found == sorted((q, a) for q in micros for a in micros if q <= a <= q + seconds * 1_000_000)


def test_retries_of_many_times(spark, tmp_path):
    """One slot holds requests of thousands of times at once; each goes back by its own."""
    rows = spark.range(30_000).select(F.col("id").cast("string").alias("item"), F.lit(0).alias("n_retries"), F.timestamp_seconds(F.col("id") + 1).alias("at"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/rows")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/rows")
    began = time.time()
    told = T.with_timers(spark, lambda: P.drain(T.timed_retries(stream, most=1_000_000, slots=1))).collect()
    assert sorted((r["at_ms"], r["item"], r["what"]) for r in told) == [((i + 31) * 1000, str(i), "retry") for i in range(30_000 - 31)]
    assert time.time() - began < 60


def test_admissions_by_rule(spark, tmp_path):
    """Two micro-batches, repeated nodes and times, one full bucket, a node without an id: as a plain walk in the order of times."""
    rows = [[(f"{k % 150 if k % 3 else k:040x}"[::-1], k // 2) for k in range(600)] + [(None, 5)], [(f"{k:040x}"[::-1], k) for k in range(900)]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "id string, s long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        time.sleep(1.1)  # files come by their times
    stream = spark.readStream.schema("id string, s long").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    told = P.admissions(stream.select("id", F.timestamp_seconds("s").alias("at")), "0" * 40).collect()
    held, want = {}, []
    for part in rows:
        for i, _ in sorted((r for r in part if r[0]), key=lambda r: (r[1], r[0])):
            bucket = 160 - int(i, 16).bit_length()
            own = held.setdefault(bucket, set())
            want.append((bucket, i, "exists" if i in own else "accepted" if len(own) < 80 else "rejected"))
            own |= {i} if len(own) < 80 else set()
    assert sorted(tuple(r) for r in told if r["id"]) == sorted(want) and {v for _, _, v in want} == {"exists", "accepted", "rejected"}
    assert [tuple(r) for r in told if not r["id"]] == [(None, None, "rejected")]
