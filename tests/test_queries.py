"""Every registered query against its DuckDB twin; those without one must run and keep a stable schema."""

import pytest

from driftnet.plans import registry
from tests.compare import connection, same

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_twin(spark, con, small, name):
    """Where the smallest tables give no row, the next larger ones must give some."""
    larger = small.replace("sf0.001", "sf0.01")
    assert same(spark, con, QUERIES[name], ORACLES[name], small) or same(spark, connection(larger), QUERIES[name], ORACLES[name], larger)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns and df.count() > 0


def test_values_without_a_twin(spark, small):
    assert QUERIES["storage_size"](spark, small).first()["bytes"] > 1000
    feed = QUERIES["feed_rss"](spark, small).first()
    assert feed["feed"].count("<item>") == 50 and "<caps>" in feed["caps"]
    kinds = [r["kind"] for r in QUERIES["random_sample"](spark, small).collect()]
    assert len(kinds) == 40 and set(kinds) <= {"hash", "node"}
    told = QUERIES["routing_table_stream"](spark, small).groupBy("bucket", "verdict").count().collect()
    room = {r["bucket"]: r["count"] for r in told if r["verdict"] == "accepted"}
    assert max(room.values()) <= 80 and all(room[r["bucket"]] == 80 for r in told if r["verdict"] == "rejected")


def test_batches_by_size_or_time(spark, small):
    rows = QUERIES["size_or_time_batches"](spark, small).collect()
    assert {r["why"] for r in rows} == {"size", "time"} and all((r["n"] == 50) == (r["why"] == "size") and r["n"] == r["n_distinct"] <= 50 for r in rows)
    total = QUERIES["counters"](spark, small).agg({"n": "sum"}).first()[0]
    assert total - 8 * 50 < sum(r["n"] for r in rows) <= total  # at most one open batch a slot


def test_streams_equal_batches(spark, small):
    routes = lambda n: {tuple(r) for r in QUERIES[n](spark, small).select("info_hash", "route").collect()}
    assert routes("triage_stream") == routes("triage_route")
    pairs = lambda n: {tuple(r) for r in QUERIES[n](spark, small).select("request_id", "answer_id").collect()}
    assert pairs("txn_interval_join_stream") == pairs("txn_interval_join") and pairs("txn_interval_join")
    assert all(r["once"] for r in QUERIES["seen_set_stream"](spark, small).collect())
