"""Laws of the operators: idempotent upserts, pages that add up, exact neighbours, decoders that round-trip."""

import hashlib

import pytest
from pyspark.sql import functions as F

from driftnet.functions import binary as B
from driftnet.functions import feed as X
from driftnet.operators import catalog as C
from driftnet.operators import keyspace as K
from driftnet.operators import mutate as M
from driftnet.sources import wire as W


def key(k):
    return hashlib.sha1(str(k).encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(key(k), f"n{k}", k // 3) for k in range(50)], "info_hash string, name string, discovered_at long")


def state(df):
    return sorted(map(tuple, df.collect()))


def test_upsert_is_idempotent(spark, rows):
    batch = spark.createDataFrame([(key(1), "new", 9), (key(99), "more", 9)], rows.schema)
    once = M.upsert(rows, batch, [F.desc("name")])
    assert state(once) == state(M.upsert(once, batch, [F.desc("name")])) and once.count() == 51


def test_bad_hash_fails_the_batch(spark):
    with pytest.raises(Exception, match="20 bytes"):
        M.checked(spark.createDataFrame([("zz",)], "info_hash string")).collect()


def test_pages_add_up(rows):
    pages = [r["info_hash"] for o in range(0, 60, 20) for r in C.page(rows, C.total_order("discovered_at"), 20, o).collect()]
    assert pages == [r["info_hash"] for r in rows.orderBy(*C.total_order("discovered_at")).collect()]
    after, seen = (0, ""), []
    while got := C.keyset_page(rows, *after, 7).collect():
        seen += [r["info_hash"] for r in got]
        after = got[-1]["discovered_at"], got[-1]["info_hash"]
    assert seen == [r["info_hash"] for r in rows.orderBy("discovered_at", "info_hash").collect()]


def test_counters_only_grow(spark):
    own = spark.createDataFrame([(key(1), 5, 5), (key(2), 1, 1)], "info_hash string, seeders int, leechers int")
    seen = spark.createDataFrame([(key(1), 4, 9), (key(2), 1, 0), (key(3), 7, 7)], "info_hash string, complete int, incomplete int")
    assert state(M.merge_counters(own, seen)) == [(key(1), 5, 9)]


def test_closest_is_exact(spark):
    ids = [key(k) for k in range(300)]
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    found = K.closest(spark.createDataFrame([(key("t"),), (key("u"),)], "target string"), nodes).collect()
    for t in (key("t"), key("u")):
        want = sorted(ids, key=lambda i: int(i, 16) ^ int(t, 16))[:8]
        assert [r["id"] for r in sorted(found, key=lambda r: r["rank"]) if r["target"] == t] == want


def test_xor_laws(spark):
    a, b = key(1), key(2)
    row = spark.range(1).select(B.xor(F.lit(a), F.lit(b)).alias("x"), B.xor(F.lit(b), F.lit(a)).alias("y"), B.leading_zeros(B.xor(F.lit(a), F.lit(a))).alias("z"), B.bit_length(F.lit("0" * 39 + "5")).alias("n")).first()
    assert row["x"] == row["y"] == f"{int(a, 16) ^ int(b, 16):040x}" and row["z"] == 160 and row["n"] == 3


def test_bencode_round_trip():
    value = {b"files": {bytes(range(20)): {b"complete": 3, b"incomplete": -1, b"x": [b"a", 1]}, b"short": {}}}
    assert W.decode(W.encode(value))[0] == value and W.scrape_counts(W.encode(value)) == [(bytes(range(20)).hex(), 3, -1)]
    for bad in (b"", b"d", b"i12", b"5:ab", b"x", b"l" * 100):
        with pytest.raises(W.Bad):
            W.decode(bad)


def test_feed_filters():
    assert X.filters_of([2040, 5030]) == ([0, 1], [1, 2, 3]) and X.filters_of([7000]) == ([], []) and X.filters_of([5070]) == ([2], [])
    assert X.search_suffix(1, 2) == "S01E02" and X.search_suffix(0, 0) == "" and X.search_suffix(None, 7) == "E07"
    assert "<caps>" in X.capabilities()
