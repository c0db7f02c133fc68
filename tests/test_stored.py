"""Stored tables and their index: what is touched, what is read, what a repeated try does."""

import re

import pytest
from pyspark.sql import functions as F

from driftnet.operators import stored as S

KINDS = "info_hash string, name string, seeders int"


def some(spark, n, name="Small river", start=0):
    return spark.range(start, start + n).select(F.sha1(F.col("id").cast("string")).alias("info_hash"), F.concat(F.lit(f"{name} "), F.col("id").cast("string")).alias("name"), F.col("id").cast("int").alias("seeders"))


def table_of(spark, path, digits=1):
    return S.StoredTable(spark, f"file://{path}", S.schema_of(spark.createDataFrame([], KINDS)), digits=digits)


def files(table, held=None):
    rows = table.rows(held or table.snapshot())
    return {r[0] for r in rows.select(F.input_file_name()).distinct().collect()}


def content(df):
    return {r["info_hash"]: (r["name"], r["seeders"]) for r in df.collect()}


def test_untouched_files_stay(spark, tmp_path):
    table = table_of(spark, tmp_path)
    table.upsert(some(spark, 400), [F.desc("seeders")])
    before, first = files(table), table.snapshot()
    batch = some(spark, 3, "New name")
    table.upsert(batch, [F.desc("seeders")])
    touched = set(table.parts_of(batch))
    part = lambda f: re.search(r"part=(\w+)", f)[1]
    assert {f for f in before if part(f) not in touched} == {f for f in files(table) if part(f) not in touched}
    assert not {f for f in files(table) if part(f) in touched} & before
    assert content(table.read(first)) == content(some(spark, 400))
    assert content(table.read()) == content(some(spark, 400)) | content(batch)
    table.delete(some(spark, 400).filter(F.substring("info_hash", 1, 1) == "a"))
    assert "a" not in table.snapshot().parts and not any(k.startswith("a") for k in content(table.read()))
    assert table_of(spark, tmp_path / "none").read().count() == 0


def test_failure_before_the_commit_leaves_the_old_state(spark, tmp_path, monkeypatch):
    table = table_of(spark, tmp_path)
    table.upsert(some(spark, 50), [F.desc("seeders")], number=("s", 0))
    with monkeypatch.context() as m:
        m.setattr(S.Store, "commit", lambda self, held: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.upsert(some(spark, 50, "Torn"), [F.desc("seeders")], number=("s", 1))
    assert content(table.read()) == content(some(spark, 50))
    table.upsert(some(spark, 20, "Whole"), [F.desc("seeders")], number=("s", 1))
    state = content(table.read())
    assert state == content(some(spark, 50)) | content(some(spark, 20, "Whole"))
    again = table.upsert(some(spark, 20, "Twice"), [F.desc("seeders")], number=("s", 1))
    assert again.version == 2 and content(table.read()) == state
    assert content(table.read(table.snapshot(before=("s", 1)))) == content(some(spark, 50))
    with pytest.raises(RuntimeError):
        table.commit(S.Snapshot(2))


def test_copy_goes_on_where_it_broke_off(spark, tmp_path, monkeypatch):
    table, real = table_of(spark, tmp_path), S.Store.commit
    with monkeypatch.context() as m:
        m.setattr(S.Store, "commit", lambda self, held: real(self, held) if held.version < 3 else (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.copy_from(some(spark, 100), [F.desc("seeders")], chunks=4)
    assert table.snapshot().batches == {"copy": 1} and 0 < table.read().count() < 100
    table.copy_from(some(spark, 100), [F.desc("seeders")], chunks=4)
    assert content(table.read()) == content(some(spark, 100))


@pytest.fixture
def indexed(spark, tmp_path):
    table, index = table_of(spark, tmp_path / "t"), S.StoredIndex(spark, f"file://{tmp_path}/i", buckets=8)
    table.upsert(some(spark, 60), [F.desc("seeders")])
    index.apply(table.read().limit(0), table.read())
    return table, index


def test_index_follows_changes(spark, indexed):
    table, index = indexed
    found = lambda q: {r[0] for r in index.search(q).collect()}
    assert found("small riv") == set(content(some(spark, 60))) and found("river 59") == {content_key(spark, 59)} and found("lake") == found("") == set()
    batch, before = some(spark, 10, "Wide lake"), table.snapshot()
    index.follow(table, before, table.upsert(batch, [F.desc("seeders")], number=("s", 0)), batch, number=("s", 0))
    assert found("lake") == set(content(batch)) and not found("small ri") & set(content(batch)) and len(found("small ri")) == 50
    # a second try of the same batch changes nothing
    assert index.follow(table, before, table.snapshot(), batch, number=("s", 0)).version == 2
    before = table.snapshot()
    index.follow(table, before, table.delete(batch.limit(4)), batch.limit(4))
    assert len(found("wide la")) == 6
    back, before = some(spark, 10), table.snapshot()
    index.follow(table, before, table.upsert(back, [F.desc("seeders")]), back)
    whole = {(r["token"], r["info_hash"]) for r in index.current(index.snapshot()).collect()}
    merged = index.merge(1)
    assert all(len(v) == 1 for v in merged.parts.values()) and whole == {(r["token"], r["info_hash"]) for r in index.current(merged).collect()}
    assert found("small ri") == set(content(some(spark, 60))) and found("lake") == set() and len(found("r")) == 60


def content_key(spark, k):
    return some(spark, 1, start=k).first()["info_hash"]


def test_search_reads_the_buckets_of_its_tokens(spark, indexed):
    _, index = indexed
    assert len(index.buckets_of(["river"])) == 1 and len(index.snapshot().parts) > 3 and index.buckets_of(["small", "r"]) is None
    read = {re.search(r"part=(\w+)", f)[1] for f in index.rows(index.snapshot(), index.buckets_of(["river"])).inputFiles()}
    assert read == set(index.buckets_of(["river"]))
    plan = index.search("riv")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,riv)" in plan and "EqualTo(live,true)" in plan
