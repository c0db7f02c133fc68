"""The fair mix against its SQL twin, over given and odd tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from driftnet.llm import mixing, queries
from tests.compare import same


def twin(path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    return con


def query(spark, path):
    return mixing.mix_documents(spark.read.parquet(path))


def odd_rows():
    """A source with a third of all rows, one of a single long text, ties, repeated and null ids, null and empty texts and sources."""
    rows = [(k, "hot" if k % 3 == 0 else f"s{k % 5}", "a b " * (k % 17)) for k in range(600)]
    rows += [(7, "s2", "same words here")] * 3 + [(7, "s2", "other")] + [(None, "s1", "x y z"), (None, None, "p q"), (900, None, None), (901, "", "one"), (902, "", "")]
    return rows + [(1000, "long", "word " * 30_000), (1001, "dry", None), (1002, "dry", " \t\n"), (1003, "Ünder", "ä ö ü"), (1004, "tiny", "w")]


@pytest.mark.parametrize("parts", [1, 7])
def test_odd_rows(spark, tmp_path, parts):
    path = str(tmp_path / "documents.parquet")
    docs = spark.createDataFrame(odd_rows(), "doc_id long, source string, text string")
    clash = {c: F.lit(1) for c in ("row", "lane", "block", "size", "at", "start", "end", "span", "words", "n", "target", "spot", "packet", "upto")}
    docs.repartition(parts).withColumns(clash).write.parquet(path)
    assert same(spark, twin(f"{path}/*.parquet"), query, mixing.MIX_SQL, path) == len(odd_rows())


def test_targets_and_order(spark):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, source string, text string").repartition(5)
    line = sorted(mixing.queue(docs).collect(), key=lambda r: (r["finish"], r["position"]))
    with_words = sorted((r for r in line if r["words"]), key=lambda r: r["position"])
    ends = 0
    for r in with_words:  # the queue has no gaps and runs in the order of the finish times
        assert r["position"] == ends
        ends += r["words"]
    assert [r["finish"] for r in with_words] == sorted(r["finish"] for r in with_words)
    taken, sizes, goal = {}, {}, {}
    for r in line:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        sizes[r["source"]], goal[r["source"]] = r["source_size"], r["target"]
    total = sum(sizes.values())
    assert abs(sum(goal.values()) - 1.5 * total) < 1e-6 * total
    for s in goal:
        assert abs(taken[s] - goal[s]) < 1 and goal[s] <= 2 * sizes[s]
    order = sorted((s for s in goal if s is not None)) + [None]
    share = {s: goal[s] / (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    level = max(share[s] for s in order if goal[s] < 2 * sizes[s])
    assert all(abs(share[s] - level) < 1e-6 * level if goal[s] < 2 * sizes[s] else share[s] <= level * (1 + 1e-9) for s in order)


def test_empty_and_wordless(spark):
    kinds = "doc_id long, source string, text string"
    assert mixing.mix_documents(spark.createDataFrame([], kinds)).collect() == []
    out = mixing.mix_documents(spark.createDataFrame([(1, "a", None), (2, None, "")], kinds)).collect()
    assert {(r["doc_id"], r["size"], r["target"], r["taken"]) for r in out} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_given_tables(spark, small):
    from tests.compare import connection

    assert same(spark, connection(small), queries.op11_fair_mix, mixing.MIX_SQL, small) == 200


def test_no_python_in_the_plan(spark, small):
    plan = queries.op11_fair_mix(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
