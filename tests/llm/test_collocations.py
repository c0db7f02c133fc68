"""Collocations against their SQL twin and plain counting, over given and odd tables, with small blocks and a small bit table."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftnet.llm import collocations as C
from tests.compare import same

KINDS = "doc_id long, lang string, text string"


def odd_rows():
    rng = random.Random(5)
    common = ["New", "york", "city", "Éa", "x\u00a0y"]
    rows = [(k, ("en", "en", None, "fr")[k % 4], " ".join(rng.choice(common) + rng.choice(["", "", "", "", "", ",", "\n", "\t"]) for _ in range(rng.randint(0, 60)))) for k in range(1500)]
    rows += [(500, "en", "rare words never seen twice " * 1), (501, "en", None), (502, "en", ""), (503, "und", "new york city. " * 200), (504, None, ".,;:!?\n\r"), (505, "", "new york " * 300)]
    return rows + [(506, "fr", "le petit prince est un livre! " * 5000)] + [(507, "de", "copy of a copy of a copy")] * 120


@pytest.mark.parametrize("sizes", [{}, {"block": 700, "bits": 6}])
def test_odd_rows(spark, tmp_path, sizes):
    path = str(tmp_path / "documents.parquet")
    docs = spark.createDataFrame(odd_rows(), KINDS).repartition(3)
    docs.withColumns({c: F.lit(1) for c in ("n", "m", "phrase", "a", "k", "salt", "score")}).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert same(spark, con, lambda s, p: C.collocations(s.read.parquet(p), **sizes), C.COLLOCATIONS_SQL, path) > 50


def test_suffix_array_counts():
    rng = np.random.default_rng(3)
    raw = " ".join(rng.choice(["a", "b", "c."], 3000)).encode().translate(C.TABLE)
    ids, words, room = C.word_ids(raw)
    order, lcp, _ = C.suffix_array(ids, room, 5)
    for m in range(1, 6):
        places, counts = C.intervals(order, lcp, room, m)
        found = dict(zip(C.phrases(words, ids, places, m).to_pylist(), counts.tolist(), strict=True))
        pieces = [re.findall(r"[^ \t]+", p) for p in raw.decode().split("\n")]
        assert found == Counter(" ".join(w[k : k + m]) for w in pieces for k in range(len(w) - m + 1))


def test_large_numbers_are_exact(spark, monkeypatch):
    """1000 * a * n passes 64 bits; the quotient is the floor of the exact one."""
    a, l, r, n = 10**13 + 7, 10**13 + 9, 10**14 + 1, 9 * 10**15 + 11
    grams = [("en", "x y", 2, a), ("en", "x", 1, l), ("en", "y", 1, r), ("en", "", 0, n)]
    monkeypatch.setattr(C, "phrase_counts", lambda *args, **more: spark.createDataFrame(grams, "lang string, phrase string, m int, n long"))
    out = C.collocations(spark.createDataFrame([], KINDS)).collect()
    assert [(r0["score"], r0["a"], r0["l"], r0["r"], r0["n"]) for r0 in out] == [(1000 * a * n // (l * r), a, l, r, n)]


def test_ranks_and_empty(spark):
    docs = spark.createDataFrame(odd_rows(), KINDS)
    full = {(r["lang"], r["rank"]): r for r in C.collocations(docs).collect()}
    cut = {(r["lang"], r["rank"]): r for r in C.collocations(docs, top=3).collect()}
    assert cut == {k: r for k, r in full.items() if k[1] <= 3}
    assert C.collocations(spark.createDataFrame([], KINDS)).collect() == []
    assert C.collocations(spark.createDataFrame([(1, None, None), (2, "en", "few words")], KINDS)).collect() == []


def test_given_tables(spark, small):
    from driftnet.llm import queries
    from tests.compare import connection

    assert same(spark, connection(small), queries.op12_collocations, C.COLLOCATIONS_SQL, small) > 20
