"""The prefix trie against plain Python and its SQL twin, over given and odd tables."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from driftnet.llm import prefix_trie, queries
from tests.compare import same

KINDS = "conv_id long, turn int, role string, text string"


def digest(turn):
    role, text = (v or "" for v in turn)
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest((role, text)), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        leader = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        made[c] = tuple(own.get(leader, [])[:h] + own[c][h:])
    members, words = {}, {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
            words[seq[:d]] = len(re.findall(r"[^\x20\x09-\x0D]+", seq[d - 1][1])) if d else 0
    out = set()
    for node, own_members in members.items():
        below = [x for x in members if x[: len(node)] == node]
        childless = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        ends = ",".join(str(c) for c in sorted(c for c in own_members if len(made[c]) == len(node)))
        out.add((
            min(own_members), len(node), min(members[node[:-1]]) if node else None, len(own_members), sum(1 for x in below if len(x) == len(node) + 1), len(childless),
            sum((len(members[x]) - 1) * words[x] for x in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def made_rows(seed, n=120, deep=9):
    """Conversations over two roles and three texts, so that most share their first turns; one is long, many are copies."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        for k in range(rng.randint(0, deep) if c % 3 else 4):
            rows.append((c, k, "user" if k % 2 else "system", "same turn" if c % 3 == 0 else rng.choice(["a", "b c", "d e f"])))
    rows += [(500, k, "user", "b c") for k in range(60)] + [(501, k, "user", "b c") for k in range(40)]
    return rows + [(300, None, None, None), (300, 0, None, ""), (300, 0, "", "tie"), (300, 0, "", "tie"), (None, 1, "user", "lost"), (320, 0, "user", "alone"), (-7, 0, "user", "minus"), (-20, 0, "user", " \t\nminus  twenty\x0b")]


def as_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = [tuple(r[n] for n in names) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("seed,ranges", [(1, 1), (2, 4), (3, 30)])
def test_against_plain_python(spark, monkeypatch, seed, ranges):
    rows = made_rows(seed)
    monkeypatch.setattr(prefix_trie, "TASK_TURNS", 20 if ranges > 4 else 10**9)
    turns = spark.createDataFrame(rows, KINDS).repartition(3).withColumns({c: F.lit(1) for c in ("w", "path", "key", "own", "leader", "lead", "digest", "depth", "kind")})
    assert as_rows(prefix_trie.trie_nodes(turns)) == brute(rows)


def test_many_ranges_of_one_path(spark, monkeypatch):
    """All paths begin alike and every range holds few, so nearly every node is shared; the join without broadcast gives the same."""
    monkeypatch.setattr(prefix_trie, "TASK_TURNS", 5)
    monkeypatch.setattr(prefix_trie, "SENT", 0)
    rows = [(c * 20, k, "u", f"t{k}" if k < 12 - c % 9 else f"own{c % 17}") for c in range(60) for k in range(14)]
    assert as_rows(prefix_trie.trie_nodes(spark.createDataFrame(rows, KINDS))) == brute(rows)


def test_twin_on_odd_rows(spark, tmp_path):
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(made_rows(4), KINDS).repartition(2).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    assert same(spark, con, lambda s, p: prefix_trie.trie_nodes(s.read.parquet(p)), prefix_trie.TRIE_SQL, path) > 100


def test_empty_and_long(spark):
    assert prefix_trie.trie_nodes(spark.createDataFrame([], KINDS)).collect() == []
    assert prefix_trie.trie_nodes(spark.createDataFrame([(None, 0, "u", "t")], KINDS)).collect() == []
    rows = [(0, k, "user", "word " * 20_000 if k == 1 else "x") for k in range(3000)] + [(21, k, "user", "y") for k in range(3000)]
    out = {(r["depth"], r["conv_id"]): r for r in prefix_trie.trie_nodes(spark.createDataFrame(rows, KINDS)).collect()}
    assert out[0, 0]["n_convs"] == 2 and max(d for d, _ in out) == 3000 and out[0, 0]["n_leaves"] == 2


def test_given_tables(spark, small):
    from tests.compare import connection

    assert same(spark, connection(small), queries.op13_prefix_trie, prefix_trie.TRIE_SQL, small) > 50
