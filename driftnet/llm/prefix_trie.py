"""Prefix trie of conversations by Patricia construction.

1. Conversations are rebuilt with the first turns of a leading one; a turn is its digest, a conversation the path of its digests. Copies are
   counted and become one path.
2. The paths are range-sorted. A task takes one range and creates only points: ends of paths, branches where neighbours part, leaves.
   Members, least ids, leaves and sums run up this compressed tree; then each edge is expanded to its unary nodes, whose sums are
   suffix sums along the edge.
3. A node that other ranges may share lies on the first or the last path of its range. Those nodes are given out as parts, put together by
   their keys and closed from the deepest up; there are at most 2 x ranges x the longest path of them, whatever the number of conversations.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.llm.common import spool
from driftnet.llm.mixing import word_count

LEADERS, HEAD = 20, 4
#: Bytes of a turn's digest.
STEP = 16
#: Turns of distinct paths that a task holds, about.
TASK_TURNS = 200_000
#: Shared nodes up to which they are broadcast.
SENT = 200_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
PARTS = "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key string, parent_key string, w long"


def rebuilt_paths(turns: DataFrame, leaders: int = LEADERS, head: int = HEAD) -> DataFrame:
    """conv_id, path (16 bytes a turn), w (words of each turn): conversation c takes its first crc32(c) % head turns from c - c % leaders."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    own = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), word_count(text).alias("w"))
    lists = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "w"))).alias("own"))
    lists = spool(lists.select("conv_id", F.transform("own", lambda t: F.struct(t["digest"].alias("digest"), t["w"].alias("w"))).alias("own")), "trie-turns")
    led = lists.filter(F.col("conv_id") % leaders == 0).select(F.col("conv_id").alias("leader"), F.slice("own", 1, head - 1).alias("lead"))
    both = lists.withColumn("leader", F.col("conv_id") - F.col("conv_id") % leaders).join(led, "leader", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % head).cast("int")
    taken = F.when(F.col("lead").isNull(), F.slice("own", 1, 0)).otherwise(F.slice("lead", F.lit(1), h))
    seq = F.concat(taken, F.slice("own", h + 1, F.size("own")))
    return both.select("conv_id", seq.alias("seq")).select("conv_id", F.unhex(F.array_join(F.transform("seq", lambda t: t["digest"]), "")).alias("path"), F.transform("seq", lambda t: t["w"]).alias("w"))


def id_digests(rows: DataFrame) -> DataFrame:
    """key, ends_sha256 for rows (key, conv_id): the digest of the ids in order, taken id by id, so that a group of any size is never held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256(b"%d" % conv)
                else:
                    state.update(b",%d" % conv)
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["key", "ends_sha256"])
                done = []
        if now is not None:
            done.append((now, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["key", "ends_sha256"])

    return rows.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key string, ends_sha256 string")


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common from the start."""
    low, high = 0, min(len(a), len(b)) // STEP
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * STEP : mid * STEP] == b[low * STEP : mid * STEP]:
            low = mid
        else:
            high = mid - 1
    return low


def prefix_keys(path: bytes) -> list[str]:
    """A key for each prefix of a path, from the empty one."""
    state, out = hashlib.md5(), []
    for k in range(0, len(path) + STEP, STEP):
        out.append(f"{k // STEP}-{state.hexdigest()}")
        state.update(path[k : k + STEP])
    return out


class Points:
    """The points of a compressed tree over sorted distinct paths. A point's path is that of `seq` up to `depth`; `first` is the first path below it."""

    def __init__(self, paths: list[bytes], sums: list[list[int]], least: list[int], copies: list[int], digests: list[str]):
        self.paths, self.sums = paths, sums
        self.depth, self.seq, self.first, self.parent, self.shared = [], [], [], [], []
        self.n, self.least, self.leaves, self.below, self.children, self.ends = [], [], [], [], [], []
        stack = [self.add(0, 0, 0)]
        for i, path in enumerate(paths):
            stays = shared_turns(paths[i - 1], path) if i else 0
            while self.depth[stack[-1]] > stays:
                p = stack.pop()
                if self.depth[stack[-1]] < stays:  # the neighbours part within the edge of p
                    stack.append(self.add(stays, i - 1, self.first[p]))
                self.close(p, stack[-1], self.first[p] == 0)
            if len(path) // STEP > stays:
                stack.append(self.add(len(path) // STEP, i, i))
            p = stack[-1]
            self.n[p] += copies[i]
            self.least[p] = least[i] if self.least[p] is None else min(self.least[p], least[i])
            self.ends[p] = digests[i]
        while len(stack) > 1:
            p = stack.pop()
            self.close(p, stack[-1], True)
        self.shared[0] = True

    def add(self, depth: int, seq: int, first: int) -> int:
        for held, v in zip((self.depth, self.seq, self.first, self.parent, self.shared, self.n, self.least, self.leaves, self.below, self.children, self.ends), (depth, seq, first, None, False, 0, None, 0, 0, 0, None), strict=True):
            held.append(v)
        return len(self.depth) - 1

    def close(self, p: int, up: int, shared: bool) -> None:
        """p is complete as far as this range goes; shared: other ranges may have it too, so its sums stay its own."""
        self.parent[p], self.shared[p] = up, shared
        self.n[up] += self.n[p]
        self.least[up] = self.least[p] if self.least[up] is None else min(self.least[up], self.least[p])
        if not shared:
            if not self.children[p]:
                self.leaves[p] = 1
            along = self.sums[self.seq[p]]
            self.below[up] += self.below[p] + (self.n[p] - 1) * (along[self.depth[p]] - along[self.depth[up]])
            self.leaves[up] += self.leaves[p]
            self.children[up] += 1

    def rows(self) -> Iterator[tuple]:
        """Rows of PARTS: kind 0 is a node, 1 a node whose parent is shared (named by parent_key), 2 this range's part of a shared node."""
        starts, ends = prefix_keys(self.paths[0]), prefix_keys(self.paths[-1])
        for p in range(len(self.depth)):
            up, depth, along = self.parent[p], self.depth[p], self.sums[self.seq[p]]
            top = -1 if up is None else self.depth[up]
            if self.shared[p]:
                keys = starts if self.first[p] == 0 else ends
                for d in range(depth, top, -1):
                    own = (self.children[p], self.leaves[p], self.below[p], self.ends[p]) if d == depth else (0, 0, 0, None)
                    yield (2, self.least[p], d, None, self.n[p], *own, keys[d], keys[d - 1] if d else None, along[d] - along[d - 1] if d else 0)
                continue
            saved = self.below[p]
            for d in range(depth, top, -1):
                saved += (self.n[p] - 1) * (along[d] - along[d - 1])
                above, key = self.least[p], None
                if d == top + 1:
                    above = None if self.shared[up] else self.least[up]
                    key = (starts if self.first[up] == 0 else ends)[top] if self.shared[up] else None
                ended = self.ends[p] if d == depth else None
                yield (0 if key is None else 1, self.least[p], d, above, self.n[p], self.children[p] if d == depth else 1, self.leaves[p], saved, ended or NO_ENDS, None, key, 0)


def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of sorted paths (path, w, least, copies, ends_sha256) to rows of PARTS."""
    held: list[list] = [[], [], [], [], []]
    for batch in batches:
        for into, column in zip(held, batch.columns, strict=True):
            into.extend(column.to_pylist())
    if not held[0]:
        return
    sums = []
    for words in held[1]:
        sums.append(at := [0])
        for w in words:
            at.append(at[-1] + w)
    kinds = [pa.int32(), *[pa.int64()] * 7, *[pa.string()] * 3, pa.int64()]
    names = [x.split()[0] for x in PARTS.split(", ")]
    block: list[tuple] = []
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    for row in Points(held[0], sums, *held[2:]).rows():
        block.append(row)
        if len(block) >= 20_000:
            yield pack(block)
            block = []
    if block:
        yield pack(block)


def close_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared nodes, the deepest first, to nodes: sums of their shared children are added to their own."""
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            k, up = r["key"], r["parent_key"]
            n_children = r["n_children"] + children.pop(k, 0)
            n_leaves = r["n_leaves"] + leaves.pop(k, 0) if n_children else 1
            total = r["saved_tokens"] + saved.pop(k, 0) + (r["n_convs"] - 1) * r["w"]
            if up is not None:
                children[up] += 1
                leaves[up] += n_leaves
                saved[up] += total
            out.append((k, up, r["conv_id"], r["depth"], r["n_convs"], n_children, n_leaves, total, r["ends_sha256"] or NO_ENDS))
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 6, pa.string()]
        names = ["key", "parent_key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 9, kinds, strict=True)], names=names)


def trie_nodes(turns: DataFrame, leaders: int = LEADERS, head: int = HEAD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for every distinct prefix of the rebuilt conversations.

    turns needs conv_id, turn, role and text; other columns are ignored, whatever their names. Turns stand in the order of `turn`, null first,
    equal ones in the order of their digests (of role and text), and repeated rows are turns of their own. A null role or text is empty; rows without
    a conv_id belong to no conversation and are left out. Turns are equal if role and text are (their 128-bit digests). Texts leave no task: a conversation travels as 16 bytes and a number for
    each turn, in one row. Ids of copies are digested one by one. An empty table gives no node, not even a root.
    """
    spark = turns.sparkSession
    paths = spool(rebuilt_paths(turns, leaders, head).withColumn("key", F.md5("path")), "trie-paths")
    groups = paths.groupBy("key").agg(F.first("path").alias("path"), F.first("w").alias("w"), F.min("conv_id").alias("least"), F.count("*").alias("copies"))
    distinct = spool(groups.join(id_digests(paths), "key").select("path", "w", "least", "copies", "ends_sha256"), "trie-distinct")
    n_turns = distinct.agg(F.coalesce(F.sum(F.size("w")), F.lit(0))).first()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_turns // TASK_TURNS)
    parts = spool(distinct.repartitionByRange(ranges, "path").sortWithinPartitions("path").mapInArrow(grow, PARTS), "trie-parts")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    met = parts.filter("kind = 2").groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"), F.first("parent_key").alias("parent_key"), F.first("w").alias("w"))
    kinds = "key string, parent_key string, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    shared = spool(met.repartition(1).sortWithinPartitions(F.desc("depth")).mapInArrow(close_shared, kinds), "trie-shared")
    above = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    above = F.broadcast(above) if shared.count() <= SENT else above
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = parts.filter("kind = 1").drop("parent_conv_id").join(above, "parent_key")
    return parts.filter("kind = 0").select(columns).unionByName(top.select(columns)).unionByName(shared.join(above, "parent_key", "left").select(columns))


TRIE_SQL = r"""WITH t AS (SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT c, turn, md5(concat(length(r), ':', r, x)) AS g, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM t),
own AS MATERIALIZED (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) AS p, g, w FROM g),
h AS MATERIALIZED (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 4 AS h FROM (SELECT DISTINCT c FROM own)),
seq AS (SELECT h.c, own.p, own.g, own.w FROM h JOIN own ON own.c = h.c - h.c % 20 AND own.p <= h UNION ALL SELECT own.c, own.p, own.g, own.w FROM own JOIN h USING (c) WHERE own.p > h.h),
put AS MATERIALIZED (SELECT c, row_number() OVER (PARTITION BY c ORDER BY p) AS d, g, w FROM seq),
pre AS MATERIALIZED (SELECT c, 0 AS d, '' AS k, NULL AS up, 0 AS w FROM h
  UNION ALL SELECT c, d, md5(string_agg(g, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)), CASE d WHEN 1 THEN '' ELSE md5(string_agg(g, '') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END, w FROM put),
size AS (SELECT c, max(d) AS n FROM pre GROUP BY c),
node AS MATERIALIZED (SELECT d, k, any_value(up) AS up, min(c) AS c, count(*) AS n, any_value(w) AS w, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = size.n), '') AS ends FROM pre JOIN size USING (c) GROUP BY d, k),
kids AS (SELECT up AS k, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
full_node AS MATERIALIZED (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (d, k)),
sums AS (SELECT a.d, a.k, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n - 1) * b.w) AS saved FROM full_node b JOIN pre a ON a.c = b.c AND a.d <= b.d GROUP BY 1, 2)
SELECT f.c AS conv_id, CAST(f.d AS BIGINT) AS depth, above.c AS parent_conv_id, f.n AS n_convs, f.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_node f JOIN sums s USING (d, k) LEFT JOIN node above ON above.d = f.d - 1 AND above.k = f.up"""
