"""Near-duplicates by an inverted join on signature coordinates.

1. Every text becomes its set of word shingles (64-bit hashes) and a MinHash signature. Texts of equal sets form a class.
2. Each class posts the first coordinates of its signature. A class that is to agree with another in `agree` coordinates shares at
   least HEAD - (COORDINATES - agree) of its first HEAD coordinates with some class; the others leave.
3. The rest post all coordinates. By the prefix principle two classes that agree in `agree` coordinates share one of their
   COORDINATES - agree + 1 rarest coordinates, so only those postings are read. The least class of a
   posting list leads it; classes meet under their leaders, so a list never spells out its pairs.
4. Within the group of a leader, members post their coordinates again; postings of each member's rarest ones are merged, those that are joined
   already are skipped, collisions are counted, pairs above the match threshold are confirmed on the full sets, and only links that join two yet unjoined classes are given out (a spanning forest, which keeps the components).
   Groups beyond BLOCK shingles are cut into blocks. Each block is worked by itself, together with about GUESTS members of the whole group;
   in a group of near copies this joins most members. Only members outside the group's largest component by then (strays) meet the other blocks, so
   such a group costs its size and not the square of it.
5. Components of the links give each document the least doc_id it reaches.

A pair at similarity 0.8 agrees in fewer than `agree` of 128 coordinates with a probability below 1e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.llm.common import LIVING, free_names, give_back, living, ragged, spool, trimmed, words_of

COORDINATES, AGREE, HEAD = 128, 77, 64
#: Shingles of one block of a leader's group; a task holds two blocks.
BLOCK = 3_000_000
#: Bytes of a group after which a worker gives freed memory back.
LARGE_GROUP = 8_000_000
#: Members of a group that sit in all its blocks, on average.
GUESTS = 8
#: Keys with more than one in LARGE of all rows are broadcast; there are fewer than LARGE of them.
LARGE = 10_000
#: Distinct words whose hashes a worker remembers.
REMEMBERED = 400_000
SEED = 7
ONE = np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words, alike in every process."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; of a shorter text, the hash of all its words; empty without words."""
    words = words_of(text or "")
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = living("word hashes", WordHashes)
    if len(hashes) > REMEMBERED:
        hashes.clear()
    a = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(width, len(a))
    n = len(a) - k + 1
    h = np.full(n, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(31) + a[i : i + n])
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + ONE


def signature(s: np.ndarray, by: np.ndarray) -> np.ndarray:
    """For each multiplier the upper half of the least product, as int32."""
    out = np.full(len(by), np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(s), 4096):
        out = np.minimum(out, (s[a : a + 4096][None, :] * by[:, None]).min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signing(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = multipliers(COORDINATES)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a in range(0, len(texts), 1024):
                sets = [shingle_set(t, width) for t in texts[a : a + 1024].to_pylist()]
                marks = [fingerprint(s) if len(s) else None for s in sets]
                signs = [signature(s, by) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([ids[a : a + 1024], pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), pa.array(signs, pa.list_(pa.int32())), *(c[a : a + 1024] for c in batch.columns[2:])], names=["doc_id", "n_shingles", "mark", "sig", *batch.schema.names[2:]])

    return trimmed(run)


def full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for a in range(0, len(texts), 256):
                sets = [s for s in (shingle_set(t, width) for t in texts[a : a + 256].to_pylist()) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["mark", "shingles"])

    return trimmed(run)


def linking(marks: list[bytes], signs: np.ndarray, sets: list[np.ndarray], side: np.ndarray, agree: int, percent: int, roots: list[bytes] | None = None) -> list[tuple[bytes, bytes]]:
    """Links of a spanning forest over the confirmed pairs; with two sides only pairs across them count, members of equal roots are joined already.

    Members post their coordinates. Each reads the postings of its COORDINATES - agree + 1 rarest coordinates behind its own place, which every partner
    that agrees in `agree` is in; members that are joined to it already, too large or of its own side are skipped, and only for the others are collisions counted.
    """
    order = sorted(range(len(marks)), key=lambda k: (len(sets[k]), marks[k]))
    signs = np.ascontiguousarray(signs[order])
    sizes = np.array([len(sets[k]) for k in order], dtype=np.int64)
    sides, two = side[order], side.min() != side.max()
    width = signs.shape[1]
    tokens = (np.arange(width, dtype=np.int64) << 32) | signs.view(np.uint32)
    _, at, df = np.unique(tokens.ravel(), return_inverse=True, return_counts=True)
    postings = np.argsort(at, kind="stable") // width  # by token, members in their order
    starts, at = np.cumsum(df) - df, at.reshape(tokens.shape)
    read = np.zeros(len(df), dtype=np.int64)  # of each list, how far members have come
    tree = np.unique(np.array(roots or marks, dtype=object)[order], return_inverse=True)[1]
    out = []
    for x in range(len(order) - 1):
        own = at[x]
        read[own] += 1
        last = int(np.searchsorted(sizes, sizes[x] * 100 // percent, side="right"))
        if (tree[x + 1 : last] == tree[x]).all():
            continue
        rare = own[np.argsort(df[own], kind="stable")[: width - agree + 1]]
        near = np.unique(postings[ragged(starts[rare] + read[rare], df[rare] - read[rare])])
        near = near[(near < last) & (tree[near] != tree[x])]
        if two:
            near = near[sides[near] != sides[x]]
        agreed = (signs[near] == signs[x]).sum(axis=1)
        for y in near[np.argsort(-agreed, kind="stable")][: int((agreed >= agree).sum())].tolist():
            if tree[x] == tree[y]:
                continue
            a, b = sets[order[x]], sets[order[y]]
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= percent * (len(a) + len(b) - both):
                tree[tree == tree[y]] = tree[x]
                out.append((marks[order[x]], marks[order[y]]))
    return out


def link_groups(agree: int, percent: int):
    def run(key, held):
        LIVING.clear()  # word hashes are of no more use
        marks = held.column("mark").to_pylist()
        sets = [np.frombuffer(s, dtype=np.uint64) for s in held.column("shingles").to_pylist()]
        signs = np.array(held.column("sig").to_pylist(), dtype=np.int32)
        side = held.column("side").to_numpy()
        links = linking(marks, signs, sets, side, agree, percent, held.column("root").to_pylist())
        if held.nbytes > LARGE_GROUP:
            del sets, signs, marks
            give_back()
        return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})

    return run


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of the links a - b, root being the least node of the component.

    Alternating large-star and small-star steps on tables in the shared folder; the driver sees only counts.
    """
    edges = spool(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = spool(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
        # done when all edges are stars: no node is both a child and a parent, and no child has two parents
        parents = after.select(F.col("v").alias("u")).distinct()
        open_ends = after.join(parents, "u", "left_semi").limit(1).count() or after.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
        edges = after
        if not open_ends:
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def meet(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with keyed, a written table with a row for each key and n, its number of rows. Keys with more than 1 / LARGE of all rows
    are fewer than LARGE and go to every task; the others' rows meet theirs by a shuffle."""
    large = F.broadcast(keyed.filter(F.col("n") > total / LARGE).drop("n"))
    small = keyed.filter(F.col("n") <= total / LARGE).drop("n")
    return rows.join(large, key).unionByName(rows.join(large.select(key), key, "left_anti").join(small, key))


def class_links(docs: DataFrame, signed: DataFrame, width: int, percent: int, agree: int) -> DataFrame:
    """Links a - b between classes (marks of sets), enough to connect every component."""
    spark = docs.sparkSession
    classes = spool(signed.filter("mark IS NOT NULL").groupBy("mark").agg(F.first("sig").alias("sig"), F.first("n_shingles").alias("n"), F.min("doc_id").alias("doc_id")), "classes")

    def posted(df: DataFrame, coordinates: int) -> DataFrame:
        at = F.posexplode(F.slice("sig", 1, coordinates)).alias("i", "v")
        return df.select("mark", at).select("mark", F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("token"))

    def shared(df: DataFrame, coordinates: int) -> tuple[DataFrame, DataFrame]:
        own = posted(df, coordinates)
        return own, own.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")

    own, common = shared(classes, HEAD)
    least_shared = HEAD - (COORDINATES - agree)
    likely = own.join(common, "token").groupBy("mark").agg(F.count("*").alias("n_shared")).filter(F.col("n_shared") >= least_shared)
    likely = spool(classes.join(likely.select("mark"), "mark", "left_semi"), "likely")
    own, common = shared(likely, COORDINATES)
    counted = own.join(common, "token")
    # unshared coordinates come first in the order by rarity; what is left of the prefix goes to the rarest shared ones
    spare = F.lit(COORDINATES - agree + 1) - (F.lit(COORDINATES) - F.size("shared"))
    rare = counted.groupBy("mark").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))  # 128 entries at most
    prefix = spool(rare.select("mark", F.explode(F.slice("shared", F.lit(1), F.greatest(spare, F.lit(0)))).alias("p")).select("mark", F.col("p.token").alias("token")), "prefix")
    leaders = spool(prefix.groupBy("token").agg(F.min("mark").alias("leader"), F.count("*").alias("n")).filter("n > 1"), "leaders")
    met = spool(meet(prefix, leaders, "token", prefix.count()).select("leader", "mark").distinct(), "met")
    wanted = met.select("mark").distinct()
    ids = likely.join(wanted, "mark", "left_semi").select("doc_id")
    texts = docs.select("doc_id", "text").join(ids.select(F.col("doc_id").alias("own")), F.col("doc_id").eqNullSafe(F.col("own")), "left_semi").select("text")
    sets = texts.mapInArrow(full_sets(width), "mark binary, shingles binary").dropDuplicates(["mark"])
    data = spool(sets.join(likely.select("mark", "sig", "n"), "mark"), "sets")
    per_leader = met.join(data.select("mark", F.col("n").alias("size")), "mark").groupBy("leader").agg(F.ceil(F.sum("size") / F.lit(BLOCK)).cast("int").alias("blocks"), F.count("*").alias("n"))
    per_leader = spool(per_leader.withColumn("members", F.col("n")), "per-leader")
    cut = spool(meet(met, per_leader, "leader", met.count()).withColumn("block", F.pmod(F.xxhash64("mark"), F.col("blocks")).cast("int")), "cut")

    def linked(groups: DataFrame) -> DataFrame:
        held = groups.join(data, "mark").select(*groups.columns, "sig", "shingles")
        return held.groupBy("leader", "strays", "block").applyInArrow(link_groups(agree, percent), "a binary, b binary")

    guest = (F.col("mark") == F.col("leader")) | (F.pmod(F.xxhash64("leader", "mark"), F.col("members")) < GUESTS)
    seats = F.when(guest, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    once = cut.select("leader", "mark", F.explode(seats).alias("block"))
    links = spool(linked(once.select("leader", F.lit(0).alias("strays"), "block", F.lit(0).alias("side"), "mark", F.col("mark").alias("root"))), "links")
    large = cut.filter("blocks > 1")
    if large.limit(1).count() == 0:
        return links
    # block k of strays meets every block of members
    roots = components(links)
    rooted = large.join(roots.withColumnRenamed("node", "mark"), "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    rooted = spool(rooted.join(data.select("mark", F.col("n").alias("size")), "mark").select("leader", "mark", "root", "block", "blocks", "size"), "rooted")
    per_root = rooted.groupBy("leader", "root").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    stray_blocks = F.ceil((F.sum("size") - F.max("size")) / F.lit(BLOCK)).cast("int")
    largest = per_root.groupBy("leader").agg(F.max_by("root", F.struct("size", "root")).alias("largest"), stray_blocks.alias("stray_blocks"), F.sum("n").alias("n")).filter("stray_blocks > 0")
    told = spool(meet(rooted, spool(largest, "largest"), "leader", rooted.count()), "told")
    stray = F.pmod(F.xxhash64("mark"), F.col("stray_blocks")).cast("int")
    guests = told.filter("root != largest").select("leader", stray.alias("strays"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "mark", "root")
    hosts = told.select("leader", F.explode(F.sequence(F.lit(0), F.col("stray_blocks") - 1)).alias("strays"), "block", F.lit(0).alias("side"), "mark", "root")
    return links.unionByName(linked(guests.unionByName(hosts)))


def signed_and_rooted(docs: DataFrame, width: int, percent: int, agree: int, keyed: bool = False) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles, mark, sig and, if keyed, text_key of every row; mark, root of every class that has links."""
    key = [F.xxhash64("text").alias("text_key")] if keyed else []
    signed = spool(docs.select("doc_id", "text", *key).mapInArrow(signing(width), f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, mark binary, sig array<int>" + (", text_key long" if keyed else "")), "signed")
    links = class_links(docs, signed, width, percent, agree)
    return signed, spool(components(links), "roots").select(F.col("node").alias("mark"), "root")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, agree: int = AGREE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Rows whose sets satisfy 100 * intersection >= percent * union are linked; component_id is the least doc_id that can be reached,
    kept says that it is the own one. agree must fit percent (77 of 128 for 80). docs needs doc_id and text; other columns are ignored, whatever
    their names. Null and wordless texts have no shingles, are linked with nothing and are kept. Repeated rows share a set
    and so a component; of repeated ids all rows count as the same document. A null id never is a component_id unless its
    component has no other; such rows are kept.
    """
    signed, roots = signed_and_rooted(docs, width, percent, agree)
    worded = signed.filter("mark IS NOT NULL").select("doc_id", "n_shingles", "mark")
    classes = worded.groupBy("mark").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"))
    rooted = classes.join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    per_root = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = spool(rooted.join(per_root, "root").select("mark", "component_id", "n"), "component-ids")
    met = meet(worded, found, "mark", worded.count())
    out = met.select("doc_id", "n_shingles", "component_id").unionByName(signed.filter("mark IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, agree: int = AGREE) -> DataFrame:
    """The rows of docs that are kept, with all their columns; one row of each component, wordless rows all.

    The row of the least doc_id stays, one with a null id only where no other has an id. Rows are told apart by doc_id and text: null ids
    and repeated ids alone join nothing. Of rows that share both the one stays whose columns have the least hash.
    """
    signed, roots = signed_and_rooted(docs, width, percent, agree, keyed=True)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    rows = signed.filter("mark IS NOT NULL").groupBy("mark", rank.alias("rank")).agg(F.count("*").alias("n"))
    first = rows.groupBy("mark").agg(F.min(F.struct("rank", "n")).alias("first"))
    kept = first.join(roots, "mark", "left").groupBy(F.coalesce("root", "mark").alias("root")).agg(F.min("first").alias("first"))
    own_id, own_key, n = free_names(docs, "own_id", "own_key", "n_rows")
    kept = spool(kept.select(F.col("first.rank.doc_id").alias(own_id), F.col("first.rank.text_key").alias(own_key), F.col("first.n").alias(n)), "kept-rows")
    pick = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_key))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    once, again = kept.filter(F.col(n) == 1), kept.filter(F.col(n) > 1)
    left = docs.filter(~worded).unionByName(docs.filter(worded).join(once, pick, "left_semi"))
    return left if again.limit(1).count() == 0 else left.unionByName(first_of_equal(docs.filter(worded).join(again, pick, "left_semi")))


def first_of_equal(docs: DataFrame) -> DataFrame:
    """One of the rows that share a doc_id and a text."""
    columns = docs.columns
    row, key = free_names(docs, "own_row", "own_key")
    one = docs.groupBy("doc_id", F.xxhash64("text").alias(key)).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(row))
    return one.select(F.col(row)["doc_id"].alias("doc_id"), *[F.col(row)[c].alias(c) for c in columns if c != "doc_id"]).select(*columns)
