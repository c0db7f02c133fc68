"""Queries over the key space: nearest keys, buckets, node states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftnet.functions import binary as B

BUCKET = 80
NEAREST = 8


def closest(queries: DataFrame, nodes: DataFrame, k: int = NEAREST, bits: int = 0) -> DataFrame:
    """target, id, distance, rank: the k nodes nearest to each target under XOR, exactly.

    A nearer node shares a longer prefix with the target. Nodes are counted by prefix for each length up to `bits`; a target
    reads only the nodes below its longest prefix that has at least k of them, an equi join. Where no prefix of any
    length has k, the empty prefix takes all nodes. bits = 0 takes the length at which prefixes have about k nodes, so that the
    nodes read for a target do not grow with their number.
    """
    if bits <= 0:
        n = nodes.count()
        bits = 4
        while n > k << bits and bits < 120:
            bits += 4
    lengths = F.explode(F.sequence(F.lit(0), F.lit(bits), F.lit(4))).alias("len")
    head = lambda c: F.substring(c, F.lit(1), (F.col("len") / 4).cast("int"))
    sizes = nodes.select("id", lengths).select("len", head(F.col("id")).alias("prefix")).groupBy("len", "prefix").agg(F.count("*").alias("n")).filter((F.col("n") >= k) | (F.col("len") == 0))
    asked = queries.select("target").distinct().select("target", lengths).withColumn("prefix", head(F.col("target")))
    chosen = asked.join(sizes, ["len", "prefix"]).groupBy("target").agg(F.max(F.struct("len", "prefix")).alias("p")).select("target", "p.*")
    filed = nodes.select("id", lengths).withColumn("prefix", head(F.col("id")))
    near = chosen.join(filed, ["len", "prefix"]).withColumn("distance", B.xor(F.col("target"), F.col("id")))
    rank = F.row_number().over(Window.partitionBy("target").orderBy("distance"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("target", "id", "distance", "rank")


def exact_or_closest(queries: DataFrame, nodes: DataFrame, k: int = NEAREST) -> DataFrame:
    """The node itself where the target is one, else the k nearest."""
    own = queries.select("target").distinct().join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    exact = own.select("target", F.col("target").alias("id"), F.lit("0" * 40).alias("distance"), F.lit(1).alias("rank"))
    return exact.unionByName(closest(queries.join(own, "target", "left_anti"), nodes, k))


def bucket_counts(nodes: DataFrame, origin: Column) -> DataFrame:
    """bucket (leading zero bits of the distance to the origin), n, room under the bucket size."""
    bucket = B.leading_zeros(B.xor(F.col("id"), origin))
    return nodes.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).withColumn("room", F.greatest(F.lit(BUCKET) - F.col("n"), F.lit(0)))


def oldest(nodes: DataFrame, before: int, n: int = 0) -> DataFrame:
    """Nodes that have been silent since before, longest first; n = 0 gives all."""
    stale = nodes.filter(F.col("last_responded") < before).orderBy("last_responded", "id")
    return stale.limit(n) if n else stale


def sample_candidates(nodes: DataFrame, now: int) -> DataFrame:
    """Nodes that may be asked for a sample: not known to refuse, due, and silent for five seconds."""
    return nodes.filter((F.col("bep51") != "no") & (F.col("next_sample") < now) & (F.col("last_responded") < now - 5))


def unknown_addresses(addresses: DataFrame, known: DataFrame) -> DataFrame:
    return addresses.join(known.select("addr"), "addr", "left_anti")


def random_sample(hashes: DataFrame, nodes: DataFrame, seed: int, most: int = 20) -> DataFrame:
    """Up to `most` hashes and, for each that is missing, a node more; with the total of hashes."""
    total = hashes.agg(F.count("*").alias("total"))
    some = hashes.select("id").orderBy(F.xxhash64(F.lit(seed), "id")).limit(most)
    n = F.lit(2 * most) - F.least(F.col("total"), F.lit(most))
    order = Window.orderBy("r")
    drawn = nodes.select("id", F.xxhash64(F.lit(seed), "id").alias("r")).orderBy("r").limit(2 * most).withColumn("k", F.row_number().over(order))
    picked = drawn.crossJoin(F.broadcast(total)).filter(F.col("k") <= n).select("id")
    return some.withColumn("kind", F.lit("hash")).unionByName(picked.withColumn("kind", F.lit("node"))).crossJoin(F.broadcast(total))


def routing_feedback(events: DataFrame) -> DataFrame:
    """Nodes that are in after all put and drop events: the last event of each decides. events: id, seq, kind."""
    return events.groupBy("id").agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq")).filter("kind = 'put'").select("id", "seq")


def next_sample(now: Column, interval: Column, n_new: Column) -> Column:
    """When a node may be asked again: news shorten a long interval to a minute, none add five minutes and never lie in the past."""
    return F.when(n_new > 0, now + F.when(interval > 300, 60).otherwise(interval)).otherwise(F.greatest(now + interval + 300, now))
