"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The rows of each partition are counted, and how many rows each partition sends to each shard is drawn (a multivariate hypergeometric draw, so that the columns
add up to the exact shard sizes). The draw goes down a tree of partition numbers: the pool of a node is dealt to its 256 children, each node by a task with a seed of its
own, so that nothing of the matrix passes through the driver. Every partition permutes its rows and cuts them by its line of the matrix, the rows are
exchanged, and each shard permutes what it received. The result is a uniform permutation of all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftnet.llm.common import spool, text_bytes

#: Rows that one task orders in the second permutation, on average.
BLOCK_ROWS = 500_000
#: A node of the draw has 2 ** FAN children.
FAN = 8
#: Populations from which numpy's own draw is left for an inversion.
LARGE = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` items taken without replacement from good + bad items are good, by inversion at any population size."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(max((good + 1) * (draws + 1) // (good + bad + 2), low), high)
    mean_share = good / (good + bad)
    spread = math.sqrt(draws * mean_share * (1 - mean_share)) + 1
    a, b = max(low, mode - int(12 * spread) - 40), min(high, mode + int(12 * spread) + 40)
    k = np.arange(a, b, dtype=np.float64)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(step)))
    weights = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(weights, rng.random() * weights[-1], side="right").clip(0, b - a))


def deal(rng: np.random.Generator, pool: np.ndarray, rows: list[int]) -> list[np.ndarray]:
    """The pool (rows that each shard is to get) dealt at random to receivers that hold so many rows each."""
    left, out = pool.astype(np.int64).copy(), []
    for n in rows:
        if int(left.sum()) < LARGE:
            own = rng.multivariate_hypergeometric(left, n, method="marginals").astype(np.int64)
        else:
            own, others, due = np.zeros_like(left), int(left.sum()), n
            for k, size in enumerate(left.tolist()):
                own[k] = hypergeometric(rng, size, others - size, due) if due else 0
                others, due = others - size, due - int(own[k])
        left -= own
        out.append(own)
    return out


def shard_sizes(total: int, shards: int) -> np.ndarray:
    return np.array([total // shards + (k < total % shards) for k in range(shards)], dtype=np.int64)


def communication_lines(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """part, line: the rows that each partition (part, n) sends to each shard; lines add up to n, columns to sizes at most one apart."""
    total, last = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("part"), F.lit(0))).first()
    levels = max(1, -(-int(last).bit_length() // FAN))
    spark = counts.sparkSession
    pools = spark.createDataFrame([(0, shard_sizes(total, shards).tolist())], "node long, pool array<long>")
    for level in range(levels):
        child = F.shiftright(F.col("part").cast("long"), FAN * (levels - 1 - level))

        def draw(node: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("child")
            rng = np.random.default_rng([seed, int(node[0]), int(rows["child"].iloc[-1])])
            return pd.DataFrame({"node": rows["child"], "pool": deal(rng, np.asarray(rows["pool"].iloc[0], dtype=np.int64), rows["n"].tolist())})

        sums = counts.groupBy(child.alias("child")).agg(F.sum("n").alias("n")).withColumn("node", F.shiftright("child", FAN))
        pools = sums.join(pools, "node").groupBy("node").applyInPandas(draw, "node long, pool array<long>")
    return pools.select(F.col("node").cast("int").alias("part"), F.col("pool").alias("line"))


def shuffle_rows(rows: DataFrame, shards: int, seed: int = 20) -> DataFrame:
    """rows with shard (0 to shards - 1), slot (0 upwards without gaps in each shard); shard sizes differ by one at most.

    Columns named part, pos, place, block, spot, start, line, shard or slot are not allowed in rows: a ValueError; pass an own projection.
    """
    taken = {"part", "pos", "place", "block", "spot", "start", "line", "shard", "slot"} & {c.lower() for c in rows.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} clash with those of the shuffle")
    placed = spool(rows.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), "shard-rows")
    counts = spool(placed.groupBy("part").agg(F.count("*").alias("n")), "shard-counts")
    lines = spool(communication_lines(counts, shards, seed), "shard-lines")
    # The written files keep the partitions, but a read may split or join them: ranks are taken by `part` itself.
    order = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), "pos"), "pos")
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.aggregate(F.slice("line", F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x))
    cut = lines.select("part", ends.alias("line"))
    ranked = placed.withColumn("place", F.row_number().over(order)).join(cut, "part")
    sent = ranked.withColumn("shard", F.size(F.filter("line", lambda e: e < F.col("place")))).drop("part", "place", "line")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // (shards * BLOCK_ROWS)))
    spot = F.xxhash64(F.lit(seed + 1), "pos")
    sent = spool(sent.withColumn("spot", spot).withColumn("block", F.pmod(F.shiftright("spot", 20), F.lit(blocks)).cast("int")), "shard-sent")
    sizes = sent.groupBy("shard", "block").agg(F.count("*").alias("n"))  # shards x blocks rows
    order = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "block").orderBy("spot", "pos")
    out = sent.withColumn("place", F.row_number().over(within)).join(starts, ["shard", "block"])
    return out.withColumn("slot", (F.col("start") + F.col("place") - 1).cast("long")).drop("block", "spot", "start", "place", "pos")


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs, under the law `rows`.

    docs needs doc_id and text; other columns are ignored, whatever their names. size is the UTF-8 length of the
    text (null: 0) plus 16; the checksum of a null text is that of the empty one. Equal rows, null and repeated ids are
    placed like any others: a uniform shuffle spreads groups of equal texts, it does not keep them together. With
    fewer rows than shards the last shards stay empty; an empty table gives an empty result. grown_shard is null, as
    only the law `key` defines it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (text_bytes(F.col("text")) + 16).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = shuffle_rows(rows, shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
