"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

1. Sources share the budget by weight; none gets more than `most` times its size, what is left over is shared again by weight.
2. Each source's documents stand in shuffled order and are offered `most` times over. A pass of a document has the virtual finish time
   (words of its source up to its end) / (the source's target), so every source reaches its target at time 1. The document in
   service at its source's target is offered in two parts, so that a long document cannot overshoot it.
3. The whole queue is range-sorted by finish time, its words are summed up in that order, and it is cut off at the budget.

Running sums are taken in two steps, over blocks of a source's shuffle (ranges of finish times) and within each. The number of blocks is
the square root of the number of rows, so no task holds a source or the queue.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftnet.llm.common import spool

WEIGHTS = (5, 2, 1)
SHARE_PERCENT, MOST, SEED = 150, 2, 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(lanes: DataFrame) -> DataFrame:
    """lanes with at, the place of each in the order of `lane`, from 0; no task orders them all."""
    put = F.monotonically_increasing_id()
    ordered = spool(lanes.orderBy("lane").withColumns({"part": F.shiftright(put, 33), "place": put.bitwiseAND(F.lit((1 << 33) - 1))}), "mix-lanes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of the sort
    starts = ordered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ordered.join(starts, "part").select(*lanes.columns, (F.col("start") + F.col("place")).alias("at"))


def targets(lanes: DataFrame, weights: tuple[int, ...], share_percent: int, most: int) -> DataFrame:
    """lane, at, source_size, target for lanes (lane, source_size).

    Sources in the order of `lane` have the weights in turn. A round finds the sources that a share by weight would lift to their cap
    and shares what is left among the others, until no further one reaches its cap; the driver sees two sums a round.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    held = spool(numbered(lanes).withColumn("weight", weight.cast("long")), "mix-weights")
    total, every = held.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    full, capped, shared, known = F.lit(False), 0, every, -1
    exact = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    while True:
        left = share_percent * total - 100 * capped
        full = F.col("source_size") * exact(100 * most * shared) <= F.col("weight") * exact(left)
        n, size, taken = held.filter(full).agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == known:
            break
        known, capped, shared = n, most * size, every - taken
    budget = share_percent / 100 * total
    part = F.col("weight") * F.lit(float(budget - capped)) / F.lit(float(shared)) if shared else F.lit(0.0)
    return held.select("lane", "at", "source_size", F.when(full, (F.col("source_size") * most).cast("double")).otherwise(part).alias("target"))


def queue(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The ordered mix: row, doc_id, source, size, source_size, target, pass_no, words, finish, position, taken.

    docs needs doc_id, source and text; other columns are ignored, whatever their names. A row of docs has up to most + 1 rows, as its
    passes, one of them perhaps in two parts; those without words have one row of 0 words. position is the number of
    words ahead in the queue; taken is what of the words lies within the budget, which is the sum of the targets' whole words.
    The shuffle depends on doc_id alone, so reruns agree; rows of the same doc_id stand in the order of their sizes, and rows alike in
    doc_id, source and size are alike in the result. A null doc_id is a value like any other, so is a null source, which comes last.
    Documents are ordered whole, whatever their length. An empty table gives an empty result; where no text has words, all targets are 0.
    """
    lane = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    spot = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    rows = docs.select("doc_id", "source", lane.alias("lane"), spot.alias("spot"), word_count(F.col("text")).alias("size"))
    rows = spool(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    blocks = max(1, math.isqrt(rows.count()))
    first = F.conv(F.substring("spot", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("block", F.floor(first * blocks / (1 << 32)).cast("int"))
    sums = spool(rows.groupBy("lane", "block").agg(F.sum("size").alias("n")), "mix-blocks")
    goals = spool(targets(sums.groupBy("lane").agg(F.sum("n").alias("source_size")), weights, share_percent, most), "mix-targets")
    budget = goals.agg(F.coalesce(F.sum(F.floor("target")), F.lit(0))).first()[0]
    before = Window.partitionBy("lane").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("lane", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).join(goals, "lane")
    within = Window.partitionBy("lane", "block").orderBy("spot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(starts, ["lane", "block"]).withColumn("end", F.col("start") + F.sum("size").over(within))
    goal = F.floor("target")
    parts = []
    for k in range(most):
        a, b = F.col("end") - F.col("size") + k * F.col("source_size"), F.col("end") + k * F.col("source_size")
        cut = F.greatest(a, F.least(b, goal))
        parts += [F.struct(F.lit(k + 1).alias("pass_no"), F.lit(past).alias("past"), (y - x).alias("words"), y.alias("upto")) for past, x, y in ((0, a, cut), (1, cut, b))]
    empty = F.array(F.struct(F.lit(1).alias("pass_no"), F.lit(0).alias("past"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("upto")))
    packets = F.when(F.col("size") == 0, empty).otherwise(F.filter(F.array(*parts), lambda p: p["words"] > 0))
    # documents without words take no service; they are spread over the queue
    finish = F.when(F.col("words") == 0, first / (1 << 32)).otherwise(F.col("upto") / F.col("target"))
    offered = placed.withColumn("packet", F.explode(packets)).select("row", "doc_id", "source", "size", "source_size", "target", "at", "spot", "packet.*").withColumn("finish", finish)
    # ranges of equal width up to time 1, then ever wider ones: the density of a shuffled queue does not grow with time
    span = F.when(F.col("finish") <= 1, F.floor(F.col("finish") * blocks)).otherwise(blocks + F.floor(F.log2("finish") * blocks))
    offered = spool(offered.withColumn("span", span).drop("spot"), "mix-queue")
    spans = offered.groupBy("span").agg(F.sum("words").alias("n"))
    ahead = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    opened = spans.select("span", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("opened"))
    line = Window.partitionBy("span").orderBy("finish", "past", "at", "upto").rowsBetween(Window.unboundedPreceding, 0)
    position = F.col("opened") + F.sum("words").over(line) - F.col("words")
    out = offered.join(opened, "span").withColumn("position", position)
    taken = F.least(F.col("words"), F.greatest(F.lit(0), F.lit(budget) - F.col("position")))
    return out.select("row", "doc_id", "source", "size", "source_size", "target", "pass_no", "words", "finish", "position", taken.cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs: the queue's parts put together; options as in `queue`."""
    return queue(docs, **options).groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken")).drop("row")


MIX_SQL = r"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, md5(concat_ws(':', '20', doc_id)) AS spot,
  CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS lane, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
lanes AS (SELECT lane, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY lane) - 1 AS ord FROM docs GROUP BY lane),
weighed AS (SELECT *, CASE ord % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, sum(source_size) OVER () AS total FROM lanes),
filling AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER (ORDER BY source_size / weight DESC, ord DESC) AS shared FROM weighed),
judged AS (SELECT *, 200 * source_size * shared <= weight * (150 * total - 100 * capped) AS is_full FROM filling),
rest AS (SELECT coalesce(sum(2 * source_size) FILTER (is_full), 0) AS c, coalesce(sum(weight) FILTER (NOT is_full), 0) AS w, max(total) AS total FROM judged),
goals AS MATERIALIZED (SELECT lane, ord, source_size, CASE WHEN is_full THEN 2.0::DOUBLE * source_size ELSE weight * (1.5::DOUBLE * rest.total - c) / w END AS target FROM judged, rest),
placed AS (SELECT *, CAST(sum(size) OVER (PARTITION BY lane ORDER BY spot, doc_id, size, rn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM docs JOIN goals USING (lane)),
passes AS (SELECT *, e - size + k * source_size AS a, e + k * source_size AS b, greatest(a, least(b, CAST(floor(target) AS BIGINT))) AS c FROM placed, (VALUES (0), (1)) t(k)),
packets AS (SELECT rn, ord, target, 0 AS past, c - a AS words, c AS upto FROM passes WHERE c > a UNION ALL SELECT rn, ord, target, 1, b - c, b FROM passes WHERE b > c),
line AS (SELECT *, CAST(sum(words) OVER (ORDER BY upto / target, past, ord, upto ROWS UNBOUNDED PRECEDING) AS BIGINT) - words AS position FROM packets),
got AS (SELECT rn, CAST(sum(least(words, greatest(0, (SELECT CAST(sum(floor(target)) AS BIGINT) FROM goals) - position))) AS BIGINT) AS taken FROM line GROUP BY rn)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM docs JOIN goals USING (lane) LEFT JOIN got USING (rn)"""
