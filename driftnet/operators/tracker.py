"""Tracker results and status documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_PEERS, RACERS, SCRAPE_NODES = 50, 5, 3


def distinct_peers(answers: DataFrame, most: int = MOST_PEERS) -> DataFrame:
    """info_hash, peers: the first distinct peers of all answers in their order. answers: info_hash, seq, peer.

    Only the first place of each peer is kept before peers are gathered, and only the lowest `most` places leave a group.
    """
    from pyspark.sql import Window

    first = answers.groupBy("info_hash", "peer").agg(F.min("seq").alias("seq"))
    place = F.row_number().over(Window.partitionBy("info_hash").orderBy("seq", "peer"))
    kept = first.withColumn("place", place).filter(F.col("place") <= most)
    return kept.groupBy("info_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "peer"))), lambda x: x["peer"]).alias("peers"))


def first_success(attempts: DataFrame, racers: int = RACERS) -> DataFrame:
    """info_hash, result of the earliest success among the first racers. attempts: info_hash, place, arrival, ok, result."""
    won = attempts.filter(F.col("ok") & (F.col("place") <= racers))
    return won.groupBy("info_hash").agg(F.min_by("result", F.struct("arrival", "place", "result")).alias("result"))


def closest_retry(candidates: DataFrame, most: int = SCRAPE_NODES) -> DataFrame:
    """info_hash, answer of the nearest candidate that answered among the nearest few. candidates: info_hash, rank, answer."""
    return candidates.filter((F.col("rank") <= most) & F.col("answer").isNotNull()).groupBy("info_hash").agg(F.min_by("answer", F.struct("rank", "answer")).alias("answer"))


def scrape_summary(rows: DataFrame) -> DataFrame:
    """scraped, updated, failed, total of scrape outcomes. rows: ok, grown."""
    ok, grown = F.coalesce("ok", F.lit(False)), F.coalesce("grown", F.lit(False))
    return rows.agg(F.count_if(ok).alias("scraped"), F.count_if(ok & grown).alias("updated"), F.count_if(~ok).alias("failed"), F.count("*").alias("total"))


def tracker_listing(trackers: DataFrame, state: DataFrame, limit: Column) -> DataFrame:
    """host, protocol, limit, successes of every configured tracker; without state the start limit and no success."""
    return trackers.join(state, "host", "left").select("host", "protocol", F.coalesce("limit", limit).alias("limit"), F.coalesce("successes", F.lit(0)).alias("successes"))


def status_document(**parts: DataFrame) -> DataFrame:
    """One JSON document of one-row frames, each under its name."""
    out = None
    for name, df in parts.items():
        one = df.select(F.struct("*").alias(name))
        out = one if out is None else out.crossJoin(one)
    return out.select(F.to_json(F.struct(*parts)).alias("status"))
