"""The discovery pipeline as Structured Streaming: seen-set, triage, persist, refresh, rates, correlation, routing table.

Each stage is an ordinary DataFrame function that also runs on a batch; the stream adds watermarks (to bound its state) and sinks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftnet.functions import binary as B
from driftnet.functions import classify as K
from driftnet.functions import names as N
from driftnet.operators.catalog import exclude, first_wins
from driftnet.session import shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
SEEN_FOR = "1 day"
RESCRAPE_SECONDS = 30 * 86_400
MOST_FILES, RETRY_SECONDS, BUCKET = 100, 30, 80


def stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """Discoveries as a stream: event_id, at (timestamp), node_id, event_type, value, info_hash."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("node_id"), "event_type", "value", F.sha1((F.col("user_id") * 37 % 211).cast("string")).alias("info_hash"))


def work_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, exactly once, and reads its sink."""
    spark, root = df.sparkSession, work_dir(df.sparkSession)
    query = df.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def drain_batches(df: DataFrame, each: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Runs `each` on every micro-batch; a batch that is repeated after a failure overwrites its own folder."""
    spark, root = df.sparkSession, work_dir(df.sparkSession)

    def put(batch: DataFrame, k: int) -> None:
        each(batch, k).write.mode("overwrite").parquet(f"{root}/out/batch={k}")

    df.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch")


def drain_updates(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Runs an aggregation whose value only grows to its end, open windows included; the greatest value that a key was given is its last."""
    spark, root = df.sparkSession, work_dir(df.sparkSession)

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={k}")

    df.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out").groupBy(*key).agg(F.max(value).alias(value))


def unseen(df: DataFrame, within: str = SEEN_FOR) -> DataFrame:
    """The first arrival of each hash within the time that arrivals may be late; exact where a seen-set would guess."""
    return df.withWatermark("at", within).dropDuplicatesWithinWatermark(["info_hash"]) if df.isStreaming else df.dropDuplicates(["info_hash"])


def route(known: Column, rejected: Column, n_files: Column, seeders: Column, leechers: Column, updated_at: Column, now: Column) -> Column:
    """Where a discovery goes: rejects and fresh rows drop, new ones and rows without files are fetched, stale ones scraped."""
    stale = (F.coalesce(seeders, F.lit(0)) + F.coalesce(leechers, F.lit(0)) == 0) | (now - F.coalesce(updated_at, F.lit(0)) > RESCRAPE_SECONDS)
    return F.when(~known & rejected, "drop").when(~known, "fetch").when(n_files == 0, "fetch").when(stale, "scrape").otherwise("drop")


def triage(arrivals: DataFrame, catalog: DataFrame, rejects: DataFrame, now: int) -> DataFrame:
    """info_hash, route for each distinct hash of a batch of arrivals."""
    own = catalog.select("info_hash", F.lit(True).alias("known"), "n_files", "seeders", "leechers", "updated_at")
    bad = rejects.select("info_hash").distinct().withColumn("bad", F.lit(True))
    both = arrivals.select("info_hash").distinct().join(own, "info_hash", "left").join(bad, "info_hash", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return both.select("info_hash", route(flag("known"), flag("bad"), F.coalesce("n_files", F.lit(0)), F.col("seeders"), F.col("leechers"), F.col("updated_at"), F.lit(now)).alias("route"))


def validation_errors(name: Column, size: Column, files: Column) -> Column:
    """All that is wrong with metadata, joined by '; ': short names, small sizes, bad text in the name or a path."""
    bad = lambda s: ~F.is_valid_utf8(s) | s.contains("\x00")
    paths = F.coalesce(files, F.array().cast("array<struct<path:string,size:bigint>>"))
    return F.concat_ws("; ", F.when(F.octet_length(name) < 8, "name too short"), F.when(size < 1024, "size too small"), F.when(bad(name), "name not utf-8"), F.when(F.exists(paths, lambda f: bad(f["path"])), "path not utf-8"))


def build_rows(metadata: DataFrame, filters: K.Filters = K.Filters()) -> DataFrame:
    """Catalog rows of metadata (info_hash, name, size, files): verdict is keep, junk or no media.

    File lists are cut to their first hundred; a kept row has category, quality, title and year of its name.
    """
    rows = metadata.withColumn("files", F.slice("files", 1, MOST_FILES))
    name, sums = F.col("name"), F.col("sums")
    s = F.col("signals")
    rows = rows.select("*", N.once(K.file_sums(F.col("files"))).alias("sums")).select("*", N.once(K.signals(name)).alias("signals"))
    rows = rows.select("*", K.is_junk(name, sums, filters, s=s).alias("junk"), K.category(name, sums, s).alias("category"), s["by_words"].alias("quality"), N.title(name, s).alias("title"), s["year"].alias("year"), s["imdb_id"].alias("imdb_id"))
    verdict = F.when(F.col("junk"), "junk").when((F.col("category") == "unknown") & ~F.coalesce(K.has_media_files(sums), F.lit(False)), "no media").otherwise("keep")
    return rows.withColumn("verdict", verdict).drop("junk", "signals")


def persist(batch: DataFrame, filters: K.Filters = K.Filters()) -> tuple[DataFrame, DataFrame]:
    """(rows to upsert, rejects) of a batch of metadata, the first of each hash."""
    built = build_rows(first_wins(batch, ["info_hash"], [F.asc("arrival"), F.asc("name")]), filters)
    return built.filter("verdict = 'keep'"), built.filter("verdict != 'keep'").select("info_hash")


def trailing_rate(events: DataFrame, seconds: int = 60) -> DataFrame:
    """at (epoch seconds), rate: events of the last `seconds` one-second buckets divided by seconds, wherever something happened."""
    per_second = events.groupBy("at").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("at") / 3600))
    # each hour is summed by itself; its first minute also needs the last one of the hour before
    tail = per_second.filter(F.col("at") % 3600 >= 3600 - seconds).withColumn("part", F.col("part") + 1).withColumn("own", F.lit(False))
    both = per_second.withColumn("own", F.lit(True)).unionByName(tail)
    frame = Window.partitionBy("part").orderBy("at").rangeBetween(-(seconds - 1), 0)
    return both.withColumn("rate", F.sum("n").over(frame) / seconds).filter("own").select("at", "rate")


def sliding_counts(df: DataFrame, length: str = "60 seconds", step: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    windowed = df.withWatermark("at", late) if df.isStreaming else df
    return windowed.groupBy(F.window("at", length, step)).agg(F.count("*").alias("n")).select(F.col("window.start").cast("long").alias("start"), "n")


def correlate(requests: DataFrame, answers: DataFrame, seconds: int = 4, late: str = "1 minute") -> DataFrame:
    """Requests with the answers that carry their transaction id within the time-out; both have txn, at, event_id.

    Ids are few and come again, so rows meet by id and span: time is cut into spans of a time-out, and an answer lies in its request's span or the next.
    """
    span = lambda at: F.floor(F.unix_micros(at) / (max(seconds, 1) * 1_000_000))
    spans = F.explode(F.array(span(F.col("at")), span(F.col("at")) + 1)).alias("span")
    q = requests.select("txn", spans, F.col("at").alias("asked_at"), F.col("event_id").alias("request_id"))
    a = answers.select(F.col("txn").alias("answer_txn"), span(F.col("at")).alias("answer_span"), F.col("at").alias("answered_at"), F.col("event_id").alias("answer_id"))
    if requests.isStreaming:
        q, a = q.withWatermark("asked_at", late), a.withWatermark("answered_at", late)
    else:
        q = q.hint("merge")  # pairs outnumber rows: broadcast, they would come from as few tasks as the answers have splits
    in_time = (F.col("answered_at") >= F.col("asked_at")) & (F.col("answered_at") <= F.col("asked_at") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return q.join(a, (F.col("txn") == F.col("answer_txn")) & (F.col("span") == F.col("answer_span")) & in_time).select("request_id", "answer_id")


def retries(failed: DataFrame) -> DataFrame:
    """A second try, half a minute on, for requests that failed once; later failures end there."""
    return failed.filter("n_retries = 0").withColumns({"n_retries": F.lit(1), "at": F.col("at") + F.expr(f"INTERVAL {RETRY_SECONDS} SECONDS")})


def admitted(batch: DataFrame, members: DataFrame) -> DataFrame:
    """bucket, id, first: the nodes of a batch that find room beside members (bucket, id); of each bucket the first to come, as many as there is room for."""
    new = batch.filter("id IS NOT NULL").join(F.broadcast(members), ["bucket", "id"], "left_anti").groupBy("bucket", "id").agg(F.min("at").alias("first"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.asc_nulls_last("first"), "id"))
    best = new.withColumn("place", place).filter(F.col("place") <= BUCKET)
    held = members.groupBy("bucket").agg(F.count("*").alias("n"))
    return best.join(F.broadcast(held), "bucket", "left").filter(F.col("place") + F.coalesce("n", F.lit(0)) <= BUCKET).select("bucket", "id", "first")


def verdicts(batch: DataFrame, members: DataFrame, new: DataFrame) -> DataFrame:
    """bucket, id, verdict for each row of a batch: the first row of a new node is `accepted`, its others and those of members `exists`, the rest `rejected`."""
    inside = members.select("bucket", "id", F.lit(False).alias("new"), F.lit(None).cast("timestamp").alias("first")).unionByName(new.select("bucket", "id", F.lit(True).alias("new"), "first"))
    met = batch.join(F.broadcast(inside), ["bucket", "id"], "left")
    opens = F.coalesce(F.col("new") & F.col("at").eqNullSafe(F.col("first")), F.lit(False))
    others = met.filter(~opens).select("bucket", "id", F.when(F.col("new").isNull(), "rejected").otherwise("exists").alias("verdict"))
    turn = F.row_number().over(Window.partitionBy("bucket", "id").orderBy("at"))
    firsts = met.filter(opens).withColumn("turn", turn).select("bucket", "id", F.when(F.col("turn") == 1, "accepted").otherwise("exists").alias("verdict"))
    return others.unionByName(firsts)


def admissions(nodes: DataFrame, origin: str) -> DataFrame:
    """bucket, id, verdict of a stream of nodes (id, at): a routing table with buckets of at most 80 nodes.

    A node that is in already is `exists`, one that finds room is `accepted`, others and those without an id are `rejected`; within a
    micro-batch nodes come in the order of their times. The table has at most 80 nodes a bucket, so it goes to every task; each
    micro-batch writes it anew from the one before, and one that is repeated after a failure overwrites its own.
    """
    spark, root = nodes.sparkSession, work_dir(nodes.sparkSession)
    table = "bucket int, id string, first timestamp, since long"

    def put(batch: DataFrame, k: int) -> DataFrame:
        keyed = batch.withColumn("bucket", B.leading_zeros(B.xor(F.col("id"), F.lit(origin))).cast("int"))
        members = spark.read.schema(table).parquet(f"{root}/members/{k - 1}") if k else spark.createDataFrame([], table)
        new = admitted(keyed, members.select("bucket", "id")).withColumn("since", F.lit(k).cast("long"))
        members.unionByName(new).coalesce(1).write.mode("overwrite").parquet(f"{root}/members/{k}")
        return verdicts(keyed, members, spark.read.schema(table).parquet(f"{root}/members/{k}").filter(F.col("since") == k))

    return drain_batches(nodes, put)


def responses(queries: DataFrame, peers: DataFrame, nearest: DataFrame, secret: str) -> DataFrame:
    """Answers to inbound queries (id, kind, target, addr): a pong, peers or nearest nodes with a token, or an error.

    peers: target, values (array); nearest: target, nodes (array).
    """
    both = queries.join(peers, "target", "left").join(nearest, "target", "left")
    token = F.md5(F.concat_ws("|", F.lit(secret), "target", "addr"))
    kind = F.col("kind")
    return both.select(
        "id", F.when(kind == "get_peers", F.when(F.col("values").isNotNull(), "peers").otherwise("nodes")).when(kind == "find_node", "nodes").when(kind.isin("ping", "announce_peer"), "pong").when(kind == "sample", "samples").otherwise("error").alias("answer"),
        F.when(kind == "get_peers", token).alias("token"), F.when(kind.isin("find_node") | ((kind == "get_peers") & F.col("values").isNull()), F.size("nodes")).alias("n_nodes"), F.when(kind == "get_peers", F.size("values")).alias("n_values"),
    )


def refresh_on_arrival(rows: DataFrame, arrivals: DataFrame) -> DataFrame:
    from driftnet.operators.mutate import merge_counters

    return merge_counters(rows, arrivals)


def without_rejects(rows: DataFrame, rejects: DataFrame) -> DataFrame:
    return exclude(rows, rejects)
