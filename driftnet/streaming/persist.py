"""The end of the discovery pipeline as a stream with two sinks: rows and rejects, written batch by batch into stored tables.

A micro-batch is triaged against the state that the batches before it left, what is to be fetched meets its metadata, and the outcome goes to the
rejects and to the catalog. Both changes carry the batch's number, and both are worked out from the state before it: a batch that is repeated after a
failure, even one between the two sinks, computes the same and adds only what is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet.functions import classify as K
from driftnet.operators.catalog import first_wins
from driftnet.operators.stored import StoredTable
from driftnet.streaming import pipeline as P

STREAM = "persist"
ROWS = "info_hash string, name string, size long, n_files int, category string, quality string, title string, year int, imdb_id string, seeders int, leechers int, discovered_at long, updated_at long"
REJECTS = "info_hash string, rejected_at long"


def tables(spark: SparkSession, root: str, digits: int = 2) -> tuple[StoredTable, StoredTable]:
    """(catalog, rejects) below root."""
    return StoredTable(spark, f"{root}/catalog", ROWS, digits=digits), StoredTable(spark, f"{root}/rejects", REJECTS, digits=digits)


def persist_batch(batch: DataFrame, k: int, metadata: DataFrame, catalog: StoredTable, rejects: StoredTable, now: int, filters: K.Filters = K.Filters()) -> None:
    """Batch k of arrivals (info_hash) into both tables. metadata: info_hash, name, size, files."""
    number = (STREAM, k)
    if catalog.snapshot().has(number) and rejects.snapshot().has(number):
        return
    known = catalog.read(catalog.snapshot(before=number))
    routes = P.triage(batch, known, rejects.read(rejects.snapshot(before=number)), now)
    due = routes.filter("route = 'fetch'").select("info_hash")
    first = first_wins(metadata.join(due, "info_hash", "left_semi"), ["info_hash"], [F.asc("name"), F.asc("size")])
    built = catalog.staged(P.build_rows(first, filters), f"batch-{k}")  # parsed once for both sinks
    at = F.lit(now).cast("long")
    rejects.insert_ignore(built.filter("verdict != 'keep'").select("info_hash", at.alias("rejected_at")), "rejected_at", number)
    new = built.filter("verdict = 'keep'").withColumns({"n_files": F.size(F.coalesce("files", F.array())).cast("int"), "seeders": F.lit(0), "leechers": F.lit(0), "discovered_at": at, "updated_at": at})
    catalog.upsert(new.select([F.col(f.name).cast(f.dataType) for f in catalog.schema.fields]), [F.asc("name")], keep=["discovered_at"], number=number)


def persist_stream(arrivals: DataFrame, metadata: DataFrame, catalog: StoredTable, rejects: StoredTable, now: int, checkpoint: str) -> None:
    """Takes all arrivals that are there into both tables; call it again to go on, also after a failure."""
    each = lambda batch, k: persist_batch(batch, k, metadata, catalog, rejects, now)
    arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
