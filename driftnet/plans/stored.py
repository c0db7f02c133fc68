"""Registered queries over stored tables and their search index: state after changes, and searches of the index alone."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftnet.operators import enrich as E
from driftnet.operators import mutate as M
from driftnet.operators import stored as S
from driftnet.plans import mutations as Q
from driftnet.plans import name_sql as N
from driftnet.plans.parsing import FILED
from driftnet.plans.registry import query
from driftnet.plans.search import HIT, WORDS
from driftnet.session import shared_dir
from driftnet.sources.derived import view
from driftnet.streaming import persist as P
from driftnet.streaming import refresh as R


#: Sixteen parts and buckets suit tables of this size; a table of 100 TB takes four digits, 65,536 parts.
DIGITS, BUCKETS = 1, 16


def root(spark, name):
    return f"{shared_dir(spark)}/stored-{name}-{uuid.uuid4().hex}"


def stored_half(spark, d, name):
    """A stored table with every second row of the catalog."""
    rows = Q.old(spark, d)
    table = S.StoredTable(spark, root(spark, name), S.schema_of(rows), digits=DIGITS)
    table.upsert(rows, [F.desc("seeders")])
    return table


@query(f"WITH {Q.HALF}, {Q.BATCH}, {Q.LAST} SELECT {Q.STATE} FROM old WHERE info_hash NOT IN (SELECT info_hash FROM last) UNION ALL SELECT {Q.STATE} FROM last", "catalog")
def stored_upsert(spark, d):
    """The state of upsert_last_wins, by a change of the parts that the batch touches."""
    table = stored_half(spark, d, "upsert")
    table.upsert(M.checked(Q.batch(spark, d)), [F.desc("seeders")])
    return table.read()


@query(f"WITH {Q.HALF} SELECT info_hash, name, discovered_at, seeders FROM old WHERE info_hash NOT IN (SELECT info_hash FROM catalog WHERE k % 5 = 0)", "catalog")
def stored_delete(spark, d):
    table = stored_half(spark, d, "delete")
    table.delete(view(spark, d, "catalog").filter("k % 5 = 0"))
    return table.read()


@query("SELECT info_hash, name, discovered_at, seeders FROM catalog", "catalog")
def stored_migration(spark, d):
    """All rows copied in chunks into a table that holds stale names of a quarter of them."""
    rows = view(spark, d, "catalog").select("k", "info_hash", "name", "discovered_at", "seeders")
    table = S.StoredTable(spark, root(spark, "migration"), S.schema_of(rows.drop("k")), digits=DIGITS)
    table.upsert(rows.filter("k % 4 = 0").drop("k").withColumn("name", F.lit("stale")), [F.desc("seeders")])
    table.copy_from(rows.drop("k"), [F.desc("discovered_at")], chunks=4)
    return table.read()


def indexed_changes(spark, d, name):
    """A table and its index after an upsert and a deletion, each taken over by the index as a delta."""
    table = stored_half(spark, d, name)
    index = S.StoredIndex(spark, root(spark, f"{name}-index"), buckets=BUCKETS)
    index.apply(table.read().limit(0), table.read())
    batch, gone = Q.batch(spark, d), view(spark, d, "catalog").filter("k % 5 = 0").select("info_hash")
    for keys, change in ((batch, lambda: table.upsert(batch, [F.desc("seeders")])), (gone, lambda: table.delete(gone))):
        before = table.snapshot()
        index.follow(table, before, change(), keys)
    return table, index


NEW_STATE = f"WITH {Q.HALF}, {Q.BATCH}, {Q.LAST}, state AS (SELECT info_hash, name FROM old WHERE info_hash NOT IN (SELECT info_hash FROM last) UNION ALL SELECT info_hash, name FROM last), left_over AS (SELECT * FROM state WHERE info_hash NOT IN (SELECT info_hash FROM catalog WHERE k % 5 = 0))"


@query(f"{NEW_STATE} SELECT info_hash FROM left_over WHERE {HIT.format(w=WORDS.format('name'))}", "catalog")
def search_stored_index(spark, d):
    """A search of the stored index after inserts, updates and deletions equals a scan of the new state; only the buckets of its tokens are read."""
    return indexed_changes(spark, d, "search")[1].search("small ri")


@query(f"{NEW_STATE} SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct({WORDS.format('name')})) AS token FROM left_over) GROUP BY token", "catalog")
def stored_index_merged(spark, d):
    """The whole index after its deltas were merged: each word with its number of rows."""
    index = indexed_changes(spark, d, "merge")[1]
    return index.current(index.merge(1)).groupBy("token").agg(F.count("*").alias("n"))


VERDICTS = f"""{FILED}, v AS (SELECT k, {N.adult()} OR ({N.any_of('name', N.R.JUNK_NAME)} AND NOT {N.signals()}) OR {N.junk_files()} AS junk, {N.category()} AS category, {N.quality_words('name')} AS quality, title, total > 0 AND coalesce(video / total > 0.80, FALSE) AS media FROM filed),
p AS (SELECT sha1(CAST(k AS VARCHAR)) AS info_hash, NOT junk AND (category != 'unknown' OR media) AS kept, category, quality, title FROM v)
SELECT info_hash, kept, CASE WHEN kept THEN category END AS category, CASE WHEN kept THEN quality END AS quality, CASE WHEN kept THEN title END AS title FROM p WHERE info_hash IN (SELECT info_hash FROM discoveries)"""


@query(VERDICTS, "catalog files discoveries")
def persist_stream(spark, d):
    """All discoveries as a stream of four batches into a stored catalog and stored rejects; every hash with metadata ends in one of them."""
    at = root(spark, "persist")
    arrivals = view(spark, d, "discoveries").select("event_id", "info_hash")
    arrivals.repartitionByRange(4, "event_id").write.parquet(f"{at}/arrivals")
    files = view(spark, d, "files").groupBy("k").agg(F.collect_list(F.struct("path", "size")).alias("files"))
    view(spark, d, "catalog").select("k", "info_hash", "name", "size").join(files, "k", "left").drop("k").write.parquet(f"{at}/metadata")
    metadata = spark.read.parquet(f"{at}/metadata")
    catalog, rejects = P.tables(spark, at, DIGITS)
    stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/arrivals")
    P.persist_stream(stream, metadata, catalog, rejects, 1_704_153_600, f"{at}/state")
    kept = catalog.read().select("info_hash", F.lit(True).alias("kept"), "category", "quality", "title")
    none = F.lit(None).cast("string")
    return kept.unionByName(rejects.read().select("info_hash", F.lit(False).alias("kept"), none.alias("category"), none.alias("quality"), none.alias("title")))


TITLES = "regexp_replace(lower(p_name), '[^a-z0-9\\p{L}\\p{N}]+', '', 'g')"


@query(f"""WITH r AS (SELECT c_custkey, {TITLES} AS norm FROM customer JOIN part ON p_partkey = c_custkey % 150), e AS (SELECT {TITLES} AS norm, min(p_partkey) AS later, min(CASE WHEN p_partkey % 3 > 0 THEN p_partkey END) AS sooner FROM part GROUP BY 1)
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN sooner ELSE later END AS entry_id, CAST(1 + c_custkey % 2 AS INTEGER) AS version FROM r LEFT JOIN e ON e.norm = r.norm""")
def dimension_refresh_stream(spark, d):
    """Titles of customers as a stream over a title table that is exchanged half-way: even customers meet its first version, odd ones its second."""
    at, part = root(spark, "refresh"), view(spark, d, "part")
    titles = part.select("p_partkey", E.normalize_key(F.col("p_name")).alias("norm"))
    arrivals = view(spark, d, "customer").join(titles, F.col("p_partkey") == F.col("c_custkey") % 150).select("c_custkey", "norm")
    dimension = R.Dimension(spark, f"{at}/titles", "norm string, entry_id long", "norm")
    entries = lambda rows: rows.groupBy("norm").agg(F.min("p_partkey").cast("long").alias("entry_id"))
    for k, rows in enumerate((titles.filter("p_partkey % 3 > 0"), titles)):
        dimension.refresh(lambda rows=rows: entries(rows), k * R.EVERY)
        arrivals.filter(f"c_custkey % 2 = {k}").write.mode("append").parquet(f"{at}/arrivals")
        stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", 16).parquet(f"{at}/arrivals")
        R.lookup_stream(stream, dimension, "norm", f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").select("c_custkey", "entry_id", "version")
