"""Registered key-space queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftnet.functions import binary as B
from driftnet.operators import keyspace as K
from driftnet.plans.registry import query
from driftnet.sources.derived import view

WORD = "CAST(concat('0x', substr({0}, {1}, 10)) AS BIGINT)"
XOR = "concat(" + ", ".join("lpad(lower(hex(xor(" + WORD.format("{0}", 10 * k + 1) + ", " + WORD.format("{1}", 10 * k + 1) + "))), 10, '0')" for k in range(4)) + ")"
NODES = "nodes AS MATERIALIZED (SELECT sha1(CAST(c_custkey AS VARCHAR)) AS id, CAST(c_custkey % 977 AS BIGINT) AS last_responded, CAST(c_custkey % 1013 AS BIGINT) AS next_sample, CASE c_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS bep51 FROM customer)"
TARGETS = "targets AS MATERIALIZED (SELECT sha1(concat(CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 's' END, s_suppkey)) AS target FROM supplier)"
LZ = "CASE WHEN {0} = repeat('0', 40) THEN 160 ELSE length(regexp_extract({0}, '^0*')) * 4 + CASE WHEN substr(ltrim({0}, '0'), 1, 1) = '1' THEN 3 WHEN substr(ltrim({0}, '0'), 1, 1) IN ('2', '3') THEN 2 WHEN substr(ltrim({0}, '0'), 1, 1) IN ('4', '5', '6', '7') THEN 1 ELSE 0 END END"


def nodes(spark, d):
    k = F.col("c_custkey")
    return view(spark, d, "customer").select(F.sha1(k.cast("string")).alias("id"), (k % 977).alias("last_responded"), (k % 1013).alias("next_sample"), F.when(k % 3 == 0, "yes").when(k % 3 == 1, "no").otherwise("unknown").alias("bep51"))


def targets(spark, d):
    k = F.col("s_suppkey")
    return view(spark, d, "supplier").select(F.sha1(F.concat(F.when(k % 4 == 0, "").otherwise("s"), k.cast("string"))).alias("target"))


@query(f"WITH {NODES}, {TARGETS}, d AS (SELECT target, id, {XOR.format('target', 'id')} AS distance FROM targets, nodes) SELECT target, id, distance, CAST(row_number() OVER (PARTITION BY target ORDER BY distance) AS INTEGER) AS rank FROM d QUALIFY rank <= 8")
def xor_closest_8(spark, d):
    return K.closest(targets(spark, d), nodes(spark, d))


@query(f"WITH {NODES}, {TARGETS}, d AS (SELECT target, id, {XOR.format('target', 'id')} AS distance FROM targets, nodes), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY distance) AS INTEGER) AS rank FROM d) SELECT target, id, rank FROM r WHERE rank <= CASE WHEN target IN (SELECT id FROM nodes) THEN 1 ELSE 8 END")
def exact_or_closest(spark, d):
    return K.exact_or_closest(targets(spark, d), nodes(spark, d)).select("target", "id", "rank")


@query(f"WITH {NODES}, x AS (SELECT {XOR.format('id', 'sha1(CAST(7 AS VARCHAR))')} AS x FROM nodes) SELECT CAST({LZ.format('x')} AS INTEGER) AS bucket, count(*) AS n, greatest(80 - count(*), 0) AS room FROM x GROUP BY 1")
def bucket_counts(spark, d):
    return K.bucket_counts(nodes(spark, d), F.sha1(F.lit("7").cast("binary")))


@query(f"WITH {NODES} SELECT id, last_responded FROM nodes WHERE last_responded < 500 ORDER BY last_responded, id LIMIT 40")
def oldest_nodes(spark, d):
    return K.oldest(nodes(spark, d), 500, 40).select("id", "last_responded")


@query(f"WITH {NODES} SELECT id FROM nodes WHERE bep51 != 'no' AND next_sample < 600 AND last_responded < 595")
def sample_candidates(spark, d):
    return K.sample_candidates(nodes(spark, d), 600).select("id")


@query()
def random_sample(spark, d):
    n = nodes(spark, d)
    return K.random_sample(n.filter("last_responded < 3"), n, 5)


@query(f"WITH {NODES} SELECT id, {XOR.format('id', 'sha1(CAST(1 AS VARCHAR))')} AS distance, CAST({LZ.format('id')} AS INTEGER) AS zeros, CAST(160 - {LZ.format('id')} AS INTEGER) AS bits, CAST((CAST(concat('0x', substr(id, 3, 2)) AS INTEGER) >> 4) & 1 AS INTEGER) AS bit11 FROM nodes")
def key_arithmetic(spark, d):
    i = F.col("id")
    return nodes(spark, d).select("id", B.xor(i, F.sha1(F.lit("1").cast("binary"))).alias("distance"), B.leading_zeros(i).alias("zeros"), B.bit_length(i).alias("bits"), B.get_bit(i, 11).alias("bit11"))


@query("SELECT id, seq FROM (SELECT node_id AS id, max(event_id) AS seq, arg_max(event_type, event_id) AS last FROM discoveries GROUP BY 1) WHERE last != 'error'", "discoveries")
def routing_feedback(spark, d):
    events = view(spark, d, "discoveries").select(F.col("node_id").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "drop").otherwise("put").alias("kind"))
    return K.routing_feedback(events)


@query("SELECT DISTINCT CAST(node_id AS VARCHAR) AS addr FROM discoveries WHERE node_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)", "discoveries")
def unknown_addresses(spark, d):
    seen = view(spark, d, "discoveries").select(F.col("node_id").cast("string").alias("addr")).distinct()
    return K.unknown_addresses(seen, view(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("addr")))


@query("SELECT event_id, seen_at + CASE WHEN event_id % 3 > 0 THEN CASE WHEN event_id % 700 > 300 THEN 60 ELSE event_id % 700 END ELSE greatest(event_id % 700 + 300, 0) END AS next FROM discoveries", "discoveries")
def sample_interval(spark, d):
    return view(spark, d, "discoveries").select("event_id", K.next_sample(F.col("seen_at"), F.col("event_id") % 700, F.col("event_id") % 3).alias("next"))


@query(f"WITH {NODES} SELECT id, CASE WHEN last_responded % 2 = 0 THEN id END AS parsed, concat('2d4d54', substr(id, 7, 32), 'ff') AS marked FROM nodes")
def id_parse_and_mark(spark, d):
    i, even = F.col("id"), F.col("last_responded") % 2 == 0
    raw = F.when(even, F.concat(F.lit(" 0x"), F.upper(i))).otherwise(F.concat(i, F.lit("0")))
    return nodes(spark, d).select("id", B.parse_id(raw).alias("parsed"), B.with_client_marker(i, "2d4d54", "ff").alias("marked"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 40000 ELSE CAST(c_custkey % 9000 AS INTEGER) END AS port, concat('8', substr(sha1('x'), 2, 38), '0') AS marked FROM customer")
def announced_ports(spark, d):
    """Ports by the implied-port flag, and a key with its first digit set to 8 and its last to 0, bit by bit."""
    k = F.col("c_custkey")
    key = F.sha1(F.lit("x").cast("binary"))
    for place, on in ((0, True), (1, False), (2, False), (3, False), (156, False), (157, False), (158, False), (159, False)):
        key = B.set_bit(key, place, on)
    port = B.announced_port(F.when(k % 3 == 1, 1), (k % 9000).cast("int"), F.lit(40000))
    return view(spark, d, "customer").select("c_custkey", port.alias("port"), key.alias("marked"))
