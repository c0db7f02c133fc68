"""Registered decoders of wire data."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftnet.functions import binary as B
from driftnet.plans.registry import query
from driftnet.sources import messages as X
from driftnet.sources import wire as W
from driftnet.sources.derived import view

INT = "CAST(concat('0x', {0}) AS INTEGER)"


@query(f"""WITH h AS (SELECT c_custkey, concat(md5(CAST(c_custkey AS VARCHAR)), 'abcd') AS h FROM customer), e AS (SELECT c_custkey, i, substr(h, CAST(i * 12 + 1 AS BIGINT), 12) AS e FROM h, range(0, 3) t(i))
SELECT c_custkey, CAST(i AS INTEGER) AS i, concat_ws('.', {INT.format('substr(e, 1, 2)')}, {INT.format('substr(e, 3, 2)')}, {INT.format('substr(e, 5, 2)')}, {INT.format('substr(e, 7, 2)')}) AS ip, {INT.format('substr(e, 9, 4)')} AS port FROM e""")
def compact_peers(spark, d):
    rows = view(spark, d, "customer").select("c_custkey", F.concat(F.md5(F.col("c_custkey").cast("string")), F.lit("abcd")).alias("h"))
    return rows.select("c_custkey", F.posexplode(B.compact_peers(F.col("h"))).alias("i", "p")).select("c_custkey", "i", "p.ip", "p.port")


@query(f"""WITH h AS (SELECT c_custkey, concat(sha1(CAST(c_custkey AS VARCHAR)), 'c0a80001', lpad(lower(hex(c_custkey % 65536)), 4, '0')) AS h FROM customer)
SELECT c_custkey, substr(h, 1, 40) AS id, '192.168.0.1' AS ip, CAST(c_custkey % 65536 AS INTEGER) AS port FROM h""")
def compact_nodes(spark, d):
    k = F.col("c_custkey")
    hexed = F.concat(F.sha1(k.cast("string")), F.lit("c0a80001"), F.lpad(F.lower(F.hex(k % 65536)), 4, "0"))
    return view(spark, d, "customer").select("c_custkey", F.explode(B.compact_nodes(hexed)).alias("n")).select("c_custkey", "n.id", "n.ip", "n.port")


@query("SELECT c_custkey, sha1(CAST(c_custkey AS VARCHAR)) AS id, repeat('ab', 16) AS ip, CAST(c_custkey % 65536 AS INTEGER) AS port FROM customer")
def compact_nodes_ipv6(spark, d):
    k = F.col("c_custkey")
    hexed = F.concat(F.sha1(k.cast("string")), F.repeat(F.lit("ab"), 16), F.lpad(F.lower(F.hex(k % 65536)), 4, "0"))
    return view(spark, d, "customer").select("c_custkey", F.explode(B.compact_nodes_ipv6(hexed)).alias("n")).select("c_custkey", "n.id", "n.ip", "n.port")


@query("SELECT c_custkey, CAST(i AS INTEGER) AS i, CAST(c_custkey % 1000 + i AS INTEGER) AS seeders, 0 AS completed, CAST(c_custkey % 77 AS INTEGER) AS leechers FROM customer, range(0, 2) t(i)")
def scrape_datagram(spark, d):
    k = F.col("c_custkey")
    word = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    entry = lambda i: F.concat(word(k % 1000 + i), F.lit("00000000"), word(k % 77))
    reply = F.concat(F.lit("00000002deadbeef"), entry(0), entry(1), F.lit("0000"))
    return view(spark, d, "customer").select("c_custkey", F.posexplode(B.scrape_entries(reply)).alias("i", "e")).select("c_custkey", "i", "e.*")


@query("SELECT s_suppkey, sha1(CAST(s_suppkey AS VARCHAR)) AS info_hash, CAST(s_suppkey % 90 AS BIGINT) AS complete, CAST(s_suppkey % 7 AS BIGINT) AS incomplete FROM supplier WHERE s_suppkey % 10 != 3")
def bencode_scrape(spark, d):
    k = F.col("s_suppkey")
    text = lambda s: F.encode(s, "UTF-8")
    body = F.concat(text(F.lit("d5:filesd20:")), F.unhex(F.sha1(k.cast("string"))), text(F.concat(F.lit("d8:completei"), (k % 90).cast("string"), F.lit("e10:incompletei"), (k % 7).cast("string"), F.lit("e4:spaml1:ai-2eee3:abcdeee"))))
    broken = F.when(k % 10 == 3, F.substring(body, 1, 30)).otherwise(body)
    return W.scrape_replies(view(spark, d, "supplier").select("s_suppkey", broken.alias("raw")), "s_suppkey", "raw")


@query("SELECT doc_id, sha1(text) AS info_hash FROM documents WHERE doc_id % 3 != 0")
def metainfo_verify(spark, d):
    docs = view(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("metadata"), F.when(F.col("doc_id") % 3 != 0, F.sha1("text")).otherwise(F.repeat(F.lit("0"), 40)).alias("info_hash"))
    return W.verified_metadata(docs).select("doc_id", "info_hash")


#: What each sixth of the discoveries sends: a ping, a get_peers, nodes, peers, an error, a ping that is cut off.
PING = "CASE event_id % 6 WHEN 0 THEN 'q' WHEN 1 THEN 'q' WHEN 2 THEN 'r' WHEN 3 THEN 'r' WHEN 4 THEN 'e' END"


def sent(spark, d):
    """event_id and a datagram of each discovery."""
    a = view(spark, d, "discoveries").select("event_id", "info_hash", "node_id", (F.col("event_id") % 6).alias("what"), F.lpad(F.lower(F.hex(F.col("event_id") % 65536)), 4, "0").alias("txn"))
    text = lambda *parts: F.concat(*[F.lit(p).cast("binary") if isinstance(p, str) else p for p in parts])
    ident, aim = F.unhex(F.sha1(F.col("node_id").cast("string"))), F.unhex("info_hash")
    node = F.unhex(F.concat("info_hash", F.lit("0a0000011ae1")))
    t = F.unhex("txn")
    number = lambda c: F.concat(F.lit("i"), c.cast("string"), F.lit("e")).cast("binary")
    ping = text("d1:ad2:id20:", ident, "e1:q4:ping1:t2:", t, "1:v4:LT011:y1:qe")
    return a.select(
        "event_id",
        F.when(F.col("what") == 0, ping)
        .when(F.col("what") == 1, text("d1:ad2:id20:", ident, "9:info_hash20:", aim, "e1:q9:get_peers2:roi1e1:t2:", t, "1:y1:qe"))
        .when(F.col("what") == 2, text("d1:rd2:id20:", ident, "5:nodes52:", node, node, "5:token3:abce1:t2:", t, "1:y1:re"))
        .when(F.col("what") == 3, text("d1:rd2:id20:", ident, "5:token3:abc6:valuesl6:", F.unhex(F.lit("0a0000011ae1")), "6:", F.unhex(F.concat(F.lit("0a000002"), "txn")), "ee1:t2:", t, "1:y1:re"))
        .when(F.col("what") == 4, text("d1:el", number(F.col("node_id") % 5 + 200), "5:errore1:t2:", t, "1:y1:ee"))
        .otherwise(F.substring(ping, 1, 40)).alias("raw"),
    )


SENT = "WITH s AS (SELECT *, event_id % 6 AS what, lpad(lower(to_hex(event_id % 65536)), 4, '0') AS t, sha1(CAST(node_id AS VARCHAR)) AS ident FROM discoveries)"


@query(f"""{SENT} SELECT event_id, {PING} AS kind, CASE WHEN what < 5 THEN t END AS txn, CASE what WHEN 0 THEN 'ping' WHEN 1 THEN 'get_peers' END AS query, CASE WHEN what < 4 THEN ident END AS id, CASE what WHEN 1 THEN info_hash END AS target,
  CASE WHEN what IN (2, 3) THEN '616263' END AS token, CASE WHEN what < 5 THEN what = 1 END AS read_only, CASE what WHEN 2 THEN concat(info_hash, '0a0000011ae1', info_hash, '0a0000011ae1') END AS nodes, CASE what WHEN 3 THEN concat('0a0000011ae1,0a000002', t) END AS peers FROM s""", "discoveries")
def datagram_decode(spark, d):
    """Datagrams made from the discoveries decode to their source; cut off ones to nulls."""
    out = X.datagrams(sent(spark, d), "event_id", "raw")
    return out.select("event_id", "kind", "txn", "query", "id", "target", "token", "read_only", "nodes", F.array_join("peers", ",").alias("peers"))


@query(f"{SENT} SELECT event_id, CAST(node_id % 5 + 200 AS BIGINT) AS code, 'error' AS message FROM s WHERE what = 4", "discoveries")
def krpc_errors(spark, d):
    return X.datagrams(sent(spark, d), "event_id", "raw").filter("kind = 'e'").select("event_id", "code", "message")


@query("SELECT c_custkey, (c_custkey * 7919) % 12000000 - 5 AS metadata_size, c_custkey % 300 - 2 AS ut_metadata FROM customer WHERE c_custkey % 4 != 0 AND (c_custkey * 7919) % 12000000 - 5 BETWEEN 1 AND 10485759 AND c_custkey % 300 - 2 BETWEEN 1 AND 254")
def handshake_limits(spark, d):
    k = F.col("c_custkey")
    body = F.concat(F.lit("d1:md6:ut_pexi1e11:ut_metadatai"), (k % 300 - 2).cast("string"), F.lit("ee13:metadata_sizei"), (k * 7919 % 12000000 - 5).cast("string"), F.when(k % 4 == 0, "e").otherwise("ee"))
    out = X.handshakes(view(spark, d, "customer").select("c_custkey", body.cast("binary").alias("raw")), "c_custkey", "raw")
    return out


@query("SELECT c.k, name, CAST(count(f.k) AS INTEGER) AS n_files, CAST(sum(f.size) AS BIGINT) AS size, string_agg(path, '|' ORDER BY file_no, path, f.size) AS paths FROM catalog c JOIN files f ON f.k = c.k WHERE c.k % 7 NOT IN (2, 3) GROUP BY c.k, name", "catalog files")
def metainfo_parse(spark, d):
    """Info dictionaries made from names and file lists, every second one within a whole metainfo file; wrong digests and cut off bytes give no row."""
    one = lambda f: F.concat(F.lit("d6:lengthi"), f["size"].cast("string"), F.lit("e4:pathl3:sub"), F.octet_length(f["path"]).cast("string"), F.lit(":"), f["path"], F.lit("ee"))
    lists = view(spark, d, "files").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("file_no", "path", "size"))).alias("files"))
    rows = view(spark, d, "catalog").select("k", "name").join(lists, "k")
    info = F.concat(F.lit("d5:filesl"), F.array_join(F.transform("files", one), ""), F.lit("e4:name"), F.octet_length("name").cast("string"), F.lit(":"), F.col("name"), F.lit("12:piece lengthi16384ee"))
    k, whole = F.col("k"), F.concat(F.lit("d8:announce14:udp://tracker/4:info"), F.col("info"), F.lit("e"))
    made = rows.withColumn("info", info).select("k", F.sha1(F.when(k % 7 == 2, "other").otherwise(F.col("info"))).alias("info_hash"), F.when(k % 2 == 0, whole).otherwise(F.col("info")).alias("raw"))
    cut = made.withColumn("metadata", F.when(k % 7 == 3, F.expr("substring(raw, 1, length(raw) - 2)")).otherwise(F.col("raw")).cast("binary"))
    out = X.metainfo(cut, "k")
    return out.select("k", "name", F.size("files").alias("n_files"), "size", F.array_join(F.transform("files", lambda f: F.regexp_replace(f["path"], "^sub/", "")), "|").alias("paths"))


PLACES = "(CAST(concat('0x', substr({0}, 1, 2)) AS INTEGER) + 256 * CAST(concat('0x', substr({0}, 3, 2)) AS INTEGER)) % 2048"


@query(f"""WITH a AS (SELECT c_nationkey, sha1(unhex(lpad(lower(hex(c_custkey)), 8, '0'))) AS s FROM customer), p AS (SELECT c_nationkey, unnest([{PLACES.format('s')}, {PLACES.format('substr(s, 5)')}]) AS p FROM a), n AS (SELECT c_nationkey, count(DISTINCT p) AS bits FROM p GROUP BY 1)
SELECT c_nationkey, bits, round(ln(least(2048 - bits, 2047) / 2048) / (2 * ln(1 - 1.0::DOUBLE / 2048)), 6) AS estimate FROM n""")
def bloom_estimates(spark, d):
    rows = view(spark, d, "customer").select("c_nationkey", F.explode(B.bloom_places(F.lpad(F.lower(F.hex("c_custkey")), 8, "0"))).alias("p"))
    bits = rows.groupBy("c_nationkey").agg(F.countDistinct("p").alias("bits"))
    return bits.select("c_nationkey", "bits", F.round(B.bloom_estimate(F.col("bits")), 6).alias("estimate"))


@query(f"""WITH a AS (SELECT c_nationkey, c_custkey, sha1(unhex(lpad(lower(hex(c_custkey)), 8, '0'))) AS s FROM customer), p AS (SELECT c_nationkey, unnest([{PLACES.format('s')}, {PLACES.format('substr(s, 5)')}]) AS p FROM a), n AS (SELECT c_nationkey, count(DISTINCT p) AS bits FROM p GROUP BY 1),
r AS (SELECT n_regionkey, count(DISTINCT p) AS bits FROM p JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
SELECT n_regionkey, CAST(bits AS INTEGER) AS bits, round(ln(least(2048 - bits, 2047) / 2048) / (2 * ln(1 - 1.0::DOUBLE / 2048)), 6) AS estimate, (SELECT count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE nation.n_regionkey = r.n_regionkey) AS found FROM r""")
def bloom_merge(spark, d):
    """Filters of nations merged to filters of regions: bits and estimates are those of the union, and every member is found."""
    rows = view(spark, d, "customer").select("c_nationkey", B.bloom_places(F.lpad(F.lower(F.hex("c_custkey")), 8, "0")).alias("places"))
    own = rows.select("c_nationkey", F.explode("places").alias("p")).groupBy("c_nationkey").agg(B.bloom_filter(F.col("p")).alias("held"))
    nations = view(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    merged = own.join(nations, "c_nationkey").groupBy("n_regionkey").agg(B.bloom_merged(F.col("held")).alias("held"))
    members = rows.join(nations, "c_nationkey").join(merged, "n_regionkey").groupBy("n_regionkey").agg(F.count_if(B.bloom_has(F.col("held"), F.col("places"))).alias("found"))
    bits = B.bloom_bits(F.col("held"))
    return merged.select("n_regionkey", bits.alias("bits"), F.round(B.bloom_estimate(bits), 6).alias("estimate")).join(members, "n_regionkey")


@query("SELECT c_custkey, md5('s3cret'::BLOB || unhex(sha1(CAST(c_custkey AS VARCHAR))) || unhex(sha1('h')) || unhex(sha1('p')) || '10.0.0.1:80'::BLOB) AS token FROM customer")
def announce_tokens(spark, d):
    fixed = lambda s: F.sha1(F.lit(s).cast("binary"))
    return view(spark, d, "customer").select("c_custkey", B.announce_token("s3cret", F.sha1(F.col("c_custkey").cast("string")), fixed("h"), fixed("p"), F.lit("10.0.0.1:80")).alias("token"))
