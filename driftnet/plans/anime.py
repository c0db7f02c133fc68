"""Registered queries of the offline title index."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftnet.operators import anime as A
from driftnet.plans.registry import query
from driftnet.sources.derived import view


def sql_norm(t: str) -> str:
    t = f"lower({t})"
    for p, by in ((r"\[[^\]]*\]", " "), (r"\([^)]*\)", " "), (r"[._-]", " "), (r"\b(?:season\s*\d+|\d+(?:st|nd|rd|th)\s*season|part\s*\d+|cour\s*\d+)\b", " "), (r"\s+", " ")):
        t = f"regexp_replace({t}, '{p}', '{by}', 'g')"
    t = rf"regexp_replace(trim({t}), '\s+(?:ii|iii|iv|v|vi|vii|viii|ix|x)$', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace({t}, '\s+(?:batch|complete|the\s+animation)$', '', 'g'), '\s+', ' ', 'g'))"


DECORATED = "concat('[G] ', p_name, CASE p_partkey % 4 WHEN 0 THEN ' Season 2' WHEN 1 THEN ' III' WHEN 2 THEN ' (TV) Batch' ELSE ' extra part words' END)"
INDEX = f"""titles AS (SELECT p_partkey AS id, {sql_norm('p_name')} AS norm FROM part),
idx AS MATERIALIZED (SELECT norm, min(id) AS entry_id FROM titles WHERE norm != '' AND (contains(norm, ' ') OR octet_length(encode(norm)) >= 4) GROUP BY norm)"""


def decorated():
    return F.expr("concat('[G] ', p_name, CASE p_partkey % 4 WHEN 0 THEN ' Season 2' WHEN 1 THEN ' III' WHEN 2 THEN ' (TV) Batch' ELSE ' extra part words' END)")


def index(spark, d):
    entries = view(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array("p_name").alias("titles"))
    return A.title_index(entries, "id", "id")


@query(f"SELECT p_partkey, {sql_norm(DECORATED)} AS norm FROM part")
def anime_normalize(spark, d):
    return view(spark, d, "part").select("p_partkey", A.normalize(decorated()).alias("norm"))


@query(f"WITH {INDEX} SELECT norm, entry_id FROM idx")
def anime_index_first_wins(spark, d):
    return index(spark, d)


@query(f"""WITH {INDEX}, n AS (SELECT p_partkey, string_split({sql_norm(DECORATED)}, ' ') AS ws FROM part),
c AS (SELECT p_partkey, i, array_to_string(ws[1 : len(ws) - i], ' ') AS norm FROM n, (VALUES (0), (1), (2), (3)) AS v(i) WHERE i < len(ws)),
ok AS (SELECT * FROM c WHERE i = 0 OR contains(norm, ' ') OR octet_length(encode(norm)) >= 8)
SELECT p_partkey, arg_min(entry_id, i) AS entry_id FROM ok JOIN idx USING (norm) GROUP BY p_partkey""")
def anime_tail_trim(spark, d):
    rows = view(spark, d, "part").select("p_partkey", decorated().alias("title"))
    return A.lookup(rows, index(spark, d), "p_partkey", "title")


LINES = "CASE p_partkey % 6 WHEN 0 THEN '# note' WHEN 1 THEN '' WHEN 2 THEN concat('x|1|en|', p_name) ELSE concat(p_partkey % 40, '|1|en| ', p_name, '|', p_brand) END"


@query(f"""WITH l AS (SELECT string_split({LINES}, '|') AS p, {LINES} AS line FROM part), r AS (SELECT TRY_CAST(p[1] AS INTEGER) AS anidb_id, trim(array_to_string(p[4:], '|')) AS title FROM l WHERE line != '' AND NOT starts_with(line, '#'))
SELECT anidb_id, array_to_string(list_sort(list(title)), ';') AS titles FROM r WHERE anidb_id > 0 AND title != '' GROUP BY anidb_id""")
def anime_pipe_lines(spark, d):
    lines = view(spark, d, "part").select(F.expr(LINES).alias("value"))
    return A.parse_titles(lines).select("anidb_id", F.concat_ws(";", "titles").alias("titles"))


DUMP_SQL = "SELECT p_partkey, p_partkey % 9 AS kitsu, p_name, p_size FROM part"


@query("SELECT CASE WHEN p_partkey > 0 THEN CAST(p_partkey AS INTEGER) END AS anilist_id, CASE WHEN p_partkey % 9 > 0 THEN CAST(p_partkey % 9 AS INTEGER) END AS kitsu_id, concat_ws(';', p_name, p_brand) AS titles, p_size AS year FROM part")
def anime_json_dump(spark, d):
    part = view(spark, d, "part")
    links = F.array(F.concat(F.lit("https://anilist.co/anime/"), F.col("p_partkey").cast("string")), F.lit("https://kitsu.io/anime/x"), F.concat(F.lit("https://kitsu.app/anime/"), (F.col("p_partkey") % 9).cast("string")))
    entry = F.struct(links.alias("sources"), F.col("p_name").alias("title"), F.array("p_brand").alias("synonyms"), F.struct(F.col("p_size").alias("year")).alias("animeSeason"))
    dump = part.select(F.to_json(F.struct(F.array(entry).alias("data"))).alias("value"))
    return A.parse_dump(dump).select("anilist_id", "kitsu_id", F.concat_ws(";", "titles").alias("titles"), "year")


@query("SELECT id, CASE WHEN more IS NULL THEN p_name ELSE concat(p_name, ';', more) END AS titles FROM (SELECT CAST(p_partkey AS INTEGER) AS id, p_name FROM part) LEFT JOIN (SELECT CAST(s_suppkey * 2 AS INTEGER) AS id, s_name AS more FROM supplier) USING (id)")
def anime_dump_merge(spark, d):
    entries = view(spark, d, "part").select(F.col("p_partkey").cast("int").alias("anidb_id"), F.array("p_name").alias("titles"))
    extra = view(spark, d, "supplier").select((F.col("s_suppkey") * 2).cast("int").alias("anidb_id"), F.array("s_name").alias("titles"))
    return A.merge_titles(entries, extra).select(F.col("anidb_id").alias("id"), F.concat_ws(";", "titles").alias("titles"))
