"""Registered list building."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftnet.operators import lists as L
from driftnet.plans.registry import query
from driftnet.sources.derived import view

RAW = "CASE p_partkey % 4 WHEN 0 THEN concat(upper(p_name), ' (alias)') WHEN 1 THEN 'a b' WHEN 2 THEN p_brand ELSE concat('  ', p_name) END"


@query(rf"WITH n AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(lower({RAW}), '\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM part) SELECT name FROM n WHERE octet_length(encode(name)) >= 4 AND contains(name, ' ') AND len(list_filter(string_split(name, ' '), lambda w: length(regexp_replace(w, '[^\p{{L}}]', '', 'g')) >= 2)) > 0")
def list_names(spark, d):
    return L.names(view(spark, d, "part").select(F.expr(RAW).alias("raw")), "raw")


@query("SELECT DISTINCT lower(trim(w)) AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE octet_length(encode(lower(trim(w)))) >= 4 AND lower(trim(w)) NOT IN ('ring', 'large')")
def list_words(spark, d):
    raw = view(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w"))
    return L.words(raw, "w", spark.createDataFrame([("ring",), ("LARGE",)], "word string"))
