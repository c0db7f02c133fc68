"""Registered searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftnet.functions import feed as X
from driftnet.operators import catalog as C
from driftnet.operators import search as S
from driftnet.plans.registry import query
from driftnet.sources.derived import view

WORDS = "list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: w != '')"
HIT = "list_contains({w}, 'small') AND len(list_filter({w}, lambda w: starts_with(w, 'ri'))) > 0"


@query(f"""WITH t AS (SELECT *, {WORDS.format('name')} AS w FROM catalog WHERE category IN (0, 1)), hit AS (SELECT * FROM t WHERE {HIT.format(w='w')})
SELECT info_hash, name, discovered_at, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY discovered_at DESC, info_hash LIMIT 50""", "catalog")
def search_prefix_page(spark, d):
    """The flagship: text with a prefix on the last token, a category filter, a recency page and the total."""
    rows = C.spread(view(spark, d, "catalog").select("info_hash", "name", "discovered_at", "category").filter(F.col("category").isin(0, 1)), "info_hash")
    return C.page(S.search(rows, "Small ri").select("info_hash", "name", "discovered_at"), C.total_order("discovered_at"), 50)


EPISODE_HIT = "list_contains({w}, 'small') AND len(list_filter({w}, lambda w: starts_with(w, 's06e'))) > 0"


@query(f"SELECT info_hash FROM catalog WHERE {EPISODE_HIT.format(w=WORDS.format('name'))}", "catalog")
def search_season_suffix(spark, d):
    """A title with what a season and an episode add: the last token is a prefix, so a season alone finds all its episodes."""
    found = S.search(C.spread(view(spark, d, "catalog").select("info_hash", "name"), "info_hash"), f"small {X.search_suffix(6, None)}e")
    return found.select("info_hash")


@query(f"SELECT info_hash FROM catalog WHERE {HIT.format(w=WORDS.format('name'))}", "catalog")
def search_inverted_index(spark, d):
    return S.search_index(S.inverted_index(C.spread(view(spark, d, "catalog").select("info_hash", "name"), "info_hash")), "small ri")


@query(f"SELECT doc_id FROM documents WHERE len(list_filter({WORDS.format('text')}, lambda w: starts_with(w, 'eleve'))) > 0 OR len(list_filter({WORDS.format('text')}, lambda w: starts_with(w, 'etre'))) > 0")
def search_folded_documents(spark, d):
    docs = view(spark, d, "documents").select("doc_id", "text")
    words = S.tokens(F.col("text"))
    return docs.filter(S.matches(words, S.query_tokens("élevé")) | S.matches(words, S.query_tokens("ÊTRE"))).select("doc_id")


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct({WORDS.format('name')})) AS token FROM catalog) GROUP BY token", "catalog")
def index_token_counts(spark, d):
    return S.inverted_index(C.spread(view(spark, d, "catalog").select("info_hash", "name"), "info_hash")).groupBy("token").agg(F.count("*").alias("n"))
