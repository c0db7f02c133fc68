"""Registered queries of the training-data operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftnet.llm import bpe, collocations, decontaminate, license_scan, mixing, near_dup, prefix_trie, quality, sharding, token_count, tool_links, toxicity, url_trust
from driftnet.llm.common import table


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge_pages(table(spark, sf_dir, "pages"))


def op2_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_links.link(*tool_links.exchanges(table(spark, sf_dir, "conversations")))


def op3_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op4_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


NEAR_DUPLICATES_SQL = r"""WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS s FROM words),
postings AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS g FROM sets),
pairs AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM postings a JOIN postings b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS MATERIALIZED (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
reach AS (SELECT doc_id AS x, doc_id AS r FROM documents UNION SELECT b.y, reach.r FROM reach JOIN both_ways b USING (x)),
least AS (SELECT x, min(r) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON x = doc_id"""


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op7_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_classes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), limit=512)


def op9_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op10_toxic_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_documents(spark, sf_dir)


def op11_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_nodes(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    own = {f.__name__: f for f in (op1_url_trust, op2_tool_links, op3_uniform_shards, op4_fertility_rules, op5_near_duplicates, op6_license_scan, op7_template_leaks, op8_token_counts, op9_word_table_bpe, op10_toxic_severity, op11_fair_mix, op12_collocations, op13_prefix_trie)}
    return own


def oracle_sql() -> dict[str, str]:
    return {"op1_url_trust": url_trust.judge_pages_sql(), "op2_tool_links": tool_links.EXCHANGES_SQL, "op5_near_duplicates": NEAR_DUPLICATES_SQL, "op11_fair_mix": mixing.MIX_SQL, "op12_collocations": collocations.COLLOCATIONS_SQL, "op13_prefix_trie": prefix_trie.TRIE_SQL}
