"""URL verdicts from path rules and from link-graph propagation between hosts.

Hosts that rules allow are seeds of a personalised PageRank along the links, hosts that rules block are seeds of a
distrust rank against the links. A host is blocked when its distrust outweighs its trust and lies above an even share.
The walks go on until no rank moves by more than a residual, however far hosts lie from the seeds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftnet.llm.common import spool

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING = 0.85
#: Walks end when no rank has moved by more than this in STRIDE rounds, and after as many rounds as leave no more mass to be walked.
RESIDUAL, STRIDE = 1e-10, 5
#: Absolute links in a page.
LINK = r"[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20<>\x22\x27]+"


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and without ://."""
    host = F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules: list[tuple[str, str, str]], give: str) -> Column:
    """The longest fitting rule (give='rule') or its verdict (give='verdict'); null where none fits."""
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.lit(rule_host + rule_path if give == "rule" else verdict)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("string") if out is None else out


def most_rounds(residual: float, damping: float) -> int:
    return math.ceil(math.log(residual) / math.log(damping) / STRIDE) * STRIDE


def host_scores(hosts: DataFrame, links: DataFrame, residual: float = RESIDUAL, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust, each of sum 1 (or 0 without seeds).

    hosts: host, n_pages, n_allow, n_block, one row per host; links: src, dst, n between such hosts. A host's seed
    weight is the share of its pages that rules allow or block. At most `residual` of the mass is left to be walked on at the end; the driver sees the largest
    change every few rounds. Mass that meets a host without links goes out of the walk; the end sums are scaled to 1.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("out_n"))
    back = links.groupBy("dst").agg(F.sum("n").alias("in_n"))
    forth = links.join(out, "src").select(F.lit("trust").alias("walk"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("out_n")).alias("w"))
    against = links.join(back, "dst").select(F.lit("distrust").alias("walk"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("n") / F.col("in_n")).alias("w"))
    steps = spool(forth.unionByName(against), "host-steps")
    weight = F.explode(F.create_map(F.lit("trust"), F.col("n_allow") / F.col("n_pages"), F.lit("distrust"), F.col("n_block") / F.col("n_pages"))).alias("walk", "s")
    raw = hosts.select("host", weight).filter("s > 0")
    total = raw.groupBy("walk").agg(F.sum("s").alias("all_s"))  # two rows
    seeds = spool(raw.join(F.broadcast(total), "walk").select("walk", "host", (F.col("s") / F.col("all_s")).alias("r")), "host-seeds")
    rank = seeds
    jump = seeds.select("walk", "host", (F.lit(1 - damping) * F.col("r")).alias("r"))
    last = seeds
    for k in range(most_rounds(residual, damping)):
        moved = rank.join(steps, ["walk", "host"]).select("walk", F.col("to").alias("host"), (F.lit(damping) * F.col("r") * F.col("w")).alias("r"))
        rank = moved.unionByName(jump).groupBy("walk", "host").agg(F.sum("r").alias("r"))
        if k % STRIDE == STRIDE - 1:
            rank = spool(rank, "host-rank")
            both = rank.unionByName(last.withColumn("r", -F.col("r"))).groupBy("walk", "host").agg(F.abs(F.sum("r")).alias("by"))
            if (both.agg(F.max("by")).first()[0] or 0.0) <= residual:
                break
            last = rank
    ends = rank.groupBy("walk").agg(F.sum("r").alias("all_r"))  # two rows
    part = rank.join(F.broadcast(ends), "walk").withColumn("r", F.col("r") / F.col("all_r"))
    pick = lambda walk: F.sum(F.when(F.col("walk") == walk, F.col("r")).otherwise(0.0)).alias(walk)
    return part.groupBy("host").agg(pick("trust"), pick("distrust"))


def judge_pages(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, residual: float = RESIDUAL) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of pages.

    pages needs page_id, url and html; other columns are ignored, whatever their names. A null url and one without
    :// have an empty host and path, fit no rule and are allowed; a null html has no links. Repeated rows are judged alike and each counts. Whole
    pages are read, whatever their length. A link is an absolute address in a page; it counts once for a page and a target path, links of a host to itself do
    not. Hosts that are only linked are nodes as well: the rules judge the links to them, so that a blocked host that was never fetched still
    spreads distrust. trust and distrust are 0 where no walk arrives.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    ruled = split.withColumn("rule", rule_column(F.col("host"), F.col("path"), rules, "rule")).withColumn("said", rule_column(F.col("host"), F.col("path"), rules, "verdict"))
    count = lambda v: F.sum(F.when(F.col("said") == v, 1).otherwise(0)).alias(f"n_{v}")
    hosts = spool(ruled.filter("host != ''").groupBy("host").agg(F.count("*").alias("n_pages"), count("allow"), count("block")), "hosts")
    targets = F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(0)), lambda u: F.struct(host_of(u).alias("dst"), path_of(u).alias("dst_path")))
    mentions = split.filter("host != ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(targets)).alias("to")).select("src", "to.*").filter("dst != '' AND src != dst")
    said = mentions.withColumn("said", rule_column(F.col("dst"), F.col("dst_path"), rules, "verdict"))
    links = spool(said.groupBy("src", "dst").agg(F.count("*").alias("n"), count("allow"), count("block")), "host-links")
    linked = links.groupBy(F.col("dst").alias("host")).agg(F.sum("n").alias("n_pages"), F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block"))
    hosts = spool(hosts.unionByName(linked.join(hosts, "host", "left_anti")), "nodes")
    scores = host_scores(hosts, links.select("src", "dst", "n"), residual)
    n_hosts = hosts.agg(F.count("*").alias("n_hosts"))  # one row
    bad = F.round(F.col("distrust") - F.col("trust"), 9).__gt__(0) & (F.round(F.col("distrust") * F.col("n_hosts"), 9) > 1)
    judged = spool(scores.crossJoin(F.broadcast(n_hosts)).select("host", "trust", "distrust", bad.alias("bad")), "host-verdicts")
    out = ruled.drop("html").join(judged, "host", "left")
    verdict = F.coalesce("said", F.when(F.coalesce("bad", F.lit(False)), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round(F.coalesce("trust", F.lit(0.0)), 6).alias("trust"), F.round(F.coalesce("distrust", F.lit(0.0)), 6).alias("distrust"))


def judge_pages_sql(rules: list[tuple[str, str, str]] = RULES, residual: float = RESIDUAL, damping: float = DAMPING) -> str:
    """The same for DuckDB, on a table pages."""

    def case(value):
        parts = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if value == 'rule' else v}'" for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
        return "CASE " + " ".join(parts) + " END"

    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    rounds = most_rounds(residual, damping)
    return f"""WITH RECURSIVE cut AS MATERIALIZED (SELECT page_id, html, coalesce({rest}, '') AS rest FROM pages),
split AS MATERIALIZED (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS MATERIALIZED (SELECT *, {case("rule")} AS rule, {case("verdict")} AS said FROM split),
paged AS MATERIALIZED (SELECT host, count(*) AS n_pages, count(*) FILTER (said = 'allow') AS n_allow, count(*) FILTER (said = 'block') AS n_block FROM ruled WHERE host != '' GROUP BY host),
mentions AS MATERIALIZED (SELECT src, t.h AS host, t.p AS path FROM (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{LINK}'), lambda u: {{
  'h': translate(regexp_extract(u, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'p': regexp_extract(u, '://[^/?#]*([^?#]*)', 1)}}))) AS t FROM split WHERE host != '') WHERE t.h != '' AND src != t.h),
links AS MATERIALIZED (SELECT src, host AS dst, count(*) AS n, count(*) FILTER (said = 'allow') AS n_allow, count(*) FILTER (said = 'block') AS n_block FROM (SELECT *, {case("verdict")} AS said FROM mentions) GROUP BY 1, 2),
hosts AS MATERIALIZED (SELECT * FROM paged UNION ALL SELECT dst, sum(n), sum(n_allow), sum(n_block) FROM links WHERE dst NOT IN (SELECT host FROM paged) GROUP BY 1),
steps AS MATERIALIZED (SELECT 'trust' AS walk, src AS host, dst AS "to", n / sum(n) OVER (PARTITION BY src) AS w FROM links
  UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM links),
raw AS MATERIALIZED (SELECT 'trust' AS walk, host, n_allow / n_pages AS s FROM hosts WHERE n_allow > 0 UNION ALL SELECT 'distrust', host, n_block / n_pages FROM hosts WHERE n_block > 0),
r0 AS MATERIALIZED (SELECT walk, host, s / sum(s) OVER (PARTITION BY walk) AS r FROM raw),
walked AS (SELECT 0 AS k, walk, host, r FROM r0 UNION ALL SELECT k + 1, walk, host, sum(r) FROM (SELECT k, walk, s."to" AS host, {damping} * r * w AS r FROM walked JOIN steps s USING (walk, host)
  UNION ALL SELECT k, walk, host, {1 - damping} * r0.r FROM r0, (SELECT DISTINCT k FROM walked)) WHERE k < {rounds} GROUP BY k, walk, host),
scaled AS (SELECT walk, host, r / sum(r) OVER (PARTITION BY walk) AS r FROM walked WHERE k = {rounds}),
scores AS MATERIALIZED (SELECT host, coalesce(sum(r) FILTER (walk = 'trust'), 0) AS trust, coalesce(sum(r) FILTER (walk = 'distrust'), 0) AS distrust FROM scaled GROUP BY host)
SELECT page_id, ruled.host, path, rule,
  coalesce(said, CASE WHEN round(distrust - trust, 9) > 0 AND round(distrust * (SELECT count(*) FROM hosts), 9) > 1 THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(trust, 0), 6) AS trust, round(coalesce(distrust, 0), 6) AS distrust
FROM ruled LEFT JOIN scores ON ruled.host = scores.host"""
