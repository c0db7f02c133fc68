"""Phrase collocation mining with word-id suffix arrays.

1. A task cuts its texts into words with local ids, language by language, and sorts the places of a block by their next words (prefix doubling in
   numpy). Places that agree with their neighbour in m words form the intervals of the LCP array: one for each phrase of m words, its length the count.
   Counts of words and word pairs are merged over all blocks by phrase.
2. Pairs that occur `least` times or more are marked in a bit table of fixed size. A second pass breaks the pieces where a pair is not marked, as no
   longer phrase over it can be frequent, and counts phrases of 3 to 5 words in what is left, the same way. A bit
   that is set by chance costs a row and changes no count.
3. Phrases are scored by their weakest cut with exact arithmetic, those inside a longer one that is as frequent are dropped, the first of each
   language are ranked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftnet.llm.common import spool

LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes of texts that are sorted together.
BLOCK = 2 << 20
#: The table of frequent pairs has 2 ** BITS bits, 8 MB.
BITS = 26
#: Languages up to which their numbers of words are broadcast.
LANGUAGES = 100_000
#: Groups of candidates of a language that are ranked by themselves before they meet.
SALTS = 256
#: A-Z lower-cased, marks and line ends become line feeds, tabs become spaces.
TABLE = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else 10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b for b in range(256))
COUNTS = "lang string, phrase string, m int, n long"


def word_ids(raw: bytes) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """(ids, words, room): the id of each word of a translated block, the words by id, and how many words each has to the end of its piece, itself included."""
    chars = np.frombuffer(raw, dtype=np.uint8)
    inside = (chars != 32) & (chars != 10)
    step = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.int32), pa.array([], pa.large_string()), np.zeros(0, dtype=np.int32)
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(chars[inside])]).dictionary_encode()
    piece = np.cumsum(chars == 10, dtype=np.int32)[starts]
    last = np.flatnonzero(np.concatenate((piece[1:] != piece[:-1], [True])))
    room = (np.repeat(last, np.diff(last, prepend=-1)) - np.arange(len(piece)) + 1).astype(np.int32)
    return words.indices.to_numpy(), words.dictionary, room


def shifted(rank: np.ndarray, room: np.ndarray, by: int) -> np.ndarray:
    """The rank `by` words on, 0 beyond the end of the piece."""
    out = np.zeros_like(rank)
    if 0 < by < len(rank):
        out[:-by] = rank[by:]
    out[room <= by] = 0
    return out if by else rank


def suffix_array(ids: np.ndarray, room: np.ndarray, deep: int) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """(order, lcp, ranks): places in the order of their next `deep` words within their piece, how many of these each shares with the place before it,
    and the ranks by 1, 2, 4 ... words (from 1)."""
    ranks, width, order = {1: ids + 1}, 1, None
    while width < deep:
        step = min(width, deep - width)
        key = ranks[width].astype(np.int64) * (int(ranks[width].max(initial=0)) + 1) + shifted(ranks[width], room, step)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(len(ids), dtype=np.int32)
        rank[order] = np.cumsum(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])), dtype=np.int32)
        del key, sorted_key
        width += step
        ranks[width] = rank
    lcp = np.zeros(len(ids), dtype=np.int8)
    for m in range(1, deep + 1):
        known = max(w for w in ranks if w <= m)
        same = np.ones(max(0, len(ids) - 1), dtype=bool)
        for by in {0, m - known}:
            r = shifted(ranks[known], room, by)[order]
            same &= r[1:] == r[:-1]
        lcp[1:] += same & (lcp[1:] == m - 1)
    return order, lcp, ranks


def intervals(order: np.ndarray, lcp: np.ndarray, room: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts): one place for each phrase of m words, and how often it occurs."""
    starts = np.flatnonzero(lcp < m)
    sizes = np.diff(starts, append=len(order))
    places = order[starts]
    whole = room[places] >= m
    return places[whole], sizes[whole]


def phrases(words: pa.Array, ids: np.ndarray, places: np.ndarray, m: int) -> pa.Array:
    parts = [words.take(pa.array(ids[places + k])) for k in range(m)]
    return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if m > 1 else parts[0]


def rows_of(lang: str, found: pa.Array, m: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(found), 20_000):
        own = found.slice(k, 20_000).cast(pa.string())
        n = len(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(n, dtype=np.int32))), own, pa.array(np.full(n, m, dtype=np.int32)), pa.array(counts[k : k + n].astype(np.int64))], names=["lang", "phrase", "m", "n"])


def count_pairs(lang: str, raw: bytes) -> Iterator[pa.RecordBatch]:
    """Words, word pairs and, as the phrase of no words, the number of all words of a block."""
    ids, words, room = word_ids(raw)
    if not len(ids):
        return
    yield from rows_of(lang, pa.array([""], pa.large_string()), 0, np.array([len(ids)]))
    order, lcp, _ = suffix_array(ids, room, 2)
    for m in (1, 2):
        places, counts = intervals(order, lcp, room, m)
        yield from rows_of(lang, phrases(words, ids, places, m), m, counts)


def count_longer(lang: str, raw: bytes, marked: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Phrases of 3 to LONGEST words of a block all of whose pairs are marked in a table of bits."""
    ids, words, room = word_ids(raw)
    if not len(ids):
        return
    order, lcp, ranks = suffix_array(ids, room, 2)
    places, _ = intervals(order, lcp, room, 2)
    seed, mask = zlib.crc32(f"{lang}\n".encode()), 8 * len(marked) - 1
    bits = np.fromiter((zlib.crc32(p.encode("utf-8", "surrogatepass"), seed) & mask for p in phrases(words, ids, places, 2).to_pylist()), dtype=np.int64, count=len(places))
    good = np.zeros(int(ranks[2].max()) + 1, dtype=bool)
    good[ranks[2][places]] = (marked[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1
    pair = good[ranks[2]] & (room >= 2)
    kept = pair.copy()
    kept[1:] |= pair[:-1]
    ends = np.flatnonzero(kept & ~pair)  # a run of pairs ends at a word that begins none
    at = np.flatnonzero(kept)
    if not len(at):
        return
    room = ends[np.searchsorted(ends, at)] - at + 1
    ids = ids[at]
    order, lcp, _ = suffix_array(ids, room, LONGEST)
    for m in range(3, LONGEST + 1):
        places, counts = intervals(order, lcp, room, m)
        yield from rows_of(lang, phrases(words, ids, places, m), m, counts)


def counted(texts: DataFrame, count, block: int) -> DataFrame:
    """COUNTS rows of all blocks of texts (lang, text), by count(lang, translated bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes().translate(TABLE)
                while len(raw) > block and (cut := raw.rfind(b"\n", 0, block)) > 0:  # a long text goes by pieces
                    yield from count(lang, raw[:cut])
                    raw = raw[cut:]
                held.setdefault(lang, []).append(raw)
                size += len(raw)
                if size > block:
                    for own, raws in held.items():
                        yield from count(own, b"\n".join(raws))
                    held, size = {}, 0
        for own, raws in held.items():
            yield from count(own, b"\n".join(raws))

    return texts.mapInArrow(run, COUNTS)


def merged(counts: DataFrame, least: int) -> DataFrame:
    return counts.groupBy("lang", "phrase", "m").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("m") == 0))


def phrase_counts(docs: DataFrame, least: int = LEAST, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """lang, phrase, m (words), n for every phrase of 1 to LONGEST words that occurs `least` times or more in its language; m = 0 has all words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).filter("text != ''")
    short = spool(merged(counted(texts, count_pairs, block), least), "phrase-pairs")
    bit = F.crc32(F.concat("lang", F.lit("\n"), "phrase").cast("binary")).bitwiseAND(F.lit((1 << bits) - 1))
    held = short.filter("m = 2").select(F.shiftright(bit, 5).alias("place"), F.expr("1L").alias("one"), bit.bitwiseAND(F.lit(31)).cast("int").alias("by"))
    cells = held.groupBy("place").agg(F.bit_or(F.expr("shiftleft(one, by)")).alias("cell")).toArrow()  # at most 2 ** bits / 32 rows
    table = np.zeros(1 << (bits - 5), dtype="<u4")
    table[cells["place"].to_numpy()] = cells["cell"].to_numpy().astype("<u4")
    marked = spark.sparkContext.broadcast(table.view(np.uint8))
    longer = spool(merged(counted(texts, lambda lang, raw: count_longer(lang, raw, marked.value), block), least), "phrase-longer")
    return short.unionByName(longer)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, **sizes) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language; sizes as in `phrase_counts`.

    docs needs lang and text; other columns are ignored, whatever their names. A null lang is `und`, a null or empty text has no words; repeated rows
    count each. Words are compared byte by byte after A-Z are lower-cased. Ties of score and a go by the phrase's bytes. A text longer
    than a block is counted piece by piece; a piece (text without marks or line ends) is held by one task. Counts cover all texts; a task
    holds one block. An empty table, and one without frequent phrases, give an empty result.
    """
    grams = phrase_counts(docs, least, **sizes).select("lang", "phrase", "m", "n")
    known = grams.filter("m > 0").select("lang", "phrase", "n")
    candidates = grams.filter("m >= 2").select("lang", "phrase", "m", F.col("n").alias("a"))
    words = F.split("phrase", " ", -1)
    cuts = candidates.select("lang", "phrase", "m", "a", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(words, F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("rest"))
    part = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    total = grams.filter("m = 0").select("lang", "n")
    total = F.broadcast(total) if total.count() <= LANGUAGES else total
    both = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(total, "lang")
    # counts up to 17 digits: neither product exceeds 38
    score = F.expr("(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))) div (CAST(l AS DECIMAL(17,0)) * CAST(r AS DECIMAL(17,0)))")
    weakest = both.withColumn("cut", F.struct(score.alias("score"), "k", "l", "r", "n")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    # a phrase inside a longer one is inside one that is longer by a word and at least as frequent
    inner = F.array(F.array_join(F.slice(words, F.lit(1), F.col("m") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("m") - 1), " "))
    over = candidates.filter("m >= 3").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    own = weakest.join(over, ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * longer < 100 * a").select("lang", "phrase", "a", "cut.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = own.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
parts AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase FROM words, range(1, 6) t(m) WHERE len(w) >= m),
grams AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM parts GROUP BY ALL),
cand AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE m >= 2 AND f >= 100),
cuts AS (SELECT c.*, k, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 : m], ' ') AS y FROM cand c, range(1, 5) t(k) WHERE k < m),
scored AS (SELECT cuts.lang, cuts.phrase, a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts JOIN grams l ON l.lang = cuts.lang AND l.phrase = x JOIN grams r ON r.lang = cuts.lang AND r.phrase = y JOIN total ON total.lang = cuts.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (SELECT lang, a, unnest(flatten(list_transform(range(2, m), lambda j: list_transform(range(1, m - j + 2), lambda i: array_to_string(w[i : i + j - 1], ' '))))) AS phrase FROM cand),
inside AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY ALL),
ranked AS (SELECT s.lang, s.phrase, a, l, r, n, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM weakest s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""
