"""Operators of the training-data subpackage against plain Python, libraries and planted cases; nulls, empty texts, repeats, clashing columns."""

import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftnet.llm import bpe, license_scan, quality, sharding, token_count, tool_links, toxicity, url_trust

TEXTS = [None, "", " \n", "a", "The cat's 12,000 dogs!! <|endoftext|> x", "Ünï çode ẞ İ ΑΣ", "word " * 3000, "ab" * 4000, "The cat's 12,000 dogs!! <|endoftext|> x", "x\n\ny\n\n  z\t", "日本語 текст 123", "<|startoftext|>Mixed CASE"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    extra = ["".join(rng.choice(["a", "B", " ", "  ", "\n", "é", "'s", "9", "%", "漢", "<|endoftext|>"]) for _ in range(rng.randint(0, 50))) for _ in range(300)]
    rows = [(k if k != 7 else None, t, "en" if k % 2 else None) for k, t in enumerate(TEXTS + extra)]
    return spark.createDataFrame([*rows, rows[4]], "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("n", "key", "shard", "n_tokens", "w")})


def by_text(docs):
    return {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}


def test_token_counts(docs):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    out = token_count.count_tokens(docs, 512).collect()
    assert len(out) == docs.count()
    for r in out:
        text = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(lib.encode(text, add_special_tokens=False).ids))
        assert r["over_limit"] == (r["n_tokens"] > 512)
    assert token_count.count_tokens(docs.limit(0), 512).count() == 0


def test_long_words_merge_as_short_ones_do():
    rng = random.Random(5)
    path = public_tokenizers.path(token_count.VOCABULARY)
    merger, library = token_count.RankMerger(path), Tokenizer.from_file(path)
    short = [bytes(rng.choices(b"abcdeeeaastno\xc3\xa9 ", k=rng.randint(1, 60))) for _ in range(1000)] + [b"a" * n for n in range(1, 90)] + [b"ab" * n for n in range(1, 40)]
    assert merger.counts(short).tolist() == [merger.long_count(s) for s in short]
    words = ["".join(rng.choices("etaoinshrdlu", k=n)) for n in (token_count.LONG, token_count.LONG + 1, 5000, 200_000)] + ["a" * 30_001, "ab" * 3001]
    assert merger.counts([w.encode() for w in words]).tolist() == [len(library.encode(w, add_special_tokens=False).ids) for w in words]


@pytest.mark.parametrize("chunk", [bpe.CHUNK, 100, 1])
def test_bpe_round_trip(docs, chunk):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    out = bpe.encode_decode(docs, chunk=chunk).collect()
    assert len(out) == docs.count()
    for r in out:
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        want = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want
    assert bpe.encode_decode(docs.limit(0), chunk=chunk).count() == 0


def test_words_of_odd_texts():
    """Cut as the library does: control characters, endings behind apostrophes, letters that grow or shrink in lower case, marks."""
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, splitter = Tokenizer.from_file(path), bpe.Splitter(path)
    rng = random.Random(8)
    pieces = ["'", "'s", "'RE", "'ll", "'l", "''", "a", "B", "é", "e\u0301", "İ", "Σ", "ß", "\x1c", "\x85", "\u200b", "\x00", "\xa0", "٣", "½", "漢", "-", "<|endoftext|>", "<|startoftext|>", "<|", " ", "\n", "\u0300", "𝐀", "'t"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    words, places, sizes = bpe.numbered(splitter, texts)
    cut = np.split(places, np.cumsum(sizes)[:-1])
    for text, own in zip(texts, cut, strict=True):
        ids = [i for k in own for i in ([splitter.specials[words[k].decode()]] if words[k].decode() in splitter.specials else lib.encode(words[k].decode(), add_special_tokens=False).ids)]
        assert ids == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_bpe_gives_ids_and_texts(docs):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in bpe.encode_decode(docs, digests=False).collect():
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids"], r["decoded"]) == (len(ids), ids, lib.decode(ids, skip_special_tokens=False))


def test_packing():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, (1 << 21) - 1, 1 << 21, (1 << 28) - 1])
    assert bpe.unpack(bpe.pack(numbers)).tolist() == numbers.tolist() and bpe.unpack(b"").tolist() == []


def test_sharding(docs):
    out = sharding.shard_documents(docs, 7).collect()
    sizes = Counter(r["shard"] for r in out)
    assert len(out) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for k in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sizes[k]))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 16, zlib.crc32(texts[r["doc_id"]])) for r in out)
    assert sharding.shard_documents(docs.limit(0), 7).count() == 0


def test_communication_matrix(spark):
    sizes = [5, 0, 1000, 37, 2]
    lines = lambda held, seed: {r["part"]: r["line"] for r in sharding.communication_lines(spark.createDataFrame(held, "part int, n long"), 6, seed).collect()}
    m = lines(list(enumerate(sizes)), 1)
    assert [sum(m[p]) for p in range(5)] == sizes and sorted(map(sum, zip(*m.values(), strict=True))) == [174] * 6
    assert m == lines(list(enumerate(sizes)), 1) != lines(list(enumerate(sizes)), 2)
    far = lines([(3, 10), (70_000, 20), (70_001, 3)], 4)  # three levels, parts missing between
    assert {p: sum(v) for p, v in far.items()} == {3: 10, 70_000: 20, 70_001: 3} and sorted(map(sum, zip(*far.values(), strict=True))) == [5, 5, 5, 6, 6, 6]
    assert lines([], 1) == {}
    large = sharding.deal(np.random.default_rng(2), sharding.shard_sizes(10**11 + 3, 7), [10**10, 0, 9 * 10**10 + 3])
    assert [int(v.sum()) for v in large] == [10**10, 0, 9 * 10**10 + 3] and (sum(large) == sharding.shard_sizes(10**11 + 3, 7)).all()
    assert abs(large[0] - 10**10 / 7).max() < 8 * (10**10 / 7) ** 0.5
    rng = np.random.default_rng(3)
    drawn = np.array([sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)])
    assert abs(drawn.mean() - 6) < 0.15 and abs(drawn.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    big = sharding.hypergeometric(rng, 3 * 10**10, 7 * 10**10, 10**6)
    assert abs(big - 300_000) < 5000


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, docs, small):
    every = docs.select("doc_id", "text", "lang").unionByName(spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id") + 10_000, "text", "lang").toDF("doc_id", "text", "lang"))
    texts = {r["doc_id"]: r["text"] or "" for r in every.collect()}
    out = quality.judge(every.withColumn("kept", F.lit("clash"))).collect()
    assert len(out) == every.count()
    for r in out:
        base = brute_base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and not (r["base_failed"] and r["kept"])
    assert {r["doc_id"] for r in quality.keep_good(every).collect()} == {r["doc_id"] for r in out if r["kept"]}


def test_fertility_is_the_librarys(spark, docs, small):
    """Tokens, byte share, entropy and verdict of every row against the library on the whole text."""
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(quality.VOCABULARY))
    odd = ["ab\ncd", "  a  b   ", " ", "a ", " a\u2581 b", "x\t\ty", "\u00a0a", "line\r\nline\r\n", "漢字 かな\n" * 60]
    every = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(2000 + k, t, "xx") for k, t in enumerate(odd)], "doc_id long, text string, lang string"))
    every = every.union(spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet").select(F.col("doc_id") + 10_000, "text", "lang"))
    rows = {r["doc_id"]: (r["text"] or "", r["lang"]) for r in every.collect()}
    for r in quality.judge(every).collect():
        text, lang = rows[r["doc_id"]]
        pieces = lib.encode(text)
        n, counts = len(pieces), Counter(pieces)
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
        bytes_ = sum(c for p, c in counts.items() if lib.is_byte(p) or lib.is_unknown(p)) / max(n, 1)
        assert r["n_tokens"] == n and abs(r["byte_share"] - bytes_) < 1e-12 and abs(r["token_entropy"] - entropy) < 1e-9, repr(text)
        base = brute_base(text)
        assert abs(r["chars_per_token"] - base[1] / max(n, 1)) < 1e-12
        band = quality.LANGUAGE_BANDS.get(lang) or quality.SCRIPT_BANDS[r["band"]]
        good = n > 0 and band.min_chars <= base[1] / n <= band.max_chars and bytes_ <= band.max_bytes and (n < band.entropy_tokens or entropy >= band.min_entropy)
        assert r["kept"] == (good and not r["base_failed"])


def test_quality_keeps_clean(spark, small):
    d = small.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    judged = [(labels[r["doc_id"]], r["kept"]) for r in quality.judge(spark.read.parquet(f"{d}/documents.parquet")).collect() if r["doc_id"] in labels and not r["base_failed"]]
    good = [k for q, k in judged if q == 1]
    assert sum(good) / len(good) > 0.97


def test_matrix_of_many_partitions(spark):
    counts = spark.range(100_000).select(F.col("id").cast("int").alias("part"), (F.col("id") % 900 + 50).alias("n"))
    began = time.time()
    out = sharding.communication_lines(counts, 40, 5).select("part", F.aggregate("line", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), *[F.col("line")[k].alias(f"c{k}") for k in range(40)])
    sums = out.join(counts.withColumnRenamed("n", "due"), "part").agg(F.count("*"), F.count_if(F.col("n") != F.col("due")), *[F.sum(f"c{k}") for k in range(40)]).first()
    assert sums[:2] == (100_000, 0) and max(sums[2:]) - min(sums[2:]) <= 1 and time.time() - began < 60


def test_shuffle_is_uniform(spark):
    """Where a row stood tells nothing of its shard and slot: tables of counts stay within what chance allows."""
    n, shards = 24_000, 4
    rows = spark.range(0, n, 1, 6).select(F.col("id"))
    for seed in (1, 2, 3):
        out = np.array([(r["id"], r["shard"], r["slot"]) for r in sharding.shuffle_rows(rows, shards, seed).collect()])
        cells = np.zeros((12, shards, 6))
        np.add.at(cells, (out[:, 0] * 12 // n, out[:, 1], out[:, 2] * 6 * shards // n), 1)
        chi = ((cells - n / cells.size) ** 2 / (n / cells.size)).sum()
        free = cells.size - 12 - 24 + 1
        assert abs(chi - free) < 5 * (2 * free) ** 0.5
    with pytest.raises(ValueError, match="clash"):
        sharding.shuffle_rows(rows.withColumn("Slot", F.lit(1)), shards)


def brute_license(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        found = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_scan(spark, docs, small):
    planted = [(5001, "x MIT License MIT  license apache-license"), (5002, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"), (5003, "the licensed license of the under")]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string")).union(spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id") + 10_000, "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in every.collect()}
    out = {r["doc_id"]: r for r in license_scan.scan_licenses(every).collect()}
    for k, r in out.items():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_license(texts[k])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert out[5002]["labels"] == "bsd" and out[5002]["score"] == 1 and out[5003]["labels"] == ""


def test_short_license_beside_a_long_notice():
    common = {w: 600 for w in license_scan.split_words("Licensed under CC BY 4.0")}
    every = {w for _, _, text in license_scan.TEMPLATES for w in license_scan.split_words(text)}
    index = license_scan.TemplateIndex(frequency={w: 5 for w in every} | common, documents=10_000)
    mit = license_scan.TEMPLATES[0][2]
    assert index.scan(f"{mit}\nLicensed under CC BY 4.0")[5] == "cc-by,mit"
    assert index.scan("\n".join(text for _, _, text in license_scan.TEMPLATES))[5] == ",".join(sorted({label for label, _, _ in license_scan.TEMPLATES}))


def brute_labels(text):
    """Labels and best share over all templates and all places."""
    words, labels, best = license_scan.split_words(text), set(), 0.0
    holds = lambda phrase: any(words[k : k + len(phrase)] == phrase for k in range(len(words)))
    for label, keys, template in license_scan.TEMPLATES:
        own = license_scan.split_words(template)
        share = max((sum(0 <= o + k < len(words) and words[o + k] == w for k, w in enumerate(own)) / len(own) for o in range(-len(own), len(words))), default=0.0)
        if share >= license_scan.THRESHOLD:
            best = max(best, share)
            labels |= {label} if any(holds(license_scan.split_words(k)) for k in keys) else set()
    return labels | {label for phrase, label in license_scan.BASE if holds(license_scan.split_words(phrase))}, round(best, 6)


def test_license_labels_against_brute_force(spark):
    """Notices with words changed, dropped or cut, in corpora where their words are rare and where they are common."""
    rng = random.Random(8)
    texts = ["", None, "be", "All rights reserved"]
    for _, _, template in license_scan.TEMPLATES:
        words = template.split()
        for _ in range(4):
            texts.append(" ".join([*rng.choices(words, k=rng.randint(0, 9)), *(w if rng.random() < 0.8 else rng.choice(words) for w in words[rng.randint(0, 3) :])]))
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("labels", "score", "n_words")})
    for noise in (0, 400):  # with noise, licence words stand in a fifth to all of the documents
        more = spark.range(noise).select((F.col("id") + 1000).alias("doc_id"), F.lit(" ".join(sorted({w for _, _, t in license_scan.TEMPLATES for w in t.split()}))).alias("text")).withColumns({c: F.lit(1) for c in ("labels", "score", "n_words")})
        out = {r["doc_id"]: r for r in license_scan.scan_licenses(rows.unionByName(more)).collect()}
        for k, t in enumerate(texts):
            labels, share = brute_labels(t or "")
            assert (set(filter(None, out[k]["labels"].split(","))), out[k]["score"]) == (labels, share), t
    assert license_scan.scan_licenses(rows.limit(0)).count() == 0


def test_common_words_lose_no_label():
    """All notice words in 30 % of the documents; single words of the notices changed."""
    every = {w for _, _, text in license_scan.TEMPLATES for w in license_scan.split_words(text)}
    index = license_scan.TemplateIndex(frequency={w: 3000 for w in every}, documents=10_000)
    mit, own = license_scan.TEMPLATES[0][2], license_scan.TEMPLATES[-1][2]
    assert index.scan(own.replace(" be ", " get "))[5] == "proprietary"
    assert index.scan(" ".join(w if w not in ("a", "and") else "x" for w in mit.split()))[5] == "mit"


def test_distrust_has_no_hop_limit(spark):
    """A chain of 20 hosts whose last links to a blocked host that was never fetched, among 1000 hosts without links."""
    pages = [(k, f"http://chain{k}.io/", f"http://chain{k + 1}.io/" if k < 19 else "http://bad.net/") for k in range(20)] + [(100 + k, f"http://alone{k}.io/", "x " * 50_000 if k == 0 else "") for k in range(1000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r["page_id"]: r["verdict"] for r in url_trust.judge_pages(frame).collect()}
    assert all(out[k] == "block" for k in range(20)) and all(out[k] == "allow" for k in range(100, 1100))
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    told = con.execute(url_trust.judge_pages_sql())
    names = [c[0] for c in told.description]
    assert {r[names.index("page_id")]: r[names.index("verdict")] for r in told.fetchall()} == out


def test_ordinal_regression_holds_out():
    rng = np.random.default_rng(5)
    x = rng.poisson(0.6, (3000, 12)).astype(float)
    w = np.array([2.0, 1.5, -1.0] + [0.0] * 9)
    latent = x @ w + rng.logistic(size=3000)
    grades = np.digitize(latent, [0.5, 2.5, 4.5])
    weights, cuts = toxicity.fit_ordinal(x[:2000], grades[:2000])
    assert list(cuts) == sorted(cuts) and abs(weights[:3] - w[:3]).max() < 0.4
    expected = lambda w, c: (1 / (1 + np.exp(c[None, :] - (x[2000:] @ w)[:, None]))).sum(axis=1)
    severity, best = expected(weights, cuts), expected(w, np.array([0.5, 2.5, 4.5]))  # the model that made the data
    assert np.abs(severity - best).mean() < 0.1
    assert ((severity - grades[2000:]) ** 2).mean() < 1.03 * ((best - grades[2000:]) ** 2).mean()


def test_toxicity_holds_out(spark, small):
    d = small.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 20 < 12"))
    rest = toxicity.score_toxicity(docs, model).withColumnRenamed("toxic", "told").join(labels.filter("doc_id % 20 >= 12"), "doc_id")
    n = {(r["toxic"], r["told"]): r["n"] for r in rest.groupBy("toxic", "told").agg(F.count("*").alias("n")).collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.8 and n.get((0, True), 0) / n[0, False] < 0.02
    empty = toxicity.train(docs.limit(0), labels)
    assert toxicity.score_toxicity(docs.limit(5), empty).filter("toxic OR severity > 0").count() == 0


def test_toxicity_does_not_depend_on_the_order_of_rows(spark, small):
    d = small.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    one, two = toxicity.train(docs, labels), toxicity.train(docs.repartition(7, "text").orderBy(F.desc("doc_id")), labels.repartition(3))
    assert one == two and one.weights


def test_scores_against_plain_python(spark, small, docs):
    d = small.replace("sf0.001", "sf0.01")
    every = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").union(docs.select(F.col("doc_id") + 50_000, "text"))
    model = toxicity.train(every, spark.read.parquet(f"{d}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] or "" for r in every.collect()}
    for r in toxicity.score_toxicity(every.withColumn("severity", F.lit("clash")), model).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]]))
        words = [w.encode() for w in words]
        score = 0.0
        for f, weight in model.weights.items():
            n = sum(w.startswith(f[:-1]) and len(w) >= len(f) for w in words) if f.endswith(b"*") else words.count(f)
            score += weight * math.log1p(n)
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert abs(r["severity"] - sum(above)) < 1e-5 and r["toxic"] == (above[0] >= toxicity.TOXIC_FROM)


def test_given_grades_are_learnt(spark):
    """Grades that readers gave, not made from the features: their order shows in the expected severity of unseen texts."""
    rng = random.Random(4)
    mild, harsh, plain = [f"mild{chr(97 + k)}" for k in range(6)], [f"harsh{chr(97 + k)}" for k in range(6)], [f"plain{k}" for k in range(300)]
    rows = []
    for k in range(900):
        grade = k % 4
        own = [rng.choice(plain) for _ in range(40)] + [rng.choice(mild) for _ in range((0, 3, 1, 1)[grade])] + [rng.choice(harsh) for _ in range((0, 0, 2, 5)[grade])]
        rng.shuffle(own)
        rows.append((k, " ".join(own), grade))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.filter("doc_id < 600"))
    held = {r["doc_id"]: r["severity"] for r in toxicity.score_toxicity(docs.filter("doc_id >= 600"), model).collect()}
    mean = [np.mean([s for k, s in held.items() if k % 4 == g]) for g in range(4)]
    assert len(model.thresholds) == 3 and mean == sorted(mean) and mean[0] < 0.3 and mean[3] > 2.3


CALLS = [
    (1, 0, "a", "add", '{"x": 1, "y": 2}', []), (1, 1, "b", "add", '{"y": "no", "x": 1}', ["c"]), (1, 2, "c", "add", "{}", ["zz", None]), (1, 3, "d", "none", "{", ["a"]),
    (2, 0, "p", "add", '{"x":1,"y":2}', ["q"]), (2, 1, "q", "add", '{"x":1,"y":2}', ["p"]), (None, 0, "n", "add", "{}", []), (1, 9, "a", "add", "{}", []),
]
RESULTS = [(1, 1, "a", "3"), (1, 5, "a", "late"), (1, 0, "c", "early"), (1, 4, "b", None), (3, 0, "o", "orphan")]


def test_tool_links(spark):
    schema = {"add": {"type": "object", "required": ["x", "y"], "properties": {"x": {"type": "integer"}, "y": {"type": "integer"}}}}
    calls, results = spark.createDataFrame(CALLS, tool_links.CALLS), spark.createDataFrame(RESULTS, tool_links.RESULTS)
    out = {(r["conv_id"], r["call_id"]): r for r in tool_links.link(calls.withColumn("place", F.lit(0)), results, schema).collect()}
    assert {k: r["status"] for k, r in out.items()} == {(1, "a"): "linked", (1, "b"): "linked", (1, "c"): "early", (1, "d"): "open", (2, "p"): "cyclic", (2, "q"): "cyclic", (3, "o"): "orphan"}
    places = {k[1]: r["place"] for k, r in out.items() if k[0] == 1}
    assert sorted(places.values()) == [1, 2, 3, 4] and places["b"] > places["c"]
    assert out[1, "a"]["valid"] and out[1, "a"]["json"] == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","needs":[],"result":"3"}'
    assert out[1, "b"]["errors"] == "$.y: not integer" and out[1, "c"]["errors"] == "$.x: missing; $.y: missing; needs zz: unknown" and out[1, "d"]["errors"] == "$: not JSON"
    assert json.loads(out[1, "c"]["json"])["result"] == "early"
    assert tool_links.link(calls.limit(0), results.limit(0), schema).count() == 0


def test_arguments_that_are_no_json(spark):
    deep = "[" * 100_000 + "]" * 100_000
    bad = ["NaN", '{"x": NaN}', '{"x": -Infinity}', '{"x": 1e400}', "9" * 5000, "{", deep, "[" * 980 + "]" * 980]
    odd = ['{"prompt": "\\ud800", "turn": 1}', '{"\\udfff": 1}', '{"x": 1, "x": 2}', None]
    calls = spark.createDataFrame([(1, k, f"c{k:02}", "reply", a, []) for k, a in enumerate(bad + odd)], tool_links.CALLS)
    results = spark.createDataFrame([(1, 99, f"c{k:02}", "r") for k in range(len(bad + odd))], tool_links.RESULTS)
    out = {r["call_id"]: r for r in tool_links.link(calls, results).collect()}
    assert len(out) == len(bad + odd)
    for k in range(len(bad) - 1):
        assert out[f"c{k:02}"]["errors"] == "$: not JSON" and not out[f"c{k:02}"]["valid"] and json.loads(out[f"c{k:02}"]["json"])["arguments"] == bad[k]
    assert out["c07"]["errors"] in ("$: not JSON", "$: not object")
    assert out["c08"]["valid"] and '"prompt":"\\ud800"' in out["c08"]["json"]
    assert "\\udfff: not allowed" in out["c09"]["errors"] and '"x":2' in out["c10"]["json"] and out["c11"]["errors"] == "$: not object"


def test_url_parts_and_trust(spark):
    urls = [None, "nohost", "HTTP://A.Example.NET/en/x?y", "http://b.example.net", "https://x.org/fr/1#t", "http://x.org?q=/", "ftp://sub.example.com/de/z", "http://hub.io/a", "http://bad.io/b", "http://netz/"]
    pages = spark.createDataFrame([(k, u, '<a href="http://b.example.net/">' if k == 8 else "<p>") for k, u in enumerate(urls)], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    out = {r["page_id"]: r for r in url_trust.judge_pages(pages).collect()}
    assert [(out[k]["host"], out[k]["path"]) for k in range(6)] == [("", ""), ("", ""), ("a.example.net", "/en/x"), ("b.example.net", ""), ("x.org", "/fr/1"), ("x.org", "")]
    assert [out[k]["rule"] for k in (2, 3, 4, 5, 6, 9)] == ["example.net/en/", None, "org/fr/", None, "example.com/de/", None]
    assert out[2]["verdict"] == "allow" and out[6]["verdict"] == "block" and out[0]["verdict"] == "allow"
    assert url_trust.judge_pages(pages.limit(0)).count() == 0


def brute_trust(pages):
    """Verdicts in plain Python: rules, then trust along links and distrust against them, by ten rounds of a walk with restarts."""
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

    def cut(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        return (m[1].lower(), m[2]) if m else ("", "")

    def rule(host, path):
        fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        return max(fit, key=lambda r: len(r[1] + r[2]))[0] if fit else None

    told, links = {}, Counter()
    for url, html in pages:
        host, path = cut(url)
        if host:
            told.setdefault(host, []).append(rule(host, path))
    seen = {}
    for url, html in pages:
        src = cut(url)[0]
        for dst, path in {cut(u) for u in re.findall(url_trust.LINK, html or "")} if src else ():
            if dst and dst != src:
                links[src, dst] += 1
                seen.setdefault(dst, []).append(rule(dst, path))
    told = seen | told

    def walk(kind, edges):
        seeds = {h: v.count(kind) / len(v) for h, v in told.items() if kind in v}
        seeds = {h: s / sum(seeds.values()) for h, s in seeds.items()}
        out = Counter()
        for (a, _), n in edges.items():
            out[a] += n
        rank = dict(seeds)
        for _ in range(200):
            new = Counter({h: 0.15 * s for h, s in seeds.items()})
            for (a, b), n in edges.items():
                new[b] += 0.85 * rank.get(a, 0) * n / out[a]
            rank = new
        return {h: r / sum(rank.values()) for h, r in rank.items()} if seeds else {}

    trust, distrust = walk("allow", links), walk("block", Counter({(b, a): n for (a, b), n in links.items()}))
    bad = {h for h in told if round(distrust.get(h, 0) - trust.get(h, 0), 9) > 0 and round(distrust.get(h, 0) * len(told), 9) > 1}
    return [rule(*cut(u)) or ("block" if cut(u)[0] in bad else "allow") for u, _ in pages]


def test_verdicts_against_plain_python(spark):
    """Blocked hosts without pages of their own, ports, one label, links in all places."""
    rng = random.Random(6)
    hosts = ["hub.io", "a.org", "b.org", "bad.net", "worse.net:8080", "localhost", "fan.io", "x.example.net", "y.example.com", "solo.io"]
    pages = [("http://hub.io/x", 'see <a href="http://bad.net/">'), ("http://fan.io/", "http://worse.net:8080/p and http://hub.io/"), ("http://solo.io/", None), (None, "http://bad.net/"), ("http://solo.io/", "no link")]
    for _ in range(60):
        pages.append((f"http://{rng.choice([h for h in hosts if 'net' not in h])}/{rng.choice(['fr/', 'de/', 'en/', ''])}", " ".join(f"<a href='HTTP://{rng.choice(hosts)}/{rng.choice(['fr/', 'de/', 'en/', ''])}?q'>" for _ in range(rng.randint(0, 3)))))
    frame = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string").withColumns({"dst": F.lit("clash"), "n": F.lit(1)})
    out = {r["page_id"]: r["verdict"] for r in url_trust.judge_pages(frame).collect()}
    want = brute_trust(pages)
    assert [out[k] for k in range(len(pages))] == want
    assert want[1] == "block"  # fan.io, which only links to a blocked host without pages, and to hub.io
    con = duckdb.connect()
    con.register("pages", pd.DataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], columns=["page_id", "url", "html"]))
    told = con.execute(url_trust.judge_pages_sql())
    names = [c[0] for c in told.description]
    assert {r[names.index("page_id")]: r[names.index("verdict")] for r in told.fetchall()} == out


def test_distrust_goes_against_links(spark):
    hosts = spark.createDataFrame([("good", 1, 1, 0), ("bad", 1, 0, 1), ("friend", 1, 0, 0), ("fan", 1, 0, 0)], "host string, n_pages long, n_allow long, n_block long")
    links = spark.createDataFrame([("good", "friend", 1), ("fan", "bad", 3)], "src string, dst string, n long")
    scores = {r["host"]: r for r in url_trust.host_scores(hosts, links).collect()}
    assert scores["friend"]["trust"] > 0 and scores["friend"]["distrust"] == 0 and scores["fan"]["distrust"] > 0 and scores["fan"]["trust"] == 0
