"""Toxicity by cumulative-link ordinal regression.

P(grade <= k) = logistic(threshold_k - x.w): one weight vector over sparse word features serves all ordered thresholds. The expected grade is
the severity. Features are the words whose document frequencies differ most between toxic and clean labelled
documents, and beginnings of words; of copies in the sample one speaks. The fit uses a bounded sample of labelled documents, the scores
cover all rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.llm.common import spool, table, trimmed
from driftnet.llm.license_scan import split_words
from driftnet.llm.near_dup import multipliers, shingle_set, signature

#: Labelled documents that the fit may see.
SAMPLE_ROWS = 12_000
#: Signature coordinates by which copies within the sample are found.
COPY_COORDINATES = 8
#: Words with fewer sampled documents, or a smaller log-odds z-score, are no features; the strongest ones are taken.
MIN_DOCS, MIN_Z, MAX_FEATURES = 5, 3.2, 512
RIDGE, STEPS, RATE = 1e-4, 1500, 0.05
#: A document is toxic when P(grade >= 1) reaches this.
TOXIC_FROM = 0.4


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """Weights by word and ordered thresholds; without thresholds every grade is 0."""

    weights: dict[bytes, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def at_most(self, score: float) -> np.ndarray:
        """P(grade <= k) for each k below the top grade."""
        return sigmoid(np.array(self.thresholds) - score)

    def score(self, words: list[bytes]) -> float:
        return sum(self.weights[w] * np.log1p(count_feature(words, w)) for w in sorted(self.weights.keys() & features_of(words)))


def fit_ordinal(x: np.ndarray, grades: np.ndarray, ridge: float = RIDGE, steps: int = STEPS, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of a cumulative-link model by full-batch Adam; grades are 0..K with each present."""
    top = int(grades.max())
    n, d = x.shape
    share = np.array([(grades <= k).mean() for k in range(top)]).clip(1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(d), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])  # gaps as logarithms keep the order
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        gaps = np.exp(p[d + 1 :])
        theta = np.concatenate([p[d : d + 1], p[d] + np.cumsum(gaps)])
        s = x @ p[:d]
        upper = np.where(grades < top, sigmoid(theta[np.minimum(grades, top - 1)] - s), 1.0)
        lower = np.where(grades > 0, sigmoid(theta[np.maximum(grades - 1, 0)] - s), 0.0)
        like = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / like, lower * (1 - lower) / like
        g = np.zeros_like(p)
        g[:d] = x.T @ (du - dl) / n + ridge * p[:d]
        g_theta = np.array([(-du[grades == k].sum() + dl[grades == k + 1].sum()) / n for k in range(top)])
        g[d] = g_theta.sum()
        g[d + 1 :] = np.cumsum(g_theta[::-1])[::-1][1:] * gaps
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:d], np.concatenate([p[d : d + 1], p[d] + np.cumsum(np.exp(p[d + 1 :]))])


def features_of(words: list[bytes]) -> set[bytes]:
    """The distinct words, and their beginnings of 4 to 6 bytes with a star behind."""
    own = set(words)
    return own.union(w[:k] + b"*" for w in own for k in (4, 5, 6) if len(w) > k)


def count_feature(words: list[bytes], f: bytes) -> int:
    return words.count(f) if f[-1:] != b"*" else sum(len(w) >= len(f) and w.startswith(f[:-1]) for w in words)


def signing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by = multipliers(COPY_COORDINATES)
    for batch in batches:
        signs = [signature(shingle_set(t, 3), by) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signs, pa.list_(pa.int32()))], names=["row", "sig"])


def first_of_copies(rows: list) -> set[int]:
    """Rows that share no signature coordinate with an earlier row, so that a group of copies speaks once."""
    seen: list[set] = [set() for _ in range(COPY_COORDINATES)]
    kept = set()
    for r in sorted(rows, key=lambda r: r["row"]):
        if not any(v in s for v, s in zip(r["sig"], seen, strict=True)):
            kept.add(r["row"])
        for v, s in zip(r["sig"], seen, strict=True):
            s.add(v)
    return kept


def distinct_features(kept: set[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bad = [], []
            for row, toxic, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if row in kept:
                    own = features_of(split_words(text or ""))
                    words += own
                    bad += [toxic] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(bad, pa.int32())], names=["word", "toxic"])

    return run


def counting_features(vocabulary: list[bytes], kept: set[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: k for k, w in enumerate(vocabulary)}
        for batch in batches:
            toxics, ids, counts = [], [], []
            for row, toxic, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if row in kept:
                    words = split_words(text or "")
                    own = sorted(at.keys() & features_of(words))
                    toxics.append(toxic)
                    ids.append([at[w] for w in own])
                    counts.append([count_feature(words, w) for w in own])
            kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((toxics, ids, counts), kinds, strict=True)], names=["toxic", "ids", "counts"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fits on at most sample_rows labelled documents, chosen by the hash of their id.

    labels: doc_id, toxic (0 or 1, or a grade from 0 up). Grades above 1 are taken as they are. Where toxic is only 0
    or 1, toxic documents are graded 1 or 2: 2 if they hold at least the median number of marker words of toxic
    documents, markers being the words that are commoner in toxic documents. These two grades are made from words that are features as well, so on such labels
    the step from 1 to 2 only orders documents by how many markers they hold; given grades are needed to learn more. Null ids or labels are
    left out, the highest of repeated labels holds; repeated rows count once. Without documents of two grades the model gives 0 to all. The model does not
    depend on the order or partitioning of docs.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # named and ordered by content, so that the fit does not depend on how the rows lie
    sample = spool(found.select(F.xxhash64("doc_id", "text").alias("row"), "toxic", "text").dropDuplicates(["row"]), "toxic-sample")
    kept = first_of_copies(sample.select("row", "text").mapInArrow(signing, "row long, sig array<int>").collect())
    totals = Counter(r["toxic"] for r in sample.select("row", "toxic").collect() if r["row"] in kept)
    good, bad = totals.get(0, 0), sum(n for g, n in totals.items() if g > 0)
    if not good or not bad:
        return OrdinalModel()
    sums = sample.mapInArrow(distinct_features(kept), "word binary, toxic int").groupBy("word").agg(F.count("*").alias("n"), F.sum((F.col("toxic") > 0).cast("long")).alias("b"))
    b, g = F.col("b") + 0.5, F.col("n") - F.col("b") + 0.5
    no_b, no_g = F.lit(bad + 1) - b, F.lit(good + 1) - g
    z = (F.log(b / no_b) - F.log(g / no_g)) / F.sqrt(1 / b + 1 / g + 1 / no_b + 1 / no_g)
    features = sums.filter(F.col("n") >= MIN_DOCS).withColumn("z", z).filter(F.abs("z") >= MIN_Z).orderBy(F.desc(F.abs("z")), "word").limit(MAX_FEATURES).collect()
    if not features:
        return OrdinalModel()
    vocabulary = [bytes(r["word"]) for r in features]
    rows = sample.mapInArrow(counting_features(vocabulary, kept), "toxic int, ids array<int>, counts array<int>").collect()
    rows.sort(key=lambda r: (r["toxic"], r["ids"], r["counts"]))
    x = np.zeros((len(rows), len(vocabulary)))
    for k, r in enumerate(rows):
        x[k, r["ids"]] = r["counts"]
    grades = np.array([r["toxic"] for r in rows])
    if grades.max() == 1:
        marked = x[:, [r["z"] > 0 for r in features]].sum(axis=1)
        grades = grades + ((grades == 1) & (marked >= max(1, np.median(marked[grades == 1]))))
    steps = np.unique(grades)  # grades that nobody has collapse
    weights, thresholds = fit_ordinal(np.log1p(x), np.searchsorted(steps, grades))
    return OrdinalModel(dict(zip(vocabulary, weights.tolist(), strict=True)), thresholds.tolist())


def scoring(model: OrdinalModel, toxic_from: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = model.at_most(0.0)
        for batch in batches:
            rows = []
            for text in batch.column(batch.schema.names.index("text")).to_pylist():
                words = split_words(text or "")
                score = model.score(words) if model.weights else 0.0
                below = model.at_most(score) if score else plain
                share = np.diff(np.concatenate(([0.0], below, [1.0])))
                rows.append((round(float((1 - below).sum()), 6), int(share.argmax()), bool(len(below) and 1 - below[0] >= toxic_from)))
            rest = [n for n in batch.schema.names if n != "text"]
            added = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 3, (pa.float64(), pa.int32(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *added], names=[*rest, "severity", "grade", "toxic"])

    return run


def score_toxicity(docs: DataFrame, model: OrdinalModel, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """doc_id, severity (expected grade), grade (likeliest), toxic for every row of docs.

    docs needs doc_id and text; other columns are ignored, whatever their names. A null or empty text has no features and gets the score
    of such a text. Whole texts count, whatever their length; repeated rows and null ids are scored like any others.
    """
    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(trimmed(scoring(model, toxic_from)), f"doc_id {dict(narrow.dtypes)['doc_id']}, severity double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """The rows of docs that are not toxic, with all their columns."""
    score, schema = scoring(model, toxic_from), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index("text"))], names=["text"])
            for told in score(iter([text])):
                yield batch.filter(pa.compute.invert(told.column(told.schema.names.index("toxic"))))

    return docs.mapInArrow(trimmed(run), schema)


def judge_documents(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
