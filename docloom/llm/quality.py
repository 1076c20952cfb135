"""Document quality by hierarchical empirical Bayes over a text classifier, host and path."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, space_words

FEATURES = ("log_bytes", "letters", "upper", "digits", "marks", "symbols", "spaces", "lines", "word_bytes", "distinct_words", "longest_word")
_KIND = np.full(256, 4, np.uint8)  # 0 lower or non-ASCII, 1 upper, 2 digit, 3 sentence marks, 4 symbols, 5 spaces, 6 line ends
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 0 if _b >= 128 or _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c in ".,;:'\"-()" else 6 if _c == "\n" else 5 if _c.isspace() else 4


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text, all of it; null is empty."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    n = len(texts)
    if not n:
        return np.zeros((0, len(FEATURES)))
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.diff(ends)
    row = np.repeat(np.arange(n) * 7, size)
    kinds = np.bincount(row + _KIND[raw], minlength=7 * n).reshape(n, 7)
    share = kinds / np.maximum(size, 1)[:, None]
    words, bounds = space_words(texts)
    count = np.diff(bounds)
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = np.unique(np.repeat(np.arange(n), count) * (len(words.dictionary) + 1) + codes)
    distinct = np.bincount(pairs // (len(words.dictionary) + 1), minlength=n) if len(pairs) else np.zeros(n)
    lengths = pc.binary_length(words.dictionary).to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0)
    longest = np.zeros(n)
    full = np.flatnonzero(count)
    if len(full):
        longest[full] = np.maximum.reduceat(lengths, bounds[full])
    return np.column_stack([np.log1p(size), share[:, 0] + share[:, 1], share[:, 1], share[:, 2], share[:, 3], share[:, 4], share[:, 5], np.log1p(kinds[:, 6]), np.log1p((size - kinds[:, 5:].sum(1)) / np.maximum(count, 1)), distinct / np.maximum(count, 1), np.log1p(longest)])


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of features and their squares, the last one is the bias

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.clip(np.hstack([z, z * z, np.ones((len(z), 1))]) @ self.weights, -12, 12)


def train(x: np.ndarray, y: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> Classifier:
    """Logistic regression on features and their squares, by Newton steps."""
    if not len(x) or y.min() == y.max():
        bias = 0.0 if not len(x) else 4.0 if y.max() else -4.0
        return Classifier(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.append(np.zeros(2 * len(FEATURES)), bias))
    c = Classifier(x.mean(0), np.maximum(x.std(0), 1e-6), np.zeros(2 * len(FEATURES) + 1))
    z = np.clip((x - c.mean) / c.scale, -6, 6)
    z = np.hstack([z, z * z, np.ones((len(z), 1))])
    penalty = np.append(np.full(2 * len(FEATURES), ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ c.weights, -30, 30)))
        hessian = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty)
        c.weights = c.weights - np.linalg.solve(hessian, z.T @ (p - y) + penalty * c.weights)
    return c


def fit(documents: DataFrame, labels: DataFrame, most: int = 3000, seed: int = 3) -> Classifier:
    """A classifier from documents (doc_id, text) and labels (doc_id, quality 0/1), fitted on about ``most`` labelled
    rows of each class at most, picked by a hash of doc_id, and 4 * ``most`` in all, the first ones by that hash, however many rows share a doc_id. Null or disagreeing labels
    teach nothing.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("hi")).where("quality = hi")
    sizes = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0))
    luck = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("quality") == 1, min(1.0, most / max(1, sizes.get(1, 0)))).otherwise(min(1.0, most / max(1, sizes.get(0, 0))))
    picked = known.where(luck < share).select("doc_id", "quality").orderBy(luck, "doc_id").limit(4 * most)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
    found = rows.mapInArrow(_with_features, "doc_id long, quality int, x array<double>").orderBy(luck, "doc_id", "x").limit(4 * most).collect()
    c = train(np.array([r.x for r in found]).reshape(-1, len(FEATURES)), np.array([r.quality for r in found]))
    have = np.bincount([r.quality for r in found], minlength=2)
    if have.all():  # classes were sampled at different rates; put the odds back
        c.weights[-1] += np.log(sizes[1] / sizes[0]) - np.log(have[1] / have[0])
    return c


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        yield pa.record_batch([batch.column("doc_id"), batch.column("quality"), pa.array(list(features(batch.column("text"))), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])


def _strength(mean: Column, total: Column, n: Column, sites: Column, between: Column) -> Column:
    """Pseudo-counts of a level's prior by the method of moments: what lies between its sites beyond chance."""
    noise = mean * (1 - mean) * (sites - 1)
    spread = F.greatest((between - noise) / F.greatest(n - total / F.greatest(n, F.lit(1.0)), F.lit(1e-9)), F.lit(1e-6))
    return F.least(F.greatest(mean * (1 - mean) / spread - 1, F.lit(2.0)), F.lit(1e4))


def site_quality(documents: DataFrame, classifier: Classifier, host: Column, path: Column) -> DataFrame:
    """(doc_id, doc_score, host_posterior, path_posterior, score, keep) of documents (doc_id, text).

    doc_score is the classifier's probability of good text. Hosts, and paths within hosts, are rated by their
    documents' mean probability, shrunk: a path's towards its host's, a host's towards that of all documents, each
    with as many pseudo-documents as the scatter between sites supports, so sparse sites stay near their prior. A
    document's own evidence is left out of the ratings that it is combined with. score joins the classifier's odds
    with the ratio of the path's odds to the global ones; keep is score >= 1/2. Null hosts and paths are sites of
    their own; null texts are empty; rows come back one for one, without doc_id and repeated ones too.

    Texts are read once. Sites are summed with partial sums in every task, so a host with a third of all rows costs
    no more than another; ratings are joined back by site, with Spark free to split or broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(classifier)
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), key(host).alias("host"), key(path).alias("path"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            logit = shared.value.logit(features(batch.column("text")))
            yield pa.record_batch([batch.column("doc_id"), batch.column("host"), batch.column("path"), pa.array(logit)], ["doc_id", "host", "path", "logit"])

    scored = cut(rows.mapInArrow(run, "doc_id long, host string, path string, logit double")).withColumn("p", 1 / (1 + F.exp(-F.col("logit"))))
    paths = scored.groupBy("host", "path").agg(F.count("*").cast("double").alias("pn"), F.sum("p").alias("ps"))
    hosts = paths.groupBy("host").agg(F.sum("pn").alias("hn"), F.sum("ps").alias("hs"))
    whole = hosts.agg(F.coalesce(F.sum("hs") / F.sum("hn"), F.lit(0.5)).alias("mu")).first()[0]
    mu = F.lit(min(max(whole, 1e-4), 1 - 1e-4))
    between = F.sum(F.col("n") * (F.col("s") / F.col("n") - mu) ** 2)
    level = lambda df, n, s: df.select(F.col(n).alias("n"), F.col(s).alias("s")).agg(_strength(mu, F.sum(F.col("n") ** 2), F.sum("n"), F.count("*"), between)).first()[0] or 2.0
    kh, kp = F.lit(level(hosts, "hn", "hs")), F.lit(level(paths, "pn", "ps"))
    sites = paths.join(hosts, "host")
    own = scored.join(sites, ["host", "path"])
    h = (F.col("hs") - F.col("p") + kh * mu) / (F.col("hn") - 1 + kh)
    t = F.least(F.greatest((F.col("ps") - F.col("p") + kp * h) / (F.col("pn") - 1 + kp), F.lit(1e-4)), F.lit(1 - 1e-4))
    odds = F.col("logit") + F.log(t / (1 - t)) - F.log(mu / (1 - mu))
    return own.select("doc_id", F.col("p").alias("doc_score"), h.alias("host_posterior"), t.alias("path_posterior"), (1 / (1 + F.exp(-odds))).alias("score")).withColumn("keep", F.col("score") >= 0.5)
