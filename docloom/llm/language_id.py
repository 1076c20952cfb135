"""Language identification by nearest centroid over TF-IDF n-gram vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import letters_only, slices, translated

#: The text's column inside tasks, apart from what callers keep.
WHOLE = "whole text"
#: Hashed features: one byte, two and three bytes.
ONE, TWO, THREE = 256, 2048, 6144
WIDTH = ONE + TWO + THREE
LETTER = re.compile(r"[^\W\d_]")
#: Bytes and rows of texts whose vectors are in memory at once: 17 MB of counts.
BYTES, ROWS = 1 << 20, 256
_TABLE = letters_only()


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray  # float32, a weight for each feature
    centroids: np.ndarray  # a row for each cluster
    owner: np.ndarray  # its language
    least: np.ndarray  # the cosine below which a text is too far from the cluster


def _counts(texts: pa.Array) -> np.ndarray:
    """log(1 + count) of each text's n-grams of bytes, ASCII other than letters taken as spaces."""
    folded = translated(pc.utf8_lower(texts), _TABLE)
    n = len(folded)
    if not n:
        return np.zeros((0, WIDTH), np.float32)
    ends = np.frombuffer(folded.buffers()[1], np.int64)[: n + 1]
    data = np.frombuffer(folded.buffers()[2], np.uint8)[: ends[-1]].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * WIDTH, np.diff(ends))
    out = np.bincount(row + data, minlength=n * WIDTH)
    if len(data) > 1:
        same = row[1:] == row[:-1]
        two = ((data[:-1] * np.uint32(0x9E3779B1) + data[1:] * np.uint32(0x85EBCA77)) >> np.uint32(12)) % np.uint32(TWO) + ONE
        out += np.bincount((row[1:] + two)[same], minlength=n * WIDTH)
    if len(data) > 2:
        same = row[2:] == row[:-2]
        three = ((data[:-2] * np.uint32(0xC2B2AE3D) + data[1:-1] * np.uint32(0x27D4EB2F) + data[2:] * np.uint32(0x165667B1)) >> np.uint32(10)) % np.uint32(THREE) + (ONE + TWO)
        out += np.bincount((row[2:] + three)[same], minlength=n * WIDTH)
    out = out.reshape(n, WIDTH).astype(np.float32)
    out[:, 32] = 0  # spaces alone
    return np.log1p(out)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-point seeds."""
    seeds = [x.mean(0)]
    while len(seeds) < min(k, len(x)):
        seeds.append(x[np.argmin((x @ _unit(np.array(seeds)).T).max(1))])
    c = _unit(np.array(seeds))
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = _unit(np.array([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(WIDTH, np.int64), 0
    for batch in slices(batches, "text", BYTES, ROWS):
        df += (_counts(batch.column("text")) > 0).sum(0)
        n += batch.num_rows
    yield pa.record_batch([pa.array(np.arange(WIDTH + 1)), pa.array(np.append(df, n))], ["feature", "held"])


def fit(labelled: DataFrame, per_language: int = 600, clusters: int = 4, seed: int = 7) -> Model:
    """A model from (doc_id, text, lang). Document frequencies are those of all its rows; the centroids are fitted on
    about ``per_language`` rows of each language, picked by a hash of doc_id, and twice as many in all, the first ones by
    that hash. Null or empty texts and null lang
    teach nothing.
    """
    rows = labelled.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where("doc_id is not null and lang is not null and text <> ''")
    df = rows.select("text").mapInArrow(_document_frequency, "feature long, held long").groupBy("feature").agg(F.sum("held").alias("held")).collect()
    held = np.ones(WIDTH + 1)
    for r in df:
        held[r.feature] += r.held
    idf = np.log(held[-1] / held[:-1]).astype(np.float32) + 0.1
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    luck = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, per_language / n)]) if sizes else None
    sample = rows.where(luck < share[F.col("lang")]).select("doc_id", "lang", "text").orderBy(luck, "doc_id", "text").limit(2 * per_language * len(sizes)).collect() if sizes else []
    texts: dict[str, list[str]] = {}
    for r in sorted(sample, key=lambda r: (r.doc_id, r.text)):
        texts.setdefault(r.lang, []).append(r.text)
    langs, centroids, owner, least = sorted(texts), [], [], []
    for i, lang in enumerate(langs):
        x = _unit(np.vstack([_counts(pa.array(texts[lang][at : at + 64])) for at in range(0, len(texts[lang]), 64)]) * idf)
        c = _clusters(x, clusters)
        near = x @ c.T
        for j in range(len(c)):
            own = near[near.argmax(1) == j, j]
            centroids.append(c[j])
            owner.append(i)
            least.append(0.25 * own.min() if len(own) else 0.0)
    return Model(langs, idf, np.array(centroids, np.float32).reshape(-1, WIDTH), np.array(owner, int), np.array(least))


def predict(documents: DataFrame, model: Model, *keep: str | Column) -> DataFrame:
    """(doc_id, ``keep``, lang_pred, score, rejected): the language of the nearest centroid by cosine, which is score.

    A null text, or one without a letter, is ``und`` with score 0, as is every text of a model that learnt nothing.
    rejected marks those, and texts farther from their centroid than a quarter of the cosine of its farthest
    learnt text. ``keep`` columns of the result's own names are left out. Rows come back one for one, those without doc_id and repeated ones too.
    """
    rows = documents.select("doc_id", *keep, F.col("text").cast("string").alias(WHOLE))
    names = [x for x in rows.columns if x not in (WHOLE, "lang_pred", "score", "rejected")]
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, WHOLE, BYTES, ROWS):
            n = batch.num_rows
            und = np.array([not m.langs or not t or not LETTER.search(t) for t in batch.column(WHOLE).to_pylist()], bool)
            lang, score, far = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
            if m.langs:
                near = _unit(_counts(batch.column(WHOLE)) * m.idf) @ m.centroids.T
                best = near.argmax(1)
                cosine = near[np.arange(n), best].astype(float)
                lang = np.where(und, "und", np.array(m.langs, object)[m.owner[best]])
                score = np.where(und, 0.0, np.clip(cosine, 0, 1))
                far = und | (cosine < m.least[best])
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.record_batch([*arrays, pa.array(lang, pa.string()), pa.array(score), pa.array(far)], [*names, "lang_pred", "score", "rejected"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")
