"""Toxicity by a small convolutional network over hashed word embeddings, trained by tasks in numpy on all labelled texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, give_back, hash_strings, letters_only, slices, translated

#: The text's column inside tasks, apart from what callers keep.
WHOLE = "whole text"
#: Embeddings at most: every word has one of these, so the model stays this small however many words there are.
BUCKETS = np.uint64(1 << 20)
#: Rows of a training shard; embeddings of a block of sums; cells of scores; units of what is summed as whole numbers.
SHARD, BLOCK, CELLS, SCALE = 2048, 1 << 14, 1 << 16, float(1 << 20)
#: Sets of 64 marks of labelled ids at most.
MARKS = 1 << 20
#: (rows, changes, shards) by embedding.
Sums = tuple[np.ndarray, np.ndarray, np.ndarray]
WIDTHS = (1, 2, 3)
#: Letters of a word's beginnings that have embeddings of their own, added to that of the whole word.
HEADS = (3, 4, 5)
_TABLE = letters_only()
#: Frequent function words that tell a text's language where no lang may be read.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as on be at by this are from or an have not they which",
    "fr": "le la les de des et un une du en dans que qui pour par sur avec est au aux ce ne pas plus sont",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden",
    "es": "el la de que y en los del se las por un para con no una su al lo como más es sobre este",
}
LANGS = (*FUNCTION_WORDS, "other")


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of letters and non-ASCII characters, A-Z lower-cased, with bounds."""
    lists = pc.ascii_split_whitespace(translated(texts, _TABLE))
    flat = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return flat.filter(full).dictionary_encode(), kept[ends]


def _hashed(words: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each distinct word, whole and by its first letters, and its language mark."""
    hashes = hash_strings(words.dictionary) if len(words.dictionary) else np.zeros(0, np.uint64)
    heads = [hash_strings(pc.utf8_slice_codeunits(words.dictionary, 0, k)) + np.uint64(k) for k in HEADS] if len(hashes) else [hashes] * len(HEADS)
    marks = {}
    for i, lang in enumerate(FUNCTION_WORDS):
        for w in FUNCTION_WORDS[lang].split():
            marks[w] = marks.get(w, 0) | 1 << i
    known = hash_strings(pa.array(list(marks)))
    order = np.argsort(known)
    at = np.minimum(np.searchsorted(known[order], hashes), len(known) - 1)
    mark = np.where(known[order][at] == hashes, np.array(list(marks.values()))[order][at], 0)
    return np.stack([hashes, *heads], axis=1) % BUCKETS, mark


def _language(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The language with most function words in each text, or other."""
    votes = np.zeros((len(bounds) - 1, len(FUNCTION_WORDS)), np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for i in range(len(FUNCTION_WORDS)):
        votes[:, i] = np.bincount(row[marks >> i & 1 == 1], minlength=len(bounds) - 1)
    return np.where(votes.max(1) > 0, votes.argmax(1), len(FUNCTION_WORDS))


def _product(rows: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """rows @ matrix, summed column by column: BLAS rounds a row by how many stand beside it, so scores would depend on batches."""
    total = rows[:, :1] * matrix[0]
    for i in range(1, len(matrix)):
        total += rows[:, i : i + 1] * matrix[i]
    return total


@dataclass
class Model:
    buckets: np.ndarray  # sorted; words of other buckets are unknown, row 0
    emb: np.ndarray
    filters: dict[int, np.ndarray]  # width: (width, dim, filters)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    cut: np.ndarray  # threshold of each language

    def ids(self, buckets: np.ndarray) -> np.ndarray:
        if not len(self.buckets):
            return np.zeros(buckets.shape, np.int64)
        at = np.minimum(np.searchsorted(self.buckets, buckets), len(self.buckets) - 1)
        return np.where(self.buckets[at] == buckets, at + 1, 0)

    def raw(self, ids: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probability before calibration. ids: of each distinct word; codes: the texts' words; bounds: of texts.

        Every text is followed by padding without any word; only windows from its words and from the first padding
        count, so none reaches into the next text.
        """
        n = len(bounds) - 1
        sizes = np.diff(bounds)
        pad = max(WIDTHS) + 1
        vectors = np.vstack([sum(self.emb[ids[:, j]] for j in range(ids.shape[1])), np.zeros((1, self.emb.shape[1]), np.float32)])
        starts = bounds[:-1] + pad * np.arange(n)
        row = np.full(len(codes) + pad * n, len(vectors) - 1, np.int64)
        row[np.repeat(starts - bounds[:-1], sizes) + np.arange(len(codes))] = codes
        z = np.full(n, self.out_bias)
        at = 0
        for w in WIDTHS:
            parts = [_product(vectors, self.filters[w][j]) for j in range(w)]
            k = parts[0].shape[1]
            size = len(row) - w + 1
            conv = parts[0][row[:size]]
            for j in range(1, w):
                conv += parts[j][row[j : j + size]]
            pooled = np.maximum.reduceat(conv, np.column_stack([starts, starts + sizes + 1]).ravel(), axis=0)[::2] if n else conv[:0]
            z += _product(np.maximum(pooled + self.bias[w], 0), self.out[at : at + k, None])[:, 0]
            at += k
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, raw: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Probabilities stretched so that each language's threshold stands at 1/2."""
        t = self.cut[lang]
        return np.where(raw < t, 0.5 * raw / t, 0.5 + 0.5 * (raw - t) / np.maximum(1 - t, 1e-9))


@dataclass
class Shard:
    """Labelled texts as words: what one task trains on at a time."""

    buckets: np.ndarray  # of each distinct word, whole and by its beginnings
    codes: np.ndarray  # the texts' words
    bounds: np.ndarray  # of texts
    toxic: np.ndarray
    held: np.ndarray  # texts that thresholds are chosen on, not trained on
    lang: np.ndarray

    @staticmethod
    def of(texts: pa.Array, toxic: np.ndarray, held: np.ndarray) -> Shard:
        parts = [words_of(texts.slice(i, 256)) for i in range(0, max(1, len(texts)), 256)]
        words = pa.chunked_array([w for w, _ in parts]).unify_dictionaries()
        bucket, mark = _hashed(words.chunk(0))
        codes = np.concatenate([w.indices.to_numpy(zero_copy_only=False) for w in words.chunks]).astype(np.int32)
        bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in parts]))])
        return Shard(bucket.astype(np.int32), codes, bounds.astype(np.int64), toxic.astype(np.int8), held.astype(bool), _language(mark[codes], bounds).astype(np.int8))

    def texts(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and bounds of some texts."""
        sizes = self.bounds[which + 1] - self.bounds[which]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return self.codes[np.repeat(self.bounds[which] - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and the number of texts trained on that hold a word of each."""
        known, place = np.unique(self.buckets, return_inverse=True)
        place, n = place.reshape(self.buckets.shape), np.zeros(len(known), np.int64)
        for i in np.flatnonzero(~self.held):
            n[np.unique(place[np.unique(self.codes[self.bounds[i] : self.bounds[i + 1]])])] += 1
        return known[n > 0], n[n > 0]

    def cells(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language, cell of the score, toxic texts, texts) over the texts that aren't trained on."""
        ids, at = m.ids(self.buckets), np.flatnonzero(self.held)
        cell = np.zeros(len(at), np.int64)
        for part in np.array_split(np.arange(len(at)), max(1, len(at) // 256)):
            cell[part] = np.floor(m.raw(ids, *self.texts(at[part])) * CELLS)
        key, place = np.unique(self.lang[at] * np.int64(CELLS + 1) + cell, return_inverse=True)
        return key // (CELLS + 1), key % (CELLS + 1), np.bincount(place, self.toxic[at], len(key)).astype(np.int64), np.bincount(place, minlength=len(key))

    def epoch(self, m: Model, rate: float, seed: tuple[int, ...]) -> list[tuple[int, Sums]]:
        """What one pass over the texts trained on, in batches by Adam from ``m`` on, changes: sums by block of embeddings
        (-1: everything else). Rows that no batch touched are left out."""
        own = np.flatnonzero(~self.held)
        if not len(own):
            return []
        rng = np.random.default_rng(seed)
        rng.shuffle(own)
        rows, local = np.unique(m.ids(self.buckets), return_inverse=True)
        local = local.reshape(self.buckets.shape)
        dim, each = m.emb.shape[1], len(m.bias[WIDTHS[0]])
        p = {"emb": m.emb[rows], "out": m.out.copy(), "out_bias": np.full(1, m.out_bias)}
        p |= {("filters", w): m.filters[w].copy() for w in WIDTHS} | {("bias", w): m.bias[w].copy() for w in WIDTHS}
        start, unknown = {k: v.copy() for k, v in p.items()}, np.flatnonzero(rows == 0)
        first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        touched, place = np.zeros(len(rows), bool), np.zeros(len(self.buckets), np.int64)
        pad = max(WIDTHS) + 1
        for step, at in enumerate(range(0, len(own), 64), 1):
            batch = own[at : at + 64]
            codes, bounds = self.texts(batch)
            n, sizes = len(batch), np.diff(bounds)
            used = np.zeros(len(self.buckets), bool)
            used[codes] = True
            used = np.flatnonzero(used)
            place[used] = np.arange(len(used))
            vectors = np.zeros((len(used) + 1, dim), np.float32)
            for j in range(local.shape[1]):
                vectors[:-1] += p["emb"].take(local[used, j], axis=0)
            starts = bounds[:-1] + pad * np.arange(n)
            row = np.full(len(codes) + pad * n, len(used), np.int64)
            row[np.repeat(starts - bounds[:-1], sizes) + np.arange(len(codes))] = place[codes]
            text = np.repeat(np.arange(n), sizes + 1)  # of each window: from a text's words and from the first padding
            heads = bounds[:-1] + np.arange(n)
            windows = np.repeat(starts - heads, sizes + 1) + np.arange(len(text))
            words = [row[windows + j] for j in range(max(WIDTHS))]
            pooled, tops = [], []
            for w in WIDTHS:
                conv = (vectors @ p["filters", w][0]).take(words[0], axis=0)
                for j in range(1, w):
                    conv += (vectors @ p["filters", w][j]).take(words[j], axis=0)
                top = np.maximum.reduceat(conv, heads, axis=0)
                hit = np.flatnonzero(conv == top.take(text, axis=0))[::-1]
                where = np.zeros((n, each), np.int64)
                where[text[hit // each], hit % each] = windows[hit // each]  # of equal windows the first
                pooled.append(top + p["bias", w])
                tops.append(where)
            pooled = np.concatenate(pooled, axis=1)
            keep = ((rng.random(pooled.shape) > 0.2) / 0.8).astype(np.float32)
            hidden = np.maximum(pooled, 0) * keep
            g = ((1 / (1 + np.exp(-np.clip(hidden @ p["out"] + p["out_bias"], -30, 30))) - self.toxic[batch]) / n).astype(np.float32)
            grads = {"out": hidden.T @ g, "out_bias": g.sum(keepdims=True)}
            dh = g[:, None] * p["out"] * keep * (pooled > 0)
            pull = np.zeros((len(used) + 1, dim), np.float32)
            for q, w in enumerate(WIDTHS):
                d = dh[:, q * each : (q + 1) * each]
                grads["bias", w] = d.sum(0)
                r, f = np.nonzero(d)
                span = row[tops[q][r, f][:, None] + np.arange(w)]
                x = np.zeros((each, w, dim), np.float32)
                np.add.at(x, f, d[r, f, None, None] * vectors[span])
                grads["filters", w] = x.transpose(1, 2, 0)
                np.add.at(pull, span, d[r, f, None, None] * p["filters", w][:, :, f].transpose(2, 0, 1))
            hit = np.flatnonzero(pull[:-1].any(1))
            at_rows, where = np.unique(local[used[hit]], return_inverse=True)
            if len(hit):  # only the rows that a window had its maximum at
                grad = 1e-4 * p["emb"][at_rows]
                where = where.reshape(len(hit), -1)
                for j in range(where.shape[1]):
                    np.add.at(grad, where[:, j], pull[hit])
                touched[at_rows] = True
                a, b = first["emb"], second["emb"]
                a[at_rows] += 0.1 * (grad - a[at_rows])
                b[at_rows] += 0.001 * (grad * grad - b[at_rows])
                p["emb"][at_rows] -= rate * (a[at_rows] / (1 - 0.9**step)) / (np.sqrt(b[at_rows] / (1 - 0.999**step)) + 1e-8)
                p["emb"][unknown] = 0
            for k, grad in grads.items():
                if k != "out_bias":
                    grad = grad + 1e-4 * p[k]
                first[k] += 0.1 * (grad - first[k])
                second[k] += 0.001 * (grad * grad - second[k])
                p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        whole = lambda x: np.rint(x.astype(float) * SCALE).astype(np.int32)
        rest = np.concatenate([(p[k] - start[k]).ravel() for k in _others()])
        touched &= rows > 0
        changed, at_rows = whole(p["emb"] - start["emb"])[touched], rows[touched]
        edges = np.searchsorted(at_rows, np.arange(0, len(m.emb) + BLOCK, BLOCK))
        blocks = [(i, (at_rows[a:b], changed[a:b], np.ones(b - a, np.int64))) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        return [*blocks, (-1, (np.zeros(1, np.int64), whole(rest)[None], np.ones(1, np.int64)))]


def _others() -> list:
    return ["out", "out_bias", *[("filters", w) for w in WIDTHS], *[("bias", w) for w in WIDTHS]]


def _merged(a: Sums, b: Sums) -> Sums:
    """Sums of two shards, row by row; of whole numbers, so that their order doesn't matter."""
    rows, place = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    out = (rows, np.zeros((len(rows), a[1].shape[1]), np.int64), np.zeros(len(rows), np.int64))
    for at, part in ((place[: len(a[0])], a), (place[len(a[0]) :], b)):
        out[1][at] += part[1]
        out[2][at] += part[2]
    return out


def _begun(seen: np.ndarray, texts: int, toxic: int, dim: int, each: int, seed: int) -> Model:
    """A model before training on ``texts`` texts of which some are ``toxic``; all or none of them: it says so of any text."""
    rng = np.random.default_rng(seed)
    m = Model(seen, rng.standard_normal((len(seen) + 1, dim), np.float32) * np.float32(0.15), {w: rng.normal(0, 0.4 / w, (w, dim, each)).astype(np.float32) for w in WIDTHS}, {w: np.full(each, 0.05, np.float32) for w in WIDTHS}, rng.normal(0, 0.4, len(WIDTHS) * each).astype(np.float32), 0.0, np.full(len(LANGS), 0.5))
    m.emb[0] = 0
    if not 0 < toxic < texts:
        m.out[:] = 0
        m.out_bias = -3.0 if not toxic else 3.0
    else:
        m.out_bias = float(np.log(toxic / (texts - toxic)))
    return m


def _moved(m: Model, parts: Iterable[tuple[int, Sums]]) -> None:
    """The model moves by the mean of what its shards changed; a word's row by that of the shards that changed it."""
    for block, (rows, total, n) in parts:
        mean = total / SCALE / n[:, None]
        if block >= 0:
            m.emb[rows] += mean.astype(np.float32)
            continue
        at = 0
        for k in _others():
            size = 1 if k == "out_bias" else m.out.size if k == "out" else getattr(m, k[0])[k[1]].size
            part, at = mean[0, at : at + size], at + size
            if k == "out_bias":
                m.out_bias += float(part[0])
            elif k == "out":
                m.out += part.astype(np.float32)
            else:
                held = getattr(m, k[0])[k[1]]
                held += part.reshape(held.shape).astype(np.float32)


def _cuts(m: Model, lang: np.ndarray, cell: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> None:
    """Thresholds from counts by language and cell; a language with fewer than 20 texts of a kind takes that of all."""
    m.cut[:] = _threshold(cell, toxic, n)
    for i in range(len(LANGS)):
        at = lang == i
        if toxic[at].sum() >= 20 and (n - toxic)[at].sum() >= 20:
            m.cut[i] = _threshold(cell[at], toxic[at], n[at])


def _rate(epoch: int, epochs: int) -> float:
    return 0.01 * (1 - epoch / epochs) + 0.001


def train(texts: list[str], labels: np.ndarray, dim: int = 12, each: int = 8, epochs: int = 10, least_docs: int = 3, seed: int = 5) -> Model:
    """Train on three quarters of the texts, as one shard, choose thresholds by language on the rest."""
    labels = np.asarray(labels)
    shard = Shard.of(pa.array(texts, pa.string()), labels, np.arange(len(labels)) % 4 == 3)
    known, n = shard.counts()
    m = _begun(known[n >= least_docs], int((~shard.held).sum()), int(shard.toxic[~shard.held].sum()), dim, each, seed)
    if m.out.any():
        for i in range(epochs):
            _moved(m, shard.epoch(m, _rate(i, epochs), (seed, i, 0)))
        _cuts(m, *shard.cells(m))
    return m


def _threshold(cell: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> float:
    """Of the thresholds, each midway between two cells of scores, whose F1 is within 0.01 of the best, the nearest to 1/2."""
    if not toxic.any():
        return 0.5
    cell, place = np.unique(-cell, return_inverse=True)
    cell, hit = -cell, np.cumsum(np.bincount(place, toxic))
    f1 = 2 * hit / (np.cumsum(np.bincount(place, n)) + hit[-1])
    cuts = (cell + np.append(cell[1:] + 1, 0)) / (2 * CELLS)
    good = cuts[f1 >= f1.max() - 0.01]
    spread = (good.min(), good.max())
    return float(np.clip(np.clip(0.5, *spread), 0.02, 0.98))


def _known(labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic in (0, 1)")
    return known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("hi")).where("toxic = hi").select("doc_id", "toxic")


def _marked(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Texts (doc_id, text) whose id falls on a mark of a ``known`` one: all of these and few others, so that the join with
    ``known`` moves hardly any text in vain. However many labels there are, they have 64 * MARKS marks at most."""
    placed = lambda rows: rows.withColumn("at", F.xxhash64("doc_id")).withColumn("slot", F.pmod("at", F.lit(MARKS))).withColumn("mark", F.expr("shiftleft(1L, cast(pmod(shiftright(at, 32), 64) as int))"))
    marks = placed(known).groupBy("slot").agg(F.bit_or("mark").alias("marks"))
    return placed(texts).join(F.broadcast(marks), "slot").where(F.col("marks").bitwiseAND(F.col("mark")) != 0).select("doc_id", "text")


def fit(documents: DataFrame, labels: DataFrame, most: int | None = None, seed: int = 11) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic 0/1), fitted on every labelled row. Labels that are
    null, or disagree on a doc_id, teach nothing.

    Texts are dealt by hash to shards of about ``SHARD`` rows. Each epoch every shard trains on from the same model in a
    task, which adds up what its shards changed, and the model moves by the mean of that: what an epoch shuffles grows
    with the cores, not with the shards. The words that have embeddings and the thresholds come from counts over all
    rows. Only the model, of at most BUCKETS embeddings, and counts by cells of scores reach the driver.

    With ``most``, callers who want a small model quickly have one of about that many rows of each class at most (the other
    class has twice as many), picked by a hash of doc_id, and 4 * ``most`` rows in all, however many rows share a doc_id.
    """
    known = _known(labels)
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return train([], np.zeros(0))
    if most is not None:
        return _fit_some(documents, known, sizes, most, seed)
    count = max(1, -(-sum(sizes.values()) // SHARD))
    texts = _marked(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), known).join(known, "doc_id")
    luck = F.xxhash64("doc_id", "text", F.lit(seed))
    dealt = texts.select("doc_id", "text", "toxic", F.pmod(luck, F.lit(count)).alias("shard"), (F.pmod(F.shiftright(luck, 40), F.lit(4)) == 3).alias("held"))
    shards = cut(dealt.groupBy("shard").applyInArrow(_packed, f"shard long, texts long, toxics long, {', '.join(f'{f} binary' for f in _ARRAYS)}"))
    n = shards.agg(F.sum("texts").alias("texts"), F.sum("toxics").alias("toxics")).first()
    words = shards.mapInArrow(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where("n >= 3").toArrow()
    m = _begun(np.sort(words.column("bucket").to_numpy()), n.texts or 0, n.toxics or 0, 12, 8, 5)
    if m.out.any():
        sc, epochs = documents.sparkSession.sparkContext, 10
        rows = shards.select("shard", *_ARRAYS).coalesce(sc.defaultParallelism).rdd  # a core's shards leave one sum
        for i in range(epochs):
            shared, rate = sc.broadcast(m), _rate(i, epochs)
            moved = rows.mapPartitions(lambda rs, shared=shared, rate=rate, i=i: _pass(rs, shared.value, rate, (5, i))).reduceByKey(_merged).collect()
            _moved(m, moved)
            shared.destroy()
        shared = sc.broadcast(m)

        counts = rows.mapPartitions(lambda rs: _scored(rs, shared.value)).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1])).collect()
        _cuts(m, *np.array([(*k, *v) for k, v in counts], np.int64).reshape(-1, 4).T)
        shared.destroy()
    drop(shards)
    return m


#: The arrays of a shard as they are stored.
_ARRAYS = {"buckets": np.int32, "codes": np.int32, "bounds": np.int64, "toxic": np.int8, "held": np.bool_, "lang": np.int8}


def _packed(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    s = Shard.of(rows.column("text").combine_chunks(), rows.column("toxic").to_numpy(), rows.column("held").to_numpy())
    give_back()
    own = ~s.held
    numbers = [[rows.column("shard")[0].as_py()], [int(own.sum())], [int(s.toxic[own].sum())]]
    return pa.table([*[pa.array(x, pa.int64()) for x in numbers], *[pa.array([getattr(s, f).tobytes()], pa.binary()) for f in _ARRAYS]], ["shard", "texts", "toxics", *_ARRAYS])


def _shard(row: Mapping[str, bytes]) -> Shard:
    arrays = {f: np.frombuffer(row[f], kind) for f, kind in _ARRAYS.items()}
    return Shard(**arrays | {"buckets": arrays["buckets"].reshape(-1, 1 + len(HEADS))})


def _pass(rows: Iterable[Mapping[str, bytes]], m: Model, rate: float, seed: tuple[int, ...]) -> Iterator[tuple[int, Sums]]:
    for row in rows:
        yield from _shard(row).epoch(m, rate, (*seed, row["shard"]))
        give_back()


def _scored(rows: Iterable[Mapping[str, bytes]], m: Model) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
    for row in rows:
        lang, cell, toxic, n = (x.tolist() for x in _shard(row).cells(m))
        yield from zip(zip(lang, cell, strict=True), zip(toxic, n, strict=True), strict=True)
        give_back()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            bucket, n = _shard({c: batch.column(c)[r].as_py() for c in _ARRAYS}).counts()
            yield pa.record_batch([pa.array(bucket, pa.int32()), pa.array(n, pa.int64())], ["bucket", "n"])
    give_back()


def _fit_some(documents: DataFrame, known: DataFrame, sizes: dict[int, int], most: int, seed: int) -> Model:
    luck = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    share = min(1.0, most / max(1, sizes[1]))
    other = min(1.0, 2 * most / max(1, sizes[0]))
    picked = known.where(luck < F.when(F.col("toxic") == 1, share).otherwise(other)).select("doc_id", "toxic").orderBy(luck, "doc_id").limit(4 * most)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id").orderBy(luck, "doc_id", "text").limit(4 * most).collect()
    rows.sort(key=lambda r: (r.doc_id * 2654435761 % 4294967296, r.doc_id, r.text or ""))
    texts, toxic = [r.text or "" for r in rows], np.array([r.toxic for r in rows])
    del rows
    return train(texts, toxic)


def score(documents: DataFrame, model: Model, *keep: str | Column) -> DataFrame:
    """(doc_id, ``keep``, score, predicted): toxicity of each text, 0 to 1; predicted is 1 from 1/2 on.

    Null and empty texts are scored as a text without words. ``keep`` columns of the result's own names are left out. Rows come back one for one, those without doc_id and
    repeated ones too.
    """
    rows = documents.select("doc_id", *keep, F.col("text").cast("string").alias(WHOLE))
    names = [x for x in rows.columns if x not in (WHOLE, "score", "predicted")]
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, WHOLE, 2 << 20):
            words, bounds = words_of(batch.column(WHOLE))
            bucket, mark = _hashed(words)
            codes = words.indices.to_numpy(zero_copy_only=False)
            s = m.score(m.raw(m.ids(bucket), codes, bounds).astype(float), _language(mark[codes], bounds))
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.record_batch([*arrays, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, score double, predicted int")
