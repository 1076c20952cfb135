"""Hidden Markov models over sequences of vectors, fitted by sums that Spark adds up; long sequences run as blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut, drop

#: Steps of a block: what one row holds of a sequence.
BLOCK = 4096
TINY = 1e-300


@dataclass(frozen=True)
class GaussianModel:
    """start (k), transition (k, k), means (k, d) and covariances (k, d, d)."""

    start: np.ndarray
    transition: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """(n, k) logarithms of the states' densities."""
        d = x.shape[1]
        out = np.empty((len(x), len(self.means)))
        for j, (mean, cov) in enumerate(zip(self.means, self.covariances, strict=True)):
            lower = np.linalg.cholesky(cov)
            z = np.linalg.solve(lower, (x - mean).T)
            out[:, j] = -0.5 * (d * np.log(2 * np.pi) + (z * z).sum(0)) - np.log(np.diag(lower)).sum()
        return out

    def sums(self, x: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        """Each state's weight, vectors and products of vectors."""
        return np.concatenate([gamma.sum(0), (gamma.T @ x).ravel(), np.einsum("nk,ni,nj->kij", gamma, x, x, optimize=True).ravel()])

    def n_sums(self) -> int:
        k, d = self.means.shape
        return k + k * d + k * d * d


@dataclass(frozen=True)
class CategoricalModel:
    """start (k), transition (k, k) and emission (k, symbols); vectors are symbols alone, numbered from 0."""

    start: np.ndarray
    transition: np.ndarray
    emission: np.ndarray

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(self.emission, TINY)).T[x[:, 0].astype(np.int64)]

    def sums(self, x: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        """Each state's weight of each symbol."""
        n = self.emission.shape[1]
        return np.stack([np.bincount(x[:, 0].astype(np.int64), g, n) for g in gamma.T]).ravel()

    def n_sums(self) -> int:
        return self.emission.size


def _normal(rows: np.ndarray) -> np.ndarray:
    rows = np.where(np.isfinite(rows), rows, 0.0)
    total = rows.sum(-1, keepdims=True)
    return np.where(total > 0, rows / np.maximum(total, TINY), 1 / rows.shape[-1])


def sequence_blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """(seq, block, last_block, idx, x) of vectors (seq, idx, vector): sequences as blocks of ``size`` steps at most.

    Steps are put in order of idx (a repeated idx: of the vector too) and numbered in ranges, so a sequence of any length
    is dealt over many tasks. Null vectors, and those with null or non-finite components, are left out.
    """
    from .rank import rank_in_ranges

    fine = F.col("vector").isNotNull() & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select("seq", "idx", F.col("vector").cast("array<double>").alias("vector")).where(fine)
    placed = rank_in_ranges(rows, ["seq"], "idx", "vector").withColumn("block", F.floor((F.col("rank") - 1) / size))
    listed = F.array_sort(F.collect_list(F.struct("rank", "idx", "vector")))
    held = placed.groupBy("seq", "block").agg(listed.alias("r"))
    last = held.groupBy("seq").agg(F.max("block").alias("last_block"))
    return cut(held.join(last, "seq").select("seq", "block", "last_block", F.transform("r", lambda r: r.idx).alias("idx"), F.transform("r", lambda r: r.vector).alias("x")))


def _alike(lengths: np.ndarray, steps: int = 1 << 17) -> Iterator[np.ndarray]:
    """Places of sequences in groups that are walked side by side, longest first, none less than half as long as its
    group's first, of about ``steps`` steps at most."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        top = lengths[order[at]]
        end = at + max(1, steps // top)
        end = min(end, at + int(np.searchsorted(-lengths[order[at:]], -(top // 2), side="right")))
        yield order[at : max(end, at + 1)]
        at = max(end, at + 1)


def _walks(xs: pd.Series, model: GaussianModel) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of a batch's blocks: (places, lengths, open, log densities by step and block), of which at step t the first
    open[t] blocks have one."""
    lengths = np.array([len(x) for x in xs], np.int64)
    for places in _alike(lengths):
        own = lengths[places]
        log_b = np.zeros((own[0], len(places), len(model.start)))
        log_b[np.concatenate([np.arange(n) for n in own]), np.repeat(np.arange(len(own)), own)] = model.log_densities(np.concatenate([np.stack(xs.iloc[i]) for i in places]))
        yield places, own, (own[None, :] > np.arange(own[0])[:, None]).sum(1), log_b


def _products(frames: Iterator[pd.DataFrame], model: GaussianModel, best: bool) -> Iterator[pd.DataFrame]:
    """For each block the matrix (from state before it, to state at its end) of all paths' weight, or of the best path's
    logarithm, scaled to a largest entry of 1 or 0; a sequence's first block counts from the start."""
    log_a, log_start = np.log(np.maximum(model.transition, TINY)), np.log(np.maximum(model.start, TINY))
    for pdf in frames:
        out = [None] * len(pdf)
        for places, _, open_, log_b in _walks(pdf.x, model):
            first = (pdf.block.to_numpy()[places] == 0)[:, None, None]
            if best:
                m = np.where(first, log_start, log_a) + log_b[0][:, None]
                for t in range(1, len(log_b)):
                    n = open_[t]
                    m[:n] = (m[:n, :, :, None] + log_a).max(2) + log_b[t, :n, None]
                m -= m.max((1, 2), keepdims=True)
            else:
                b = np.exp(log_b - log_b.max(2, keepdims=True))
                m = np.where(first, model.start, model.transition) * b[0][:, None]
                for t in range(1, len(b)):
                    n = open_[t]
                    m[:n] = m[:n] @ model.transition * b[t, :n, None]
                    m[:n] /= np.maximum(m[:n].max((1, 2), keepdims=True), TINY)
            for i, x in zip(places, m, strict=True):
                out[i] = x.ravel().tolist()
        yield pd.DataFrame({"seq": pdf.seq, "block": pdf.block, "m": out})


def _borders(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of one sequence's blocks: the weights of the states before each, and of what follows each."""
    m = [np.reshape(x, (k, k)) for x in pdf.sort_values("block").m]
    before, after = [np.full(k, 1 / k)], [np.ones(k)]
    for x in m[:-1]:
        a = before[-1] @ x
        before.append(a / max(a.sum(), TINY))
    for x in m[:0:-1]:
        b = x @ after[-1]
        after.append(b / max(b.max(), TINY))
    return pd.DataFrame({"seq": pdf.seq.iloc[0], "block": np.sort(pdf.block.to_numpy()), "before": [x.tolist() for x in before], "after": [x.tolist() for x in after[::-1]]})


def _best_borders(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of one sequence's blocks: the states of the best path before each (-1: none) and at its end."""
    m = [np.reshape(x, (k, k)) for x in pdf.sort_values("block").m]
    score, back = m[0][0], []
    for x in m[1:]:
        every = score[:, None] + x
        back.append(every.argmax(0))
        score = every.max(0)
        score = score - score.max()
    ends = [int(score.argmax())]
    for x in back[::-1]:
        ends.append(int(x[ends[-1]]))
    ends = ends[::-1]
    return pd.DataFrame({"seq": pdf.seq.iloc[0], "block": np.sort(pdf.block.to_numpy()), "before": [-1, *ends[:-1]], "last": ends})


def _expected(frames: Iterator[pd.DataFrame], model: GaussianModel) -> Iterator[pd.DataFrame]:
    """A task's sums, in one column: log likelihood, starts, transitions, and what the model sums up of its steps. Blocks
    of about one length are walked side by side."""
    k = len(model.start)
    loglik, start, trans, own = 0.0, np.zeros(k), np.zeros((k, k)), 0.0
    for pdf in frames:
        for places, lengths, open_, log_b in _walks(pdf.x, model):
            top = log_b.max(2)
            b = np.exp(log_b - top[:, :, None])
            first = pdf.block.to_numpy()[places] == 0
            before, after = (np.stack(pdf[c].iloc[places].to_list()) for c in ("before", "after"))
            steps = len(b)
            alpha, beta, scale = np.zeros_like(b), np.zeros_like(b), np.ones(b.shape[:2])
            into = np.where(first[:, None], model.start, before @ model.transition)
            for t in range(steps):
                n = open_[t]
                a = (into if t == 0 else alpha[t - 1, :n] @ model.transition) * b[t, :n]
                scale[t, :n] = np.maximum(a.sum(1), TINY)
                alpha[t, :n] = a / scale[t, :n, None]
            for t in range(steps - 1, -1, -1):
                n, further = open_[t], open_[t + 1] if t + 1 < steps else 0
                beta[t, further:n] = after[further:n]
                if further:
                    z = (b[t + 1, :further] * beta[t + 1, :further]) @ model.transition.T
                    beta[t, :further] = z / np.maximum(z.max(1, keepdims=True), TINY)
            real = np.arange(steps)[:, None] < lengths
            lead = np.concatenate([before[None], alpha[:-1]])
            follows = real.copy()
            follows[0] = ~first
            lead, follow = lead[follows], (b * beta)[follows]
            weigh = 1 / np.maximum(((lead @ model.transition) * follow).sum(1), TINY)
            trans += model.transition * ((lead * weigh[:, None]).T @ follow)
            gamma = _normal(alpha * beta)
            loglik += float((np.log(scale) + top)[real].sum())
            start += gamma[0][first].sum(0)
            # in the order that the blocks' steps stand in
            by_block = gamma.transpose(1, 0, 2)[real.T]
            own = own + model.sums(np.concatenate([np.stack(pdf.x.iloc[i]) for i in places]), by_block)
    flat = np.concatenate([[loglik], start, trans.ravel(), own if isinstance(own, np.ndarray) else np.zeros(model.n_sums())])
    yield pd.DataFrame({"k": np.arange(len(flat)), "w": flat})


def _with_borders(blocks: DataFrame, model: GaussianModel) -> DataFrame:
    """Blocks with the weights before and after them. Only sequences of several blocks need them worked out, from one small
    matrix a block; those of one block get the trivial ones."""
    k = len(model.start)
    trivial = F.array(*[F.lit(1.0)] * k)
    one = blocks.where("last_block = 0").select("seq", "block", "idx", "x", trivial.alias("before"), trivial.alias("after"))
    many = blocks.where("last_block > 0")
    kind = dict(blocks.dtypes)["seq"]
    matrices = many.mapInPandas(lambda it: _products(it, model, False), f"seq {kind}, block long, m array<double>")
    borders = matrices.groupBy("seq").applyInPandas(lambda pdf: _borders(pdf, k), f"seq {kind}, block long, before array<double>, after array<double>")
    return one.unionByName(many.select("seq", "block", "idx", "x").join(borders, ["seq", "block"]))


def first_model(vectors: DataFrame, states: int, seed: int = 13) -> GaussianModel:
    """Means by k-means, the covariance of all vectors (and a thousandth) for every state, all starts and transitions alike."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    fine = F.col("vector").isNotNull() & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(fine).select(F.col("vector").cast("array<double>").alias("x"))
    means = np.array(KMeans(k=states, seed=seed, maxIter=20, featuresCol="features").fit(rows.select(array_to_vector("x").alias("features"))).clusterCenters())
    means = np.concatenate([means, np.repeat(means[-1:], states - len(means), axis=0)])  # fewer different vectors than states
    d = means.shape[1]
    pair = [F.expr(f"covar_pop(x[{i}], x[{j}])").alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    found, cov = rows.agg(*pair).first(), np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = found[f"c{i}_{j}"]
    return GaussianModel(np.full(states, 1 / states), np.full((states, states), 1 / states), means, np.repeat((cov * np.eye(d) + 1e-3 * np.eye(d))[None], states, axis=0))


def summed(blocks: DataFrame, model: GaussianModel | CategoricalModel) -> np.ndarray:
    """All tasks' sums of ``_expected``, which Spark adds up; what reaches the driver has the model's size."""
    k = len(model.start)
    flat = np.zeros(1 + k + k * k + model.n_sums())
    for r in _with_borders(blocks, model).mapInPandas(lambda it: _expected(it, model), "k int, w double").groupBy("k").agg(F.sum("w").alias("w")).collect():
        flat[r.k] = r.w
    return flat


def fit_gaussian(blocks: DataFrame, model: GaussianModel, rounds: int = 10, tolerance: float = 1e-2, full: bool = False, on_round: Callable[[int, float], None] | None = None) -> tuple[GaussianModel, float]:
    """(model, log likelihood before the last round) of ``sequence_blocks``, by at most ``rounds`` rounds of expectation and
    maximisation from ``model``; it ends when a round gains less than ``tolerance``.

    In each round tasks walk their blocks forward and backward and add up starts, transitions and, for each state, its
    weight, its vectors and their products; Spark adds the tasks' sums, and what reaches the driver has the model's size.
    Variances are drawn to 0.01 by a weak prior, and with ``full`` covariances are kept whole, else their diagonal. A state
    that no step is in keeps its mean and gets the prior's variance. Rows of transitions without weight are uniform.
    """
    k, d = model.means.shape
    prior, before = 1e-2, -np.inf
    for i in range(rounds):
        flat = summed(blocks, model)
        loglik, start, trans, weight, first, second = np.split(flat, np.cumsum([1, k, k * k, k, k * d]))
        weight, first, second = np.maximum(weight, TINY), first.reshape(k, d), second.reshape(k, d, d)
        means = np.where(weight[:, None] > 1e-12, first / weight[:, None], model.means)
        spread = second - np.einsum("ki,kj->kij", first, means) - np.einsum("ki,kj->kij", means, first) + weight[:, None, None] * np.einsum("ki,kj->kij", means, means)
        eye = np.eye(d)
        if full:
            covariances = (prior * eye + spread) / np.maximum(weight, 1e-5)[:, None, None]
        else:
            covariances = (prior + np.einsum("kii->ki", spread))[:, :, None] * eye / np.maximum(weight, 1e-5)[:, None, None]
        model = GaussianModel(_normal(start), _normal(trans.reshape(k, k)), means, covariances)
        if on_round:
            on_round(i, float(loglik[0]))
        if loglik[0] - before < tolerance:
            before = loglik[0]
            break
        before = loglik[0]
    return model, float(before)


def _decoded(frames: Iterator[pd.DataFrame], model: GaussianModel) -> Iterator[pd.DataFrame]:
    log_a, log_start = np.log(np.maximum(model.transition, TINY)), np.log(np.maximum(model.start, TINY))
    for pdf in frames:
        before, last = pdf.before.to_numpy(), pdf["last"].to_numpy()
        paths = [None] * len(pdf)
        for places, lengths, open_, log_b in _walks(pdf.x, model):
            steps, into = len(log_b), before[places]
            score = np.where((into < 0)[:, None], log_start, log_a[into]) + log_b[0]
            back = np.zeros(log_b.shape, np.int16)
            for t in range(1, steps):
                n = open_[t]
                every = score[:n, :, None] + log_a
                back[t, :n] = every.argmax(1)
                score[:n] = every.max(1) + log_b[t, :n]
            at = np.where(last[places] < 0, score.argmax(1), last[places])
            path = np.zeros((len(places), steps), np.int32)
            for t in range(steps - 1, -1, -1):
                n = open_[t]
                path[:n, t] = at[:n]
                at[:n] = back[t, np.arange(n), at[:n]] if t else at[:n]
            for i, p, n in zip(places, path, lengths, strict=True):
                paths[i] = p[:n]
        if not len(pdf):
            continue
        sizes = [len(p) for p in paths]
        yield pd.DataFrame({"seq": np.repeat(pdf.seq.to_numpy(), sizes), "idx": np.concatenate([np.asarray(x) for x in pdf.idx]), "state": np.concatenate(paths)})


def decode_gaussian(blocks: DataFrame, model: GaussianModel | CategoricalModel) -> DataFrame:
    """(seq, idx, state): the likeliest states of every step of ``sequence_blocks``. A long sequence's states at the blocks'
    borders come from one matrix of best paths a block; then each block is walked by itself. Ties go to smaller states."""
    k = len(model.start)
    kinds = dict(blocks.dtypes)
    none = F.lit(-1)
    one = blocks.where("last_block = 0").select("seq", "block", "idx", "x", none.alias("before"), none.alias("last"))
    many = blocks.where("last_block > 0")
    matrices = many.mapInPandas(lambda it: _products(it, model, True), f"seq {kinds['seq']}, block long, m array<double>")
    borders = matrices.groupBy("seq").applyInPandas(lambda pdf: _best_borders(pdf, k), f"seq {kinds['seq']}, block long, before int, last int")
    both = one.unionByName(many.select("seq", "block", "idx", "x").join(borders, ["seq", "block"]))
    return both.mapInPandas(lambda it: _decoded(it, model), f"seq {kinds['seq']}, idx {kinds['idx'].removeprefix('array<').removesuffix('>')}, state int")


def gaussian_paths(vectors: DataFrame, states: int, rounds: int = 10, full: bool = False, seed: int = 13) -> tuple[DataFrame, GaussianModel]:
    """(paths, model) of vectors (seq, idx, vector): see ``first_model``, ``fit_gaussian`` and ``decode_gaussian``. Without
    any vectors the model can't be fitted, which is an error."""
    vectors = cut(vectors.select("seq", "idx", "vector"))  # the first model reads them several times
    blocks = sequence_blocks(vectors)
    if blocks.isEmpty():
        drop(blocks, vectors)
        raise ValueError("there are no vectors to fit a model to")
    begin = first_model(vectors, states, seed)
    drop(vectors)
    model, _ = fit_gaussian(blocks, begin, rounds, full=full)
    return decode_gaussian(blocks, model), model


def column_vector(*columns: Column) -> Column:
    """Numbers of a row as a vector."""
    return F.array(*[c.cast("double") for c in columns])
