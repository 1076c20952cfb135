"""Gaussian hidden Markov models against plain numpy over whole sequences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import markov as H


def draw(seed=4, lengths=(300, 1, 47, 2, 120), d=2):
    r = np.random.default_rng(seed)
    means, stay = np.array([[0, 0], [3, -2], [-3, 4]], float)[:, :d], 0.85
    rows = []
    for seq, n in enumerate(lengths):
        s = r.integers(3)
        for i in range(n):
            s = s if r.random() < stay else r.integers(3)
            rows.append((seq, i * 3, (means[s] + r.normal(size=d)).tolist()))
    return rows


def begin(d=2, k=3):
    r = np.random.default_rng(9)
    return H.GaussianModel(np.full(k, 1 / k), np.full((k, k), 1 / k), r.normal(size=(k, d)) * 2, np.repeat(np.eye(d)[None] * 4, k, axis=0))


def densities(m, x):
    out = np.zeros((len(x), len(m.means)))
    for j in range(len(m.means)):
        z = x - m.means[j]
        out[:, j] = np.exp(-0.5 * (z @ np.linalg.inv(m.covariances[j]) * z).sum(1)) / np.sqrt((2 * np.pi) ** x.shape[1] * np.linalg.det(m.covariances[j]))
    return out


def plain_round(m, sequences, full):
    """One round over whole sequences, by the textbook and in 128-bit floats where the machine has them."""
    k, d = m.means.shape
    start, trans, weight, first, second, loglik = np.zeros(k), np.zeros((k, k)), np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d)), 0.0
    for x in sequences:
        b = densities(m, x).astype(np.longdouble)
        n = len(x)
        a, z, c = np.zeros((n, k), np.longdouble), np.zeros((n, k), np.longdouble), np.zeros(n, np.longdouble)
        for t in range(n):
            a[t] = (m.start if t == 0 else a[t - 1] @ m.transition) * b[t]
            c[t] = a[t].sum()
            a[t] /= c[t]
        z[-1] = 1
        for t in range(n - 2, -1, -1):
            z[t] = m.transition @ (b[t + 1] * z[t + 1]) / c[t + 1]
        g = (a * z).astype(float)
        start += g[0]
        for t in range(n - 1):
            trans += (a[t][:, None] * m.transition * (b[t + 1] * z[t + 1])[None] / c[t + 1]).astype(float)
        weight += g.sum(0)
        first += g.T @ x
        second += sum(g[t][:, None, None] * np.outer(x[t], x[t]) for t in range(n))
        loglik += float(np.log(c).sum())
    means = first / weight[:, None]
    cov = np.stack([second[j] - np.outer(first[j], means[j]) - np.outer(means[j], first[j]) + weight[j] * np.outer(means[j], means[j]) for j in range(k)])
    cov = (cov + 0.01 * np.eye(d)) / weight[:, None, None] if full else np.stack([np.diag(np.diag(c) + 0.01) / w for c, w in zip(cov, weight)])
    return H.GaussianModel(start / start.sum(), trans / trans.sum(1, keepdims=True), means, cov), loglik


def plain_path(m, x):
    b, a = np.log(densities(m, x)), np.log(np.maximum(m.transition, 1e-300))
    score, back = np.log(np.maximum(m.start, 1e-300)) + b[0], []
    for t in range(1, len(x)):
        every = score[:, None] + a
        back.append(every.argmax(0))
        score = every.max(0) + b[t]
    path = [int(score.argmax())]
    for y in back[::-1]:
        path.append(int(y[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize(("size", "full"), [(4096, False), (16, True), (1, False)])
def test_a_fit_equals_plain_numpy(spark, size, full):
    rows = draw()
    sequences = [np.array([v for s, _, v in rows if s == seq]) for seq in range(5)]
    df = spark.createDataFrame(rows, "seq long, idx long, vector array<double>").repartition(7)
    blocks = H.sequence_blocks(df, size)
    if size == 16:
        assert blocks.where("size(x) > 16").isEmpty() and blocks.where("seq = 0").count() == 19  # no sequence is in one row
    told = []
    found, _ = H.fit_gaussian(blocks, begin(), 3, -np.inf, full, lambda i, x: told.append(x))
    plain, likelihoods = begin(), []
    for _ in range(3):
        plain, loglik = plain_round(plain, sequences, full)
        likelihoods.append(loglik)
    for part in ("start", "transition", "means", "covariances"):
        assert np.allclose(getattr(found, part), getattr(plain, part), atol=1e-6, rtol=0), part
    assert np.allclose(told, likelihoods, atol=1e-6)
    assert told == sorted(told)
    got = {}
    for r in sorted(H.decode_gaussian(blocks, found).collect()):
        got.setdefault(r.seq, []).append(r.state)
    assert got == {seq: plain_path(found, x) for seq, x in enumerate(sequences)}


def test_planted_states_are_found(spark):
    r = np.random.default_rng(2)
    states = np.repeat(r.integers(0, 2, 60), 10)
    rows = [(i // 300, i, [float(10 * s + r.normal())]) for i, s in enumerate(states)]
    paths, model = H.gaussian_paths(spark.createDataFrame(rows, "seq long, idx long, vector array<double>"), 2)
    found = np.array([x.state for x in sorted(paths.collect(), key=lambda x: x.idx)])
    assert (found == states).all() or (found == 1 - states).all()
    assert sorted(np.round(model.means.ravel() / 10).tolist()) == [0, 1]


def test_vectors_that_are_no_numbers_and_empty_tables(spark):
    rows = [(1, 1, [0.0, 1.0]), (1, 2, None), (1, 3, [None, 1.0]), (1, 4, [float("nan"), 1.0]), (1, 5, [float("inf"), 0.0]), (1, 6, [0.0, 1.0]), (1, 6, [0.0, 1.0])]
    paths, _ = H.gaussian_paths(spark.createDataFrame(rows, "seq long, idx long, vector array<double>").withColumn("rank", F.lit("own")), 2)
    assert sorted(r.idx for r in paths.collect()) == [1, 6, 6]
    with pytest.raises(ValueError, match="no vectors"):
        H.gaussian_paths(spark.createDataFrame([], "seq long, idx long, vector array<double>"), 2)
