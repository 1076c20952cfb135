"""What must not grow faster than the input: shuffles and repeated work, as plans tell them."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from docloom.functions import markup as K
from docloom.operators import analyse as A
from docloom.operators import extract as E
from docloom.operators import graph as G
from docloom.operators import index as X
from docloom.operators import markov as M


def plan(df, optimized=False):
    run = df._jdf.queryExecution()
    return (run.optimizedPlan() if optimized else run.executedPlan()).toString()


def test_pairs_of_windows_are_counted_where_their_texts_were_dealt(spark):
    items = spark.createDataFrame([(1, "b a b c"), (1, "a b"), (2, "x x x"), (3, "a"), (4, None)], "item_id long, text string")
    found = G.cooccurrences(items, 3)
    assert plan(found).count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, found.collect())) == [(1, "a", "b", 3), (1, "a", "c", 1), (1, "b", "c", 2)]


def test_a_page_is_read_once_for_its_text_and_its_count(spark):
    words = F.array(*[F.struct(F.lit(w).alias("text"), F.lit(c).alias("confidence")) for w, c in (("sure", 0.9), ("not", 0.1), ("too", 0.7))])
    regions = F.array(F.struct(F.lit(1).alias("order"), F.array(*[F.lit(0.0)] * 4).alias("bbox"), words.alias("words")))
    found = spark.range(1).select(E.layout_text(regions, 0.5).alias("x")).select("x.*")
    assert plan(found, True).count("array_sort(") == 1
    assert [tuple(r) for r in found.collect()] == [("sure too", 0.8, 1, 1)]


def counts(obs, start, trans, emit):
    """One sequence's expected starts, transitions and emissions, step by step."""
    n, k = len(obs), len(start)
    a, z, c = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    for t in range(n):
        a[t] = (start if t == 0 else a[t - 1] @ trans) * emit[:, obs[t]]
        c[t] = a[t].sum()
        a[t] /= c[t]
    for t in range(n - 2, -1, -1):
        z[t] = trans @ (emit[:, obs[t + 1]] * z[t + 1]) / c[t + 1]
    g, step = a * z, sum((a[t][:, None] * trans * (emit[:, obs[t + 1]] * z[t + 1]) / c[t + 1] for t in range(n - 1)), np.zeros((k, k)))
    return g[0], step, np.stack([g[obs == s].sum(0) for s in range(emit.shape[1])], axis=1)


def test_sequences_of_symbols_are_walked_side_by_side(spark):
    r = np.random.default_rng(3)
    found = {seq: r.integers(0, 4, n) for seq, n in enumerate((1, 5, 5, 6, 40, 2))}
    rows = [(seq, i, int(x)) for seq, obs in found.items() for i, x in enumerate(obs)]
    fitted = A.fit_hmm(spark.createDataFrame(rows, "seq long, idx long, symbol int").repartition(3), 2, 4, 3)
    r = np.random.default_rng(1)
    plain = [m / m.sum(-1, keepdims=True) for m in (r.random(2) + 0.5, r.random((2, 2)) + 0.5, r.random((2, 4)) + 0.5)]
    for _ in range(3):
        parts = [sum(x) for x in zip(*(counts(obs, *plain) for obs in found.values()), strict=True)]
        plain = [x / x.sum(-1, keepdims=True) for x in parts]
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(fitted, plain, strict=True))
    groups = list(M._walks(pd.Series([np.zeros((3, 1))] * 500 + [np.zeros((90, 1))]), M.CategoricalModel(*plain)))
    assert sorted(len(g[0]) for g in groups) == [1, 500]  # no loop over each one's steps


def test_a_text_is_made_ready_once_for_all_its_chunks(spark):
    items = spark.range(3).select(F.col("id").alias("seq"), F.lit("ab\n" * 40).alias("text"))
    mark = lambda c: F.concat(F.lit('<span kind="x">'), c, F.lit("</span>"))
    found = A.span_segments(items, mark, 20, 5, "kind", prepend_label=True)
    told = plan(found, True)
    assert told.count("Speaker 0:") <= 4, told  # of first_speaker, which a lambda would work out for every chunk
    assert {r.text.split("\n")[0] for r in found.collect()} == {"x"}
    assert [r["s"] for r in spark.createDataFrame([('<span a="1">x</span> <span>y</span>',), (None,)], "t string").select(K.span_values("a")("t").alias("s")).collect()] == [[("x", "1"), ("y", None)], []]


def test_topics_take_the_words_of_a_text_once(spark):
    rows = [(i, f"alpha beta {'gamma' if i % 2 else 'delta'} {i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = A.cluster_topics(docs, 2)
    assert "regexp_extract_all" not in plan(found, True)
    assert found.count() == 12
    words = A.topic_keywords(docs.select((F.col("doc_id") % 2).alias("topic"), "text"), 2)
    assert "regexp_extract_all" not in plan(words, True)
    assert {(r.topic, r.term) for r in words.where("rank = 1").collect()} == {(0, "delta"), (1, "gamma")}


def test_an_index_is_built_with_one_deal_of_texts_and_one_of_postings(spark, tmp_path):
    index, wrote = X.TextIndex(spark, str(tmp_path / "index")), []
    rows = [(1, "alpha beta"), (1, "alpha beta"), (2, "beta beta"), (9000, "alpha")]
    listener = lambda df: wrote.append(plan(df))
    kept = X.cut
    X.cut = lambda df: (listener(df), kept(df))[1]
    try:
        assert index.add(spark.createDataFrame(rows, "chunk_id long, text string")) == 3
    finally:
        X.cut = kept
    texts = [p for p in wrote if "sha2" in p][0]
    assert "hashpartitioning(chunk_id" in texts and "hash#" not in "".join(x for x in texts.splitlines() if "hashpartitioning" in x)
    hits = {(r.term, r.block): [tuple(h)[:2] for h in r.hits] for r in index.postings().collect()}
    assert hits == {("alpha", 0): [(1, 1)], ("alpha", 2): [(9000, 1)], ("beta", 0): [(1, 1), (2, 2)]}
