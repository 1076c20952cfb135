import hashlib
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.operators import rank as K
from docloom.operators import retrieve as R
from docloom.plans import registry
from docloom.plans import retrieval_queries as RQ

ROWS = [("a", "alpha bravo charlie"), ("b", "alpha beta charlie alpha"), ("c", "Gamma unique signal.")]


def test_tf_cosine_golden(spark):
    items = spark.createDataFrame(ROWS, "item_id string, text string")
    q = spark.createDataFrame([("q", "alpha charlie")], "query_id string, query_text string")
    got = {r.item_id: r.score for r in R.tf_cosine(R.term_frequencies(items), q).collect()}
    assert got == {"a": pytest.approx(0.816496581), "b": pytest.approx(0.866025404)}


def test_bm25_golden(spark):
    chunks = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(ROWS)], "chunk_id long, text string")
    q = spark.createDataFrame([("u", "unique"), ("b", "bravo"), ("x", "alpha"), ("n", "foo-bar")], "query_id string, query_text string")
    got = {(r.query_id, r.chunk_id): r.score for r in R.bm25(chunks, q).collect()}
    assert got[("u", 2)] == pytest.approx(0.532614, abs=1e-6)
    assert got[("b", 0)] == pytest.approx(0.532614, abs=1e-6)
    assert {k for k in got if k[0] == "x"} == {("x", 0), ("x", 1)}


def test_hash_embedding_golden(spark):
    v = spark.createDataFrame([("hello",)], "t string").select(R.hash_embedding(F.col("t"), 4).alias("v")).first().v
    assert v == pytest.approx([-0.608907, -0.681197, -0.141800, 0.380914], abs=1e-5)


def test_budget_golden(spark):
    rows = [("q", 1, "s1", "x" * 5), ("q", 2, "s1", "x" * 9), ("q", 3, "s2", "x" * 4), ("q", 4, "s3", "x"), ("q", 5, "s2", "x")]
    df = spark.createDataFrame([(q, r, s, s, t, str(r)) for q, r, s, t in rows], "query_id string, rank int, source_uri string, src string, text string, item_id string")
    got = K.apply_budget(df, K.QueryBudget(3, maximum_total_characters=10, max_items_per_source=1)).orderBy("rank").collect()
    assert [(r.item_id, r["rank"]) for r in got] == [("1", 1), ("3", 2), ("4", 3)]
    assert K.apply_budget(df, K.QueryBudget(3, maximum_total_characters=0)).count() == 0


def budget_brute(rows, budget):
    kept = {}
    for q in {r[0] for r in rows}:
        chars, sources, own = 0, [], kept.setdefault(q, [])
        for _, rank, source, item, text in sorted((r for r in rows if r[0] == q), key=lambda r: r[1])[budget.offset :]:
            key, n = item if source is None else source, len(text or "")
            if len(own) < budget.max_total_items and chars + n <= budget.maximum_total_characters and (budget.max_items_per_source is None or sources.count(key) < budget.max_items_per_source):
                own.append(item)
                chars, sources = chars + n, [*sources, key]
    return {(q, i, k) for q, own in kept.items() for k, i in enumerate(own, 1)}


def test_character_budget_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"q{k}", r, rng.choice(["s1", "s2", "s3", None]), f"i{r}", "x" * rng.randrange(40)) for k in range(4) for r in range(1, 60)]
    rows += [("q0", 60, None, "i60", None), *(("long", r, "s", f"i{r}", "x" * 99) for r in range(1, 30))]
    df = spark.createDataFrame(rows, "query_id string, rank int, source_uri string, item_id string, text string")
    for budget in (K.QueryBudget(5, maximum_total_characters=60), K.QueryBudget(9, 2, 90, 2), K.QueryBudget(4, 1, 200, 1), K.QueryBudget(3, maximum_total_characters=0)):
        got = K.apply_budget(df, budget)
        assert {(r.query_id, r.item_id, r["rank"]) for r in got.collect()} == budget_brute(rows, budget)
        assert set(got.columns) == set(df.columns)


def test_budget_of_scores_equals_that_of_ranks(spark):
    rng = random.Random(8)
    rows = [(f"q{k}", r, rng.choice([f"s{i}" for i in range(9)] + [None]), f"i{r:05}", "x" * int(rng.paretovariate(0.6) % 500)) for k in range(3) for r in range(1, 3000)]
    df = spark.createDataFrame([(q, i, s, float(-r // 2), len(t)) for q, r, s, i, t in rows], "query_id string, item_id string, source_uri string, score double, characters long").repartition(6)
    for budget in (K.QueryBudget(5, maximum_total_characters=60), K.QueryBudget(30, 7, 900, 2), K.QueryBudget(4, 1, 200, 1), K.QueryBudget(8, 3), K.QueryBudget(6, 2, None, 1)):
        most = budget if budget.maximum_total_characters is not None else K.replace(budget, maximum_total_characters=10**9)
        got = {(r.query_id, r.item_id, r["rank"]) for r in K.fit_budget(df, budget).collect()}
        assert got == {(q, i, n) for q, i, n in budget_brute(rows, most)}
    few = K._useful(df.select("query_id", F.struct((-F.col("score")).alias("less"), "item_id").alias("at"), F.col("source_uri").alias("source"), "characters"), 5, None, 0)
    assert few.count() < 600  # of 9,000
    assert K.fit_budget(df.limit(0), K.QueryBudget(2, maximum_total_characters=5)).count() == 0


def test_character_budget_sees_every_rank(spark, tmp_path):
    """Ninety texts that are too long come before those that fit."""
    docs = [(i, "the and that " * 2000 + "the " * (90 - i), "s") for i in range(90)] + [(90 + i, "the and that " * (9 - i), "s") for i in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["w_budget_chars"](spark, str(tmp_path)).where("query_id = 'q0'").orderBy("rank").collect()
    assert [(r.item_id, r["rank"]) for r in got] == [("90", 1), ("91", 2), ("92", 3), ("93", 4)]


def test_fusion_takes_the_last_chunk_of_each_side(spark):
    lex = spark.createDataFrame([("q", "a", 1, 3.0), ("q", "a", 2, 1.0), ("q", "b", 3, 0.5)], "query_id string, item_id string, rank int, score double")
    vec = spark.createDataFrame([("q", "c", 1, 0.9)], "query_id string, item_id string, rank int, score double")
    got = {r.item_id: r.score for r in R.fuse(lex, vec).collect()}
    assert got == {"a": 0.5, "b": 0.25, "c": 0.45}
    with pytest.raises(ValueError):
        R.fuse(lex, vec, 0.9, 0.9)


def test_vectors_are_ranked_with_ties_by_id(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, vector array<float>")
    assert [(r.vec_id, r.score) for r in R.vector_candidates(v, q, 3).orderBy("rank").collect()] == [(1, 1.0), (3, 1.0), (2, -1.0)]


def test_hash_embedding_rounds_once(spark):
    """A text whose whole-numbered vector has the length 640: its components end in a 5 at the seventh place."""
    raw = lambda t: [2 * b - 255 for b in hashlib.sha256(f"fixture:0:{t}".encode()).digest()[:16]]
    texts = [t for t in map(str, range(150_000)) if sum(x * x for x in raw(t)) == 640 * 640]
    assert texts
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", R.hash_embedding(F.col("t"), 16).alias("v"), F.transform(R.hash_embedding(F.col("t"), 16), lambda x: F.round(x, 6)).alias("r")).collect():
        assert r.v == [x / 640 for x in raw(r.t)]
        assert r.r == [float((Decimal(x) / 640).quantize(Decimal("1e-6"), ROUND_HALF_UP)) for x in raw(r.t)]


def test_longest_first_lies_in_many_tasks(spark):
    rows = spark.range(4000).select(F.lit("q").alias("query_id"), F.col("id").cast("string").alias("item_id"), (F.col("id") + 1).cast("int").alias("rank"), F.expr("repeat('x', cast(id % 50 as int)) || ' \n'").alias("text"))
    placed = K.longest_first(rows).withColumn("task", F.spark_partition_id())
    got = placed.orderBy("position").collect()
    assert [(r.item_id, r.position) for r in got] == [(x, i + 1) for i, x in enumerate(sorted(map(str, range(4000)), key=lambda x: (-(int(x) % 50), x)))]
    assert all(r["rank"] == int(r.item_id) + 1 for r in got)
    assert max(r["count"] for r in placed.groupBy("task").count().collect()) < 2500


def test_terms_are_counted_once(spark):
    met = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def costly(n):
        met.add(1)
        return n

    tf = spark.createDataFrame([("a", "alpha", 2), ("a", "beta", 1), ("b", "gamma", 3)], "item_id string, term string, n long").select("item_id", "term", costly("n").alias("tf"))
    asked = spark.createDataFrame([("q", "alpha alpha delta")], "query_id string, query_text string")
    assert [tuple(r) for r in R.tf_cosine(tf, asked).collect()] == [("q", "a", 0.8)]
    assert met.value == 3


def test_only_asked_terms_are_grouped(spark, monkeypatch):
    counted, whole = [], R.term_frequencies

    def kept(*a, **b):
        counted.append(whole(*a, **b))
        return counted[-1]

    monkeypatch.setattr(R, "term_frequencies", kept)
    registry.queries()["j_terms"](spark, "/root/testdata/sf0.001").collect()
    assert {r.term for r in counted[0].select("term").distinct().collect()} <= {w for _, t in RQ.QUERIES for w in t.split()}


@pytest.mark.parametrize("limit", [1, 7, 500])
def test_vector_search_keeps_the_best_of_a_task(monkeypatch, limit):
    monkeypatch.setattr(R, "SCORES", 40)
    rng = np.random.default_rng(3)
    vectors, matrix = rng.integers(-2, 3, (300, 3)).astype(float), rng.integers(-2, 3, (9, 3)).astype(float)
    frames = [pd.DataFrame({"vec_id": np.arange(300)[::-1][a : a + 50], "embedding": list(vectors[::-1][a : a + 50])}) for a in range(0, 300, 50)]
    got = pd.concat(R._best_of_batch(iter(frames), list("abcdefghi"), matrix, limit))
    expected = [(q, i, s) for j, q in enumerate("abcdefghi") for s, i in sorted(((float(v @ matrix[j]), i) for i, v in enumerate(vectors)), key=lambda x: (-x[0], x[1]))[:limit]]
    assert list(zip(got.query_id, got.vec_id, got.score, strict=True)) == expected
