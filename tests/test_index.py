"""The stored full-text index: same scores as without it, read by terms, grown by what is new."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.operators import index as X
from docloom.operators import retrieve as R


def texts(n, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["the"] * 30 + ["Élan"] * 3
    return [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 60)))) for i in range(n)]


@pytest.fixture
def made(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "SPAN", 16)
    rows = texts(300)
    index = X.TextIndex(spark, str(tmp_path / "index"))
    assert index.add(spark.createDataFrame(rows[:100], "chunk_id long, text string")) == 100
    assert index.add(spark.createDataFrame(rows, "chunk_id long, text string")) == 200
    assert index.add(spark.createDataFrame(rows[50:150], "chunk_id long, text string")) == 0
    return index, rows


def queries(spark):
    asked = [("a", "the w1"), ("b", "w2 w3"), ("c", "elan"), ("d", "nothing here"), ("e", "the"), ("f", "w1")]
    return R.query_terms(spark.createDataFrame(asked, "query_id string, query_text string"))


def found(df):
    return sorted((r.query_id, r.chunk_id, r.score) for r in df.collect())


def test_scores_are_those_without_an_index(spark, made):
    index, rows = made
    chunks = spark.createDataFrame(rows, "chunk_id long, text string")
    plain = found(R.bm25_scores(R.chunk_index(chunks, queries(spark)), queries(spark)))
    assert found(index.bm25(queries(spark))) == plain and {q for q, _, _ in plain} == {"a", "b", "c", "e", "f"}
    for limit in (1, 7, 1000):
        best = [x for q in "abcef" for x in sorted((p for p in plain if p[0] == q), key=lambda p: (-p[2], p[1]))[:limit]]
        assert found(index.bm25(queries(spark), limit)) == sorted(best)


def test_a_query_reads_only_its_terms_files(spark, made):
    index, _ = made
    terms = queries(spark).where("query_id = 'b'")
    spark.conf.set("spark.sql.maxMetadataStringLength", 100_000)
    plan = index.asked(terms)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    wanted = {r[0] for r in spark.createDataFrame([("w2",), ("w3",)], "term string").select(X.bucket_of(F.col("term"))).collect()}
    scan = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan)
    assert "bucket" in scan[1] and "batch" in scan[1] and "term" in scan[2]
    opened = index.asked(terms).select(F.input_file_name()).distinct().collect()
    assert {int(re.search(r"bucket=(\d+)", r[0])[1]) for r in opened} <= wanted
    assert len(list(Path(index.path).glob("postings/batch=*/bucket=*"))) > 2 * len(wanted)


def test_blocks_that_cannot_reach_the_last_hit_are_not_opened(spark, made, monkeypatch):
    index, _ = made
    monkeypatch.setattr(X, "FIRST_BLOCKS", 2)
    opened, real = [], X.TextIndex._scored
    monkeypatch.setattr(X.TextIndex, "_scored", staticmethod(lambda met, mean: opened.append(met.select("query_id", "block").distinct().count()) or real(met, mean)))
    top = found(index.bm25(queries(spark).where("query_id = 'f'"), 1))
    assert len(top) == 1 and opened[0] == 2 and sum(opened) < 19  # of 19 blocks


def test_a_batch_that_was_not_finished_is_not_read(spark, made):
    index, rows = made
    before = found(index.bm25(queries(spark)))
    index.postings().where("bucket < 99").drop("batch").limit(5).write.partitionBy("bucket").parquet(f"{index.path}/postings/batch=lost")
    assert found(index.bm25(queries(spark))) == before
    assert index.add(spark.createDataFrame([(1000, "w2 w3 w3")], "chunk_id long, text string")) == 1
    assert ("b", 1000) in {x[:2] for x in found(index.bm25(queries(spark)))}


def test_changed_texts_nulls_and_empty_tables(spark, made, tmp_path):
    index, rows = made
    with pytest.raises(Exception, match="another text of chunk 5"):
        index.add(spark.createDataFrame([(5, "changed")], "chunk_id long, text string"))
    with pytest.raises(ValueError, match="same chunk_id"):
        index.add(spark.createDataFrame([(2000, "one"), (2000, "two")], "chunk_id long, text string"))
    empty = X.TextIndex(spark, str(tmp_path / "empty"))
    assert found(empty.bm25(queries(spark))) == [] and found(empty.bm25(queries(spark), 3)) == []
    assert empty.add(spark.createDataFrame([], "chunk_id long, text string")) == 0
    assert empty.add(spark.createDataFrame([(1, None), (2, ""), (None, "the w1"), (3, "the w1"), (3, "the w1")], "chunk_id long, text string").withColumn("hash", F.lit(0))) == 3
    assert [x[:2] for x in found(empty.bm25(queries(spark)))] == [("a", 3), ("e", 3), ("f", 3)]
    assert found(index.bm25(queries(spark).limit(0))) == []
