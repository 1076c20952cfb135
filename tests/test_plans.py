import duckdb
import pytest
from pyspark.sql import functions as F

from docloom.functions import markup
from docloom.operators import analyse as A
from docloom.operators import extract as E
from docloom.operators import graph as G
from docloom.operators import ingest as I
from docloom.plans import registry
from docloom.plans import workflow as W
from docloom.sources import providers as P


def test_plan_builds_what_is_missing():
    built = []
    plan = W.Plan([W.Task(n, (), f"{n}-1", lambda n=n: built.append(n)) for n in ("load", "extract", "index")])
    done = {"load-1"}
    assert plan.run(done, "dry_run") == ["extract", "index"] and built == []
    assert plan.run(done, "prompt") == [] and built == []
    assert plan.run(done) == ["extract", "index"] and plan.run(done) == []
    with pytest.raises(ValueError):
        plan.run(done, "other")


def test_configuration():
    assert W.configuration_id("scan", {"b": 1, "a": 2}) == W.configuration_id("scan", {"a": 2, "b": 1})
    assert W.with_overrides({"a": {"b": 1}}, ["a.b=2", "c=x"]) == {"a": {"b": 2}, "c": "x"}


def test_knowledge_base(spark):
    items = spark.createDataFrame([("a", "s", "text/plain", "alpha beta " * 5), ("b", "t", "text/plain", "gamma")], "item_id string, source_uri string, media_type string, text string")
    kb = W.KnowledgeBase(items)
    assert [r.item_id for r in kb.query(spark, "alpha").collect()] == ["a"]
    assert kb.pack(spark, "gamma alpha", 11).first().n_blocks == 2
    assert kb.pack(spark, "gamma alpha", 5).count() == 0


def test_knowledge_base_looks_past_texts_that_do_not_fit(spark):
    rows = [(f"a{i:02}", "s", "text/plain", "alpha " * 400) for i in range(30)] + [("b", "t", "text/plain", "alpha")]
    items = spark.createDataFrame(rows, "item_id string, source_uri string, media_type string, text string")
    assert [(r.item_id, r["rank"]) for r in W.KnowledgeBase(items).query(spark, "alpha").collect()] == [("b", 1)]


def test_stand_ins(spark):
    rows = spark.createDataFrame([(1, "hello"), (2, None)], "key long, text string")
    got = {r.key: r.embedding for r in P.embed(rows, P.HashEmbedding(4)).collect()}
    assert got[1] == pytest.approx([-0.608907, -0.681197, -0.1418, 0.380914], abs=1e-5)
    assert rows.select(P.complete(F.col("text"), P.EchoChat(), "s").alias("a")).first().a == '["hello"]'
    words = spark.createDataFrame([(b"a b", "image/png"), (b"c", "text/plain")], "c binary, m string").select(P.recognise(F.col("c"), F.col("m"), P.FixedRecognition(), "image/").alias("w")).collect()
    assert [w.text for w in words[0].w] == ["a", "b"] and words[1].w is None


def test_language_models_make_graphs(spark):
    rows = [(1, "Ada Byron knew ada things. Ada byron x. Ab cd ef"), (2, ""), (3, None)]
    read = spark.createDataFrame(rows, "item_id long, text string").select("item_id", P.analysed(F.col("text"), P.CapitalWords()).alias("read"))
    nodes, edges = G.of_language(read)
    assert {(r.item_id, r.node_id, r.entity_type) for r in nodes.collect()} == {(1, "entity:ada_byron", "NAME"), (1, "entity:ada", "WORD"), (1, "item:1", None), (2, "item:2", None), (3, "item:3", None)}
    found = {(r.edge_type, r.src, r.dst, r.predicate, r.weight) for r in edges.collect()}
    assert found == {("mentions", "item:1", "entity:ada_byron", None, 1.0), ("mentions", "item:1", "entity:ada", None, 1.0), ("related_to", "entity:byron", "entity:ada", "knew", 1.0)}
    assert G.of_language(read.limit(0))[1].count() == 0


def test_speech_of_audio_only_and_silence(spark):
    rows = spark.createDataFrame([(1, b" a\nb ", "audio/wav"), (2, b"a\n\nb", "audio/wav"), (3, b"a", "text/plain"), (4, None, "audio/wav"), (5, b"a", None)], "k long, c binary, m string")
    heard = lambda least: {r.k: r.t for r in rows.select("k", P.transcribed(F.col("c"), F.col("m"), P.LineSpeech(), least).alias("t")).collect()}
    assert heard(0.9) == {1: "a b", 2: "", 3: None, 4: None, 5: None}
    assert heard(None)[2] == "a  b"


def test_model_texts_and_labels(spark):
    docs = spark.createDataFrame([(1, "one. two"), (2, " "), (3, None), (4, "x")], "doc_id long, text string")
    texts, report = A.model_texts(docs, lambda t: P.complete(t, P.EchoChat(), "list"), True)
    assert sorted((r.document_id, r.text) for r in texts.collect()) == [("1:1", "one"), ("1:2", "two"), ("4:1", "x")]
    assert report.first().asDict() == {"input_documents": 4, "errors": 2, "output_documents": 3}
    texts, report = A.model_texts(docs, lambda t: t, False)
    assert sorted((r.document_id, r.text) for r in texts.collect()) == [("1", "one. two"), ("4", "x")] and report.first().errors == 2
    topics = spark.createDataFrame([(0, "a", ["a", "b"]), (1, "c", ["c"])], "topic int, label string, keywords array<string>")
    assigned = docs.where("doc_id <> 3").withColumn("topic", F.lit(0))
    named = A.model_labels(topics, assigned, lambda p: F.when(p.startswith("a"), p), "{keywords}|{documents}", 2, 2)
    assert {r.topic: (r.label, r.label_source) for r in named.collect()} == {0: ("a, b|one. two", "llm"), 1: ("c", "keywords")}


def test_layout_text(spark):
    kind = "array<struct<order:int,bbox:array<double>,words:array<struct<text:string,confidence:double>>>>"
    box = [0.0, 0.0, 1.0, 1.0]
    regions = [(None, box, [("last", 0.5)]), (2, box, [("b", 0.75), ("unsure", 0.1), (" ", 0.9)]), (1, box, [("a", 1.0), ("c", 0.75)]), (0, None, [("x", 1.0)]), (3, [1.0], [("y", 1.0)]), (4, box, [])]
    rows = spark.createDataFrame([(1, regions), (2, [])], f"k int, r {kind}").select("k", E.layout_text(F.col("r"), 0.5).alias("x")).orderBy("k").collect()
    assert tuple(rows[0].x) == ("a c\n\nb\n\nlast", 0.75, 6, 3) and tuple(rows[1].x) == ("", None, 0, 0)


def test_markdown_is_no_stream_and_deletion_must_be_confirmed(spark, tmp_path):
    rows = spark.createDataFrame([(b"ab", "text/markdown")], "c binary, m string")
    with pytest.raises(Exception, match="Markdown"):
        rows.select(I.streamed(F.col("c"), F.col("m"))).collect()
    assert rows.select(I.streamed(F.col("c"), F.lit("image/png")).alias("x")).first().x.bytes == 2
    path = str(tmp_path / "snapshot")
    rows.write.parquet(path)
    with pytest.raises(ValueError):
        I.purge(spark, path, "other")
    I.purge(spark, path, "snapshot")
    assert not (tmp_path / "snapshot").exists()


def test_edits_may_only_add_tags():
    class Liar:
        def complete(self, system, user):
            return user + "!"

    with pytest.raises(ValueError):
        P.edited("x", Liar(), "s", lambda t: markup.TAG.sub("", t))


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True)


@pytest.mark.parametrize("word", ["alphabetical", "a"])
def test_halved_packs_equal_their_sql(spark, tmp_path, word):
    """Packs that end at 8,000 characters, and at the last level, 2,000."""
    texts = [f" \n the {(word + ' ') * (1900 // (len(word) + 1) - i % 3)}\n" for i in range(30)]
    rows = [(i, t, "en", f"s{i}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = con.execute(registry.oracle_sql()["ce_rpack"]).fetchall()
    got = [tuple(r) for r in registry.queries()["ce_rpack"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(expected) and len(got) == 1
