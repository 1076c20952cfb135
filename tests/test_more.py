"""Links, crawls, reuse, facades, names and order statistics against plain Python."""

import json
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import markup as M
from docloom.functions import text as T
from docloom.operators import analyse as A
from docloom.operators import chunk
from docloom.operators import evaluate as E
from docloom.operators import extract as X
from docloom.operators import graph as G
from docloom.operators import lineage
from docloom.operators import retrieve as R
from docloom.plans import workflow as W
from docloom.sources import web
from docloom.sources import providers


def test_links_of_any_quoting(spark):
    pages = [
        "<a href='/one'>x</a><A HREF=/two>y</A><img alt=\"\" src=\"three?a=1&amp;b=2#f\"><!-- <a href='/no'> --><a href=' '><a href><a title=\"href='/no'\" href=\"/four\">",
        '<script>var a = "<a href=\'/no\'>";</script><link href="mailto:x@y"><a href="javascript:go()"><a href="//other/z"><a href="http://[bad/">',
        None,
        "",
        "<a href='/cut",
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = {r.i: r for r in df.select("i", web.raw_links(F.col("html")).alias("raw"), web.linked_urls(F.col("html"), F.lit("http://h/p/")).alias("to")).collect()}
    assert got[0].raw == ["/one", "/two", "three?a=1&b=2#f", "/four"]
    assert got[0].to == ["http://h/one", "http://h/two", "http://h/p/three?a=1&b=2", "http://h/four"]
    assert got[1].to == ["http://other/z"] and got[2].to == got[3].to == got[4].to == []


def test_crawl_against_breadth_first_search(spark):
    rng = random.Random(4)
    n, url = 80, "http://h/{}".format
    to = {i: [rng.randrange(n + 20) for _ in range(rng.randrange(3))] + ([i + 1] if i < 45 else []) for i in range(n)}
    pages = spark.createDataFrame([(url(i), "".join(f"<a href='{j}#x'>" for j in to[i]) + "<a href='http://other/'>") for i in range(n)], "url string, html string")
    depth, frontier = {0: 0}, [0]
    while frontier:
        frontier = sorted({j for i in frontier for j in to[i] if j < n and j not in depth})
        depth |= {j: max(depth.values()) + 1 for j in frontier}
    assert max(depth.values()) > 5
    assert {r.url: r.depth for r in web.crawl(pages, url(0), "http://h/", 1000).collect()} == {url(i): d for i, d in depth.items()}


def test_accents_of_all_kinds(spark):
    r = spark.createDataFrame([("ŐŘŠ ő ř š ė́ ñ Ångström étè ß 日本 ḍ̣",)], "t string").select(T.folded_tokens(F.col("t")).alias("w")).first()
    assert r.w == ["ors", "o", "r", "s", "e", "n", "angstrom", "ete", "ß", "日本", "d"]


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [5.0] * 40 + [1.0, None, 9.0], [float(x % 17) for x in range(101)]])
def test_order_statistics(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "seconds double")
    own = sorted(v for v in values if v is not None)
    for upper in (True, False):
        got = E.spread(df, "seconds", upper).first()
        assert got.median_seconds == (None if not own else own[len(own) // 2] if upper else statistics.median(own))
    latency = E.latency_metrics(df).first()
    assert latency.percentile_95 == pytest.approx(own[round(0.95 * (len(own) - 1))] * 1000 if own else 0.0)


def test_best_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(60)] + [(60, [0.0] * 6), (61, None)]
    q = [(f"q{i}", [float(x) for x in rng.normal(size=6)]) for i in range(4)]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in R.vector_candidates(spark.createDataFrame(v, "vec_id long, embedding array<float>").repartition(5), spark.createDataFrame(q, "query_id string, vector array<double>"), 7).collect()}
    for name, x in q:
        unit = np.array(x) / np.linalg.norm(x)
        scores = sorted((-round(float(np.float32(e).astype(float) @ unit), 6), i) for i, e in v if e is not None)[:7]
        assert [got[name, k + 1][0] for k in range(7)] == [i for _, i in scores]


def test_reuse_of_snapshots(spark):
    items = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y"), ("c", "3", "z"), ("d", "4", "w"), ("d", "4", "w")], "item_id string, sha256 string, text string")
    stored = spark.createDataFrame([("s", "a", "1", "kept"), ("s", "b", "old", "stale"), ("t", "c", "3", "other"), ("s", "d", "4", None), ("s", "gone", "9", "x")], "snapshot_id string, item_id string, sha256 string, text_out string")
    got = {r.item_id: (r.text_out, r.reused) for r in X.reuse(items, stored, "s", lambda m: m.withColumn("text_out", F.upper("text"))).collect()}
    assert got == {"a": ("kept", True), "b": ("Y", False), "c": ("Z", False), "d": (None, True)}
    assert X.reuse(items.limit(0), stored, "s", lambda m: m.withColumn("text_out", F.upper("text"))).count() == 0
    assert X.snapshot_id([("a", {"x": 1, "y": 2})]) == X.snapshot_id([("a", {"y": 2, "x": 1})]) != X.snapshot_id([("b", {"x": 1, "y": 2})])


def test_graph_of_items(spark):
    items = spark.createDataFrame([("i", "Ada Lovelace met Charles Babbage. NASA saw Ada Lovelace."), ("j", "nothing here"), ("k", None), ("l", " ")], "item_id string, text string")
    nodes, edges, summary = G.build(items)
    assert summary.first().asDict() == {"items": 4, "skipped": 2, "nodes": 5, "edges": 5}
    got = {(r.src, r.dst, r.edge_type): r.weight for r in edges.collect()}
    assert got["item:i", "entity:ada_lovelace", "mentions"] == 2 and got["entity:ada_lovelace", "entity:charles_babbage", "related_to"] == 1
    assert {r.node_id for r in nodes.collect()} == {"item:i", "item:j", "entity:ada_lovelace", "entity:charles_babbage", "entity:nasa"}


def test_topic_run(spark):
    items = spark.createDataFrame([(1, "Cats purr. Cats sleep by ACME"), (2, "Dogs bark. Dogs run"), (3, None), (4, " "), (5, "x")], "doc_id long, text string")
    by_word = lambda t: t.withColumn("topic", F.when(F.contains("text", F.lit("cats")), 0).otherwise(1))
    topics, documents, report = A.topic_run(items, by_word, lambda t: F.split(t, r"\. "), lambda t: F.replace(t, F.lit("ACME"), F.lit("")), least=2, name=lambda words: "/".join(words[:1]).upper())
    assert report.first().asDict() == {"items": 5, "texts": 5, "left": 4}
    assert {r.topic: (r.n, r.label) for r in topics.collect()} == {0: (2, "CATS"), 1: (2, "DOGS")}
    assert {(r.doc_id, r.part, r.topic) for r in documents.collect()} == {(1, 0, 0), (1, 1, 0), (2, 0, 1), (2, 1, 1)}
    assert A.topic_run(items.limit(0), by_word)[0].count() == 0


def test_state_names(spark):
    report = spark.createDataFrame([(0, ["START", "start", "hi"]), (1, ["hello", "END"]), (2, ["END", "END"]), (3, ["bye"])], "state int, examples array<string>")
    asked = []

    def ask(prompt):
        asked.append(prompt)
        return ["no json", json.dumps({"1": "same", "3": "same"}), json.dumps({"1": "greets", "3": "leaves"})][len(asked) - 1]

    assert {r.state: r.label for r in A.name_states(report, ask).collect()} == {0: "START", 1: "greets", 2: "END", 3: "leaves"}
    assert len(asked) == 3 and "END" not in asked[0] and "given twice" in asked[2]
    with pytest.raises(ValueError):
        A.name_states(report, lambda _: json.dumps({"1": "one two three", "3": "x"}), most_words=2, retries=1)
    assert A.name_states(report.limit(0), ask).count() == 0


def test_packs_by_tokens(spark):
    rows = [("a", "s", "one two three"), ("b", "s", "four " * 50), ("c", "t", "five six"), ("d", "t", " ")]
    items = spark.createDataFrame(rows, "item_id string, source_uri string, text string")
    scored = spark.createDataFrame([("q", i, float(9 - k)) for k, (i, *_) in enumerate(rows)], "query_id string, item_id string, score double")
    assert W.PackRequest(max_tokens=10).budget().maximum_total_characters == 40
    assert W.retrieve_pack(scored, items, W.PackRequest(5, max_tokens=10)).first().text == "one two three\n\nfive six"
    assert W.retrieve_pack(scored, items, W.PackRequest(5, max_tokens=4)).first().text == "one two three"
    pack, used = W.render_pack(scored, items, W.PackRequest(5, maximum_total_characters=300), 5)
    assert pack.first().text == "one two three\n\nfive six" and used.maximum_total_characters == 150
    assert W.render_pack(scored, items, W.PackRequest(5), 3)[1].max_tokens == 3
    assert W.retrieve_pack(scored.limit(0), items, W.PackRequest(5, max_tokens=10)).count() == 0


def test_filled_links_as_a_column(spark):
    rows = [("Acme and Acme", '<span ref="link_a">Acme</span> and Acme'), ("x", None), (None, "x")]
    df = spark.createDataFrame(rows, "t string, m string")
    got = df.select("t", "m", M.filled_links(F.col("t"), M.parse_spans("m")).alias("s")).collect()
    assert [[s.attributes for s in r.s] if r.s is not None else None for r in got] == [[{"id": "link_a"}, {"ref": "link_a"}], None, None]


def test_tables_end_lineage_and_can_be_dropped(spark):
    table = lineage.cut(spark.range(5))
    assert table.count() == 5 and lineage.shared_dir(spark).removeprefix("file:") in table.inputFiles()[0]
    lineage.drop(table, spark.range(1))
    with pytest.raises(Exception):
        table.count()

    inner = []

    def make():
        inner.append(lineage.cut(spark.range(3)))
        return inner[0].where("id > 0")

    settled = lineage.settled(make)
    assert settled.count() == 2
    with pytest.raises(Exception):
        inner[0].count()

    class Far:
        master = "spark://far"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Far()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_dir(Session())


def test_texts_are_read_a_hundred_at_a_time(spark):
    """Not in Arrow batches of ten thousand texts with all that is found in them."""
    rows = spark.createDataFrame([("Ada met Bob <span kind=\"a\">here</span>",), (None,)], "t string")
    for made in (providers.analysed(F.col("t"), providers.CapitalWords()), M.parse_spans("t"), chunk.token_windows(F.col("t"), 2, 1)):
        plan = rows.select(made.alias("x"))._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    got = rows.select(providers.analysed(F.col("t"), providers.CapitalWords()).alias("x"), M.parse_spans("t").alias("s")).collect()
    assert [e.text for e in got[0].x.entities] == ["Ada", "Bob"] and got[0].s[0].start == 12
    assert got[1].x.entities is None and got[1].s is None
