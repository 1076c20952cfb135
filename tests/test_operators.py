import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import markup as M
from docloom.functions import metrics as S
from docloom.operators import analyse as A
from docloom.operators import context as X
from docloom.operators import evaluate as E
from docloom.operators import graph as G
from docloom.operators import ingest as I


def test_percentiles_nearest_rank(spark):
    r = A.distribution(spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "v int"), "v", (25, 50, 90)).first()
    assert (r.p50, r.p90, r.p25, r.n) == (2, 4, 1, 4)
    with pytest.raises(ValueError):
        A.distribution(spark.createDataFrame([(1,)], "v int"), "v", (90, 50))


def test_word_errors_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        assert sum(S.word_errors(a, b)) == d[len(a), len(b)]


def test_retrieval_metrics(spark):
    r = E.retrieval_metrics(spark.createDataFrame([("a", 1), ("b", 1)], "query_id string, first int"), 5).first()
    assert (r.hit_rate, r.mean_reciprocal_rank) == (1.0, 1.0)
    assert E.retrieval_metrics(spark.createDataFrame([], "query_id string, first int"), 5).first().hit_rate == 0.0


def test_token_fit(spark):
    b = spark.createDataFrame([("q", 1, "one two three"), ("q", 2, "four five six")], "query_id string, position int, block string")
    assert X.join_blocks(X.fit_tokens(b, 3)).first().text == "one two three"
    assert X.fit_tokens(b, 2).count() == 0


def test_allocation_and_templates():
    assert X.allocate([("a", 1, 1.0), ("b", 0, 1.0), ("c", 0, 1.0)], 10) == {"a": 4, "b": 3, "c": 3}
    assert X.render("{a.b} {c}", {"a": {"b": 1}, "c": "x"}) == "1 x"
    with pytest.raises(KeyError):
        X.render("{a.z}", {"a": {}})


def test_front_matter(spark):
    texts = ["---\ntitle: Alpha Note\n---\nAlpha note\n", "no head", "---\nnever closed"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(I.front_matter(F.col("t")).alias("f")).collect()
    assert [r.f.body for r in got] == ["Alpha note\n", "no head", "---\nnever closed"]
    assert got[0].f["head"] == "title: Alpha Note"


def test_span_rules(spark):
    rows = ['<span ref="link_1">Acme</span> x', '<span id="link_1">Acme</span> launched. <span ref="link_1">Acme</span>']
    got = spark.createDataFrame([(t,) for t in rows], "t string").select(M.parse_spans("t").alias("s"), M.strip_tags(F.col("t")).alias("p")).select(M.link_errors(F.col("s")).alias("e"), "p").collect()
    assert [r.e for r in got] == [[1], []]
    assert got[1].p == "Acme launched. Acme"
    assert [s["attributes"] for s in M.fill_links("Acme and Acme", M.parse('<span id="a">Acme</span> and Acme'))] == [{"id": "a"}, {"ref": "a"}]
    with pytest.raises(ValueError):
        M.parse("<span>a<span>b</span></span>")


def test_hmm_rows_sum_to_one(spark):
    rng = random.Random(1)
    symbols = spark.createDataFrame([(s, i, rng.randrange(3)) for s in range(6) for i in range(10)], "seq long, idx long, symbol int")
    start, trans, emit = A.fit_hmm(symbols, 2, 3, rounds=2)
    assert start.sum() == pytest.approx(1) and trans.sum(1) == pytest.approx([1, 1]) and emit.sum(1) == pytest.approx([1, 1])
    assert A.decode_hmm(symbols, (start, trans, emit)).count() == 60


def test_transition_rows_sum_to_one(spark):
    p = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "a"), (5000, 1, "b")], "seq long, idx int, state string")
    got = {(r.prev, r.next): r.n for r in A.transitions(p, None).collect()}
    assert got == {("a", "b"): 2, ("b", "a"): 1}


def test_cooccurrence_windows(spark):
    got = {(r.a, r.b): r.n for r in G.cooccurrences(spark.createDataFrame([("i", "a b c")], "item_id string, text string"), 2).collect()}
    assert got == {("a", "b"): 1, ("b", "c"): 1}


def test_stream_ingest(spark, tmp_path):
    from docloom.streaming.ingest import ingest_stream, text_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello\nworld")
    ingest_stream(text_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().text == "hello\nworld"


def test_files(spark, tmp_path):
    from docloom.sources.files import import_tree, load

    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_bytes(b"hi")
    (tmp_path / "x" / "b.bin").write_bytes(b"%PDF-1.7")
    items, counts = import_tree(spark, str(tmp_path / "x"), ("*.txt",))
    assert counts.first().asDict() == {"scanned": 2, "imported": 1, "ignored": 1}
    assert items.first().media_type == "application/pdf"
    with pytest.raises(ValueError):
        load(spark, "gopher://x")


def test_every_query_loads():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_crawl_counts_stored_pages_and_goes_on_to_the_end(spark):
    from docloom.sources import web as W

    link = lambda n: f'<a href="http://h/{n}">'
    rows = [("http://h/0", "".join(link(f"missing{i}") for i in range(60)) + link(1))]
    rows += [(f"http://h/{n}", link(n + 1) + link(0)) for n in range(1, 24)]
    pages = spark.createDataFrame([*rows, ("http://h/alone", "")], "url string, html string")
    assert [tuple(r) for r in W.crawl(pages, "http://h/0", "http://h/", 50).orderBy("depth").collect()] == [(f"http://h/{n}", n) for n in range(24)]
    assert [r.depth for r in W.crawl(pages, "http://h/0", "http://h/", 3).orderBy("depth").collect()] == [0, 1, 2]


def test_crawl_statuses_and_counts_equal_a_queue(spark):
    import random

    from docloom.sources import web as W

    r = random.Random(6)
    names = [f"http://h/a/{x}{i}" for i in range(40) for x in ("p", "skip/")] + ["http://h/a//", "http://else/x", "http://h/a/gone"]
    pages = {u: [r.choice(names) for _ in range(r.randrange(4))] for u in names if "gone" not in u}
    df = spark.createDataFrame([(u, "".join(f"<img src={t}#z>" for t in to), "text/html; a" if i % 7 else "image/png") for i, (u, to) in enumerate(pages.items())], "url string, html string, media_type string")
    html = {u: bool(i % 7) for i, u in enumerate(pages)}
    for most in (3, 9, 1000):
        frontier, seen, log, stored = ["http://h/a/p3"], set(), {}, 0
        while frontier and stored < most:
            met = []
            for u in sorted(set(frontier) - seen):
                if stored >= most:
                    break
                seen.add(u)
                log[u] = "outside" if not u.startswith("http://h/a/") else "ignored" if "skip/" in u else "stored" if u in pages else "errored"
                stored += log[u] == "stored"
                met += pages[u] if log[u] == "stored" and html[u] else []
            frontier = met
        found = W.crawl_log(df, "http://h/a/p3", "http://h/a/", most, ("skip/*",))
        assert {x.url: x.status for x in found.collect()} == log
        counts = W.crawl_counts(found).first()
        assert (counts.discovered_items, counts.stored_items, counts.skipped_ignored_items) == (len(log), stored, list(log.values()).count("ignored"))
    assert {x.status for x in W.crawl_log(df.limit(0), "http://h/a/p3", "http://h/a/", 5).collect()} == {"errored"}


def test_paths_of_urls_with_repeated_slashes(spark):
    from docloom.sources import web as W

    df = spark.createDataFrame([(u,) for u in ("http://h/", "http://h//", "http://h/a", "http://h//a//", "http://h/a/")], "u string")
    assert [x[0] for x in df.select(W.relative_path(F.col("u"), "http://h")).collect()] == ["index.html", "index.html", "a", "a/index.html", "a/index.html"]


def test_character_edits_against_the_table(spark):
    rng = random.Random(7)
    texts = ["", "a", "naïve \U0001f600 x", *["".join(rng.choice("abc é") for _ in range(rng.randrange(150))) for _ in range(60)]]
    for a, b in zip(texts, texts[::-1], strict=True):
        assert S.character_edits(a, b) == S.edit_table(list(a), list(b))[-1, -1]
    rows = spark.createDataFrame([*zip(texts, texts[::-1], strict=True), (None, "a"), ("a", None)], "a string, b string")
    assert all(r.x == r.y for r in rows.select(S.edit_distance("a", "b").alias("x"), F.levenshtein("a", "b").alias("y")).collect())


def test_spread_works_values_out_once(spark):
    met = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(x):
        met.add(1)
        return x / 4

    rows = spark.range(9).select(costly("id").alias("v"))
    assert tuple(E.spread(rows, "v", upper=True).first()) == (1.0, 1.0, 0.0, 2.0)
    assert met.value == 9
