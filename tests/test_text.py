from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunk as C


def one(spark, value, *cols):
    return spark.createDataFrame([(value,)], "t string").select(*cols).first()


def test_tokens(spark):
    r = one(spark, "The  caté, don't stop　now_", T.whitespace_tokens(F.col("t")).alias("a"), T.term_tokens(F.col("t")).alias("b"), T.folded_tokens(F.col("t")).alias("c"), T.query_tokens(F.col("t")).alias("d"))
    assert r.a == ["The", "caté,", "don't", "stop", "now_"]
    assert r.b == ["the", "cat", "don", "t", "stop", "now"]
    assert "cate" in r.c
    assert r.d == ["The", "caté", "don't", "stop", "now"]


def test_substring_count_does_not_overlap(spark):
    assert one(spark, "aaaa", T.substring_count(F.col("t"), F.lit("aa")).alias("n")).n == 2


def test_char_windows(spark):
    r = one(spark, "abcdefghijkl", C.char_windows(F.col("t"), 5, 2).alias("c")).c
    assert [(x.span_start, x.span_end, x.text) for x in r] == [(0, 5, "abcde"), (3, 8, "defgh"), (6, 11, "ghijk"), (9, 12, "jkl")]
    assert one(spark, "", C.char_windows(F.col("t"), 5, 2).alias("c")).c == []


def test_paragraphs(spark):
    cases = {"a\n\nb": ["a", "\nb"], "a\n\n\n\nb": ["a", "\nb"], "\n\nx\n\n": ["\nx"], "one\ntwo\n\n three": ["one\ntwo", "\n three"], "": [], "\n": []}
    for text, expected in cases.items():
        found = one(spark, text, C.paragraphs(F.col("t")).alias("c")).c
        assert [x.text for x in found] == expected or [x.text.rstrip("\n") for x in found] == expected
        assert all(text[x.span_start : x.span_end] == x.text for x in found)


def test_sentences_and_token_windows(spark):
    assert one(spark, "One. Two!  Three?", C.sentences(F.col("t")).alias("c")).c == ["One.", "Two!", "Three?"]
    r = one(spark, " a bb  c d e", C.token_windows(F.col("t"), 3, 1).alias("c")).c
    assert [x.text for x in r] == ["a bb  c", "c d e"]


def test_windows_cover_the_text(spark):
    rows = spark.createDataFrame([(i, "x" * i + " y" * (i // 3)) for i in range(1, 60)], "i int, t string").select("t", C.char_windows(F.col("t"), 7, 3).alias("c")).collect()
    for r in rows:
        seen = set()
        for c in r.c:
            assert r.t[c.span_start : c.span_end] == c.text
            seen |= set(range(c.span_start, c.span_end))
        assert all(i in seen or r.t[i] == " " for i in range(len(r.t)))


def test_chunk_ids_do_not_depend_on_partitions(spark):
    items = spark.createDataFrame([(str(i), i, "ab " * (i % 5 + 1)) for i in range(50)], "item_id string, catalog_pos long, text string")
    ids = [sorted((r.chunk_id, r.item_id) for r in C.with_chunk_ids(C.chunk_table(items.repartition(n), lambda t: C.char_windows(t, 4, 1))).collect()) for n in (1, 7)]
    assert ids[0] == ids[1]
    assert [x[0] for x in ids[0]] == list(range(len(ids[0])))


def test_entity_forms(spark):
    forms = [one(spark, v, T.normal_entity(F.col("t"), F.lit(k)).alias("v")).v for v, k in (("01/02/2024", "date"), ("Total: $1,234.50", "total"), ("Acme  Inc.", "company"), ("5 Main St.", "address"), ("", "date"))]
    assert forms[:3] == ["01-02-2024", "1234.50", "acme"]
    assert forms[3].startswith("5 main street")
    assert forms[4] == ""


def test_stripping_takes_all_white_space(spark):
    texts = ["\n\t a b\r\n", "\u00a0x\u3000\u2009", "\x1c\x1fy", " \n\u2003\x1d", "", None, "in\u00a0side"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.strip(F.col("t")).alias("s"), T.blank(F.col("t")).alias("b")).orderBy("i").collect()
    assert [r.s for r in rows] == [None if t is None else t.strip() for t in texts]
    assert [r.b for r in rows] == [None if t is None else not t.strip() for t in texts]
