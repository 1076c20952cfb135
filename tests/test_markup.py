"""Rules of span markup, and the query that counts what they refuse against its SQL."""

import duckdb
from pyspark.sql import functions as F

from docloom.functions import markup as M


def test_annotation_errors_of_spans_and_of_broken_markup(spark):
    cases = {
        '<span label="a">x</span> <span role=" b ">y</span>': [],
        '<span label="a"></span><span label="a"> \n</span>': [],
        "plain": [],
        "": [],
        "<span>x</span>": [(1, "no attribute")],
        '<span label="a" role="b">x</span> <span label="c">y</span> <span label="" other="">z</span>': [(1, "more than one"), (3, "more than one")],
        '<span label="a">x</span><span other="a">y</span>': [(2, "'other'. Allowed attributes: label, role")],
        '<span label=" \t">x</span>': [(1, "'label' is empty")],
        '<span other=" ">x</span>': [(1, "'other'"), (1, "'other' is empty")],
        '<span label=\\"a\\">x</span>': [],
        '<span label="a">x': [(None, "without end")],
        "x</span>": [(None, "without start")],
        '<span label="a"><span label="b">x</span></span>': [(None, "nested")],
        '<span label="a" label="b">x</span>': [(None, "twice")],
        '<span label="a" b>x</span>': [(None, "nothing but attributes")],
        "y <span label=a> x": [(None, "nothing but attributes")],
    }
    rows = spark.createDataFrame([*enumerate(cases), (len(cases), None)], "i int, t string")
    got = [r.e for r in rows.select("i", M.annotation_errors(F.col("t"), ("label", "role")).alias("e")).orderBy("i").collect()]
    assert got.pop() is None
    for (text, want), errors in zip(cases.items(), got, strict=True):
        assert [e["index"] for e in errors] == [i for i, _ in want], text
        assert all(part in e.error for e, (_, part) in zip(errors, want, strict=True)), text


def test_spans_valid_counts_spans_around_any_word(spark, tmp_path):
    import __spark_entry__ as e

    texts = ["a b c d e f", "a b c d e ", "a  b  c  d", "a b c d e \n g", "", "      ", None, " ".join("x" * 50) + "  " * 9]
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(con.execute(e.oracle_sql()["spans_valid"]).fetchall())
    assert sorted(tuple(r) for r in e.queries()["spans_valid"](spark, str(tmp_path)).collect()) == want


def test_spans_valid_goes_on_after_broken_markup(spark, tmp_path):
    import __spark_entry__ as e

    spark.createDataFrame([(1, 0, "a </span> b"), (2, 0, "a b c d e f")], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted(tuple(r) for r in e.queries()["spans_valid"](spark, str(tmp_path)).collect()) == [(1, 0, 1), (2, 0, 1)]
