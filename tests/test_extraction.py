"""Stage errors, and extraction that resumes at the first stage not stored."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import extract as E


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id string, sha256 string, media_type string, text string")


def number(text):
    if text is None:
        return None
    return str(int(text))


ROWS = [("a", "1", "text/plain", "7"), ("b", "2", "image/png", "x"), ("c", "3", "image/png", None), ("d", "4", "text/plain", " ")]


def test_errors_are_values_and_the_next_stage_goes_on(spark):
    rows = ROWS[:3]
    stages = [E.python_stage("number", number, "text"), E.Stage("kind", lambda: F.when(F.col("item_id") == "a", F.lit("A")), error=lambda: F.when(F.col("item_id") == "c", "no kind"))]
    got = {r.item_id: r for r in E.run_stages(items(spark, rows), stages).collect()}
    assert [o.status for o in got["a"].outputs] == ["extracted", "extracted"] and got["a"].text_out == "A" and got["a"].error_type is None
    assert [o.status for o in got["b"].outputs] == ["errored", "skipped"] and got["b"].status == "errored"
    assert got["b"].error_type == "ValueError" and "invalid literal" in got["b"].error_message
    assert [o.status for o in got["c"].outputs] == ["skipped", "errored"] and (got["c"].error_type, got["c"].error_message) == ("ExtractionError", "no kind")


def test_an_error_after_a_text_keeps_the_text(spark):
    stages = [E.Stage("kind", lambda: F.col("media_type")), E.python_stage("number", number, "text")]
    row = E.run_stages(items(spark, ROWS[1:2]), stages).first()
    assert (row.status, row.text_out, row.final_stage, row.error_type) == ("extracted", "image/png", 0, None)


def test_a_fatal_error_ends_the_job(spark):
    def fatal(text):
        raise E.FatalExtraction("broken store")

    with pytest.raises(Exception, match="broken store"):
        E.run_stages(items(spark, ROWS), [E.python_stage("fatal", fatal, "text")]).collect()


def test_counters_by_status(spark):
    stages = [E.python_stage("number", lambda t: t if t in (None, " ") else str(int(t)), "text")]
    row = E.status_counters(E.run_stages(items(spark, [*ROWS, ("e", "5", "image/png", "12")]), stages)).first().asDict()
    assert row == {"total_items": 5, "already_text_items": 2, "needs_extraction_items": 3, "extracted_items": 3, "extracted_nonempty_items": 2, "extracted_empty_items": 1, "skipped_items": 1, "errored_items": 1, "converted_items": 1}
    assert set(E.status_counters(E.run_stages(items(spark, []), stages)).first()) == {0}


def test_only_a_changed_last_stage_runs_again(spark):
    def never(text):
        raise E.FatalExtraction("must not run")

    head, tail, new_tail = ("head", {}), ("tail", {"v": 1}), ("tail", {"v": 2})
    old, new = E.prefix_ids([head, tail]), E.prefix_ids([head, new_tail])
    assert old[0] == new[0] and old[1] != new[1]
    both = items(spark, ROWS)
    stored = E.stage_outputs(E.run_stages(both, [E.python_stage("head", number, "text"), E.Stage("tail", lambda: F.lit("old"))]), old, fresh=False)
    again = E.resume_stages(both, stored, new, [E.python_stage("head", never, "text"), E.Stage("tail", lambda: F.concat(F.lit("new "), F.coalesce(F.get("outputs", F.lit(0)).text, F.lit("-"))))])
    got = {r.item_id: (r.resumed_at, r.text_out, r.outputs[0].status) for r in again.collect()}
    assert got == {"a": (1, "new 7", "extracted"), "b": (1, "new -", "errored"), "c": (1, "new -", "skipped"), "d": (1, "new -", "errored")}
    assert {r.prefix_id for r in E.stage_outputs(again, new).collect()} == {new[1]}
    # a changed first stage has everything run, and so has changed content
    first = E.prefix_ids([("head", {"v": 9}), tail])
    assert {r.resumed_at for r in E.resume_stages(both, stored, first, [E.Stage("head", lambda: F.lit("h")), E.Stage("tail", lambda: F.lit("t"))]).collect()} == {0}
    changed = both.withColumn("sha256", F.when(F.col("item_id") == "a", "new").otherwise(F.col("sha256")))
    assert {r.item_id: r.resumed_at for r in E.resume_stages(changed, stored, old, [E.Stage("head", lambda: F.lit("h")), E.Stage("tail", lambda: F.lit("t"))]).collect()} == {"a": 0, "b": 2, "c": 2, "d": 2}


def test_a_gap_in_what_is_stored_ends_the_prefix(spark):
    ids = E.prefix_ids([("x", {}), ("y", {}), ("z", {})])
    stages = [E.Stage(n, lambda n=n: F.lit(n)) for n in "xyz"]
    full = E.stage_outputs(E.run_stages(items(spark, ROWS), stages), ids, fresh=False)
    got = E.resume_stages(items(spark, [*ROWS, ROWS[0]]), full.where(F.col("prefix_id") != ids[1]).unionByName(full.where(F.col("prefix_id") == ids[0])), ids, stages).collect()
    assert {r.resumed_at for r in got} == {1} and len(got) == 5
    assert E.resume_stages(items(spark, []), full, ids, stages).count() == 0
