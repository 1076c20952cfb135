"""Extraction as an ordered fold of stages over items, and selection among stage outputs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ingest import front_matter, glob_regex
from .lineage import cut

OUTPUT = "struct<stage_index:int,extractor_id:string,status:string,text:string,producer:string,confidence:double,error_type:string,error_message:string>"
ATTEMPT = "struct<text:string,error_type:string,error_message:string>"


class FatalExtraction(Exception):
    """Ends the whole extraction, where any other exception of a stage's function only fails the item at that stage."""


@dataclass(frozen=True)
class Stage:
    """A stage gives a text, or null to skip the item, from the item's columns and the outputs so far.

    ``error`` is a string, null where the stage does well, else what is wrong with the item; its text is then not taken.
    A stage made by ``python_stage`` gives text and error at once.
    """

    extractor_id: str
    text: Callable[[], Column]
    confidence: Callable[[], Column] | None = None
    error: Callable[[], Column] | None = None
    error_type: str = "ExtractionError"
    attempt: Callable[[], Column] | None = None


def python_stage(extractor_id: str, function: Callable, *columns: str) -> Stage:
    """A stage whose text is ``function`` of the item's columns. What it raises becomes the item's error at that stage, by
    type and message, and the other items go on; only ``FatalExtraction`` ends the job."""

    def one(*values: object) -> tuple[str | None, str | None, str | None]:
        try:
            return function(*values), None, None
        except FatalExtraction:
            raise
        except Exception as error:  # whatever it is, it is the item's
            return None, type(error).__name__, str(error)

    @F.pandas_udf(ATTEMPT)
    def attempt(*series: pd.Series) -> pd.DataFrame:
        rows = [one(*[None if v is None or v is pd.NA else v for v in row]) for row in zip(*series, strict=True)]
        return pd.DataFrame(rows, columns=["text", "error_type", "error_message"], dtype=object)

    made = lambda: attempt(*columns)
    return Stage(extractor_id, lambda: made().text, attempt=made)


def _output(df: DataFrame, i: int, stage: Stage) -> DataFrame:
    """The stage's output appended to ``outputs``."""
    null = F.lit(None).cast("string")
    if stage.attempt is not None:
        tried = stage.attempt()
    else:
        error = stage.error() if stage.error else null
        tried = F.struct(F.when(error.isNull(), stage.text()).alias("text"), F.when(error.isNotNull(), stage.error_type).alias("error_type"), error.cast("string").alias("error_message"))
    df = df.withColumn("tried", tried).withColumn("sure", stage.confidence() if stage.confidence else F.lit(None).cast("double"))
    status = F.when(F.col("tried.error_type").isNotNull(), "errored").when(F.col("tried.text").isNull(), "skipped").otherwise("extracted")
    out = F.struct(F.lit(i).alias("stage_index"), F.lit(stage.extractor_id).alias("extractor_id"), status.alias("status"), F.col("tried.text").alias("text"), F.lit(stage.extractor_id).alias("producer"), F.col("sure").cast("double").alias("confidence"), F.col("tried.error_type").alias("error_type"), F.col("tried.error_message").alias("error_message"))
    return df.withColumn("outputs", F.concat("outputs", F.array(out))).drop("tried", "sure")


def _result(df: DataFrame) -> DataFrame:
    """final_stage and text_out of the last output with a text; status; and the last error where there is no text."""
    done, wrong = F.filter("outputs", lambda o: o.status == "extracted"), F.filter("outputs", lambda o: o.status == "errored")
    some = F.size(done) > 0
    df = df.withColumn("final_stage", F.when(some, F.element_at(done, -1).stage_index)).withColumn("text_out", F.when(some, F.element_at(done, -1).text))
    df = df.withColumn("status", F.when(some, "extracted").when(F.size(wrong) > 0, "errored").otherwise("skipped"))
    last = F.when(F.col("status") == "errored", F.element_at(wrong, -1))
    return df.withColumn("error_type", last.error_type).withColumn("error_message", last.error_message)


def run_stages(items: DataFrame, stages: list[Stage]) -> DataFrame:
    """Items with ``outputs``, one for each stage in order, and the final text: that of the last one that gave any.

    A stage that fails leaves an output with its error, and the next one goes on. status is extracted if any stage gave
    a text, else errored if any failed (error_type and error_message of the last one), else skipped. These columns take
    the place of an item's own of such names.
    """
    df = items.withColumn("outputs", F.expr(f"cast(array() as array<{OUTPUT}>)"))
    for i, stage in enumerate(stages):
        df = _output(df, i, stage)
    return _result(df)


def status_counters(extracted: DataFrame) -> DataFrame:
    """One row over extracted items (media_type, status, text_out): all, those that are text already and those that are
    not, by status, extracted ones with and without something in their text, and converted ones: text from what wasn't."""
    is_text, full = F.col("media_type").startswith("text/"), ~T.blank(F.coalesce("text_out", F.lit("")))
    done = F.col("status") == "extracted"
    wanted = {"total_items": F.lit(True), "already_text_items": is_text, "needs_extraction_items": ~is_text, "extracted_items": done, "extracted_nonempty_items": done & full, "extracted_empty_items": done & ~full, "skipped_items": F.col("status") == "skipped", "errored_items": F.col("status") == "errored", "converted_items": done & full & ~is_text}
    return extracted.agg(*[F.count_if(c).alias(n) for n, c in wanted.items()])


def prefix_ids(stages: list[tuple[str, dict]]) -> list[str]:
    """An id for each stage of (extractor, configuration), which that stage and all before it decide: whatever has it was
    made alike up to there."""
    ids, before = [], ""
    for stage in stages:
        before = hashlib.sha256((before + json.dumps(stage, sort_keys=True, separators=(",", ":"))).encode()).hexdigest()
        ids.append(before)
    return ids


def resume_stages(items: DataFrame, stored: DataFrame, ids: list[str], stages: list[Stage]) -> DataFrame:
    """``run_stages`` that takes what is stored and begins each item at the first stage that isn't: column resumed_at.

    items (item_id, sha256 of the content, ...); stored (prefix_id, item_id, sha256, output), of any pipelines, a row for
    each stage of an item, see ``stage_outputs``; ids by ``prefix_ids``. Outputs count up to the first stage without
    one, so a stage that changed, and what follows it, runs again, and so does an item whose content changed. Stages are
    run by groups of items that begin at the same stage, so a stage isn't even called for those that have it. Stored
    rows that repeat count once (the largest); items that repeat come back as often as they are; a skipped or errored
    output is one too and isn't tried again.
    """
    place = F.create_map(*[x for i, k in enumerate(ids) for x in (F.lit(k), F.lit(i))])
    mine = stored.where(F.col("prefix_id").isin(*ids)).select("item_id", "sha256", place[F.col("prefix_id")].alias("i"), F.col("output").cast(OUTPUT).alias("output"))
    kept = mine.groupBy("item_id", "sha256", "i").agg(F.max("output").alias("output")).groupBy("item_id", "sha256").agg(F.array_sort(F.collect_list(F.struct("i", "output"))).alias("known"))  # an entry for each stage
    run = F.filter("known", lambda x, n: x.i == n)  # entries at their own place: all up to the first gap
    both = items.drop("outputs").join(kept, ["item_id", "sha256"], "left").withColumn("outputs", F.coalesce(F.transform(run, lambda x: x.output), F.expr(f"cast(array() as array<{OUTPUT}>)"))).drop("known")
    begun = cut(both.withColumn("resumed_at", F.size("outputs")))
    parts = []
    for r in begun.select("resumed_at").distinct().collect():  # as many numbers as stages, and one
        df = begun.where(F.col("resumed_at") == r.resumed_at)
        for i in range(r.resumed_at, len(stages)):
            df = _output(df, i, stages[i])
        parts.append(df)
    return _result(reduce(DataFrame.unionByName, parts) if parts else begun)


def stage_outputs(extracted: DataFrame, ids: list[str], fresh: bool = True) -> DataFrame:
    """Rows to store (prefix_id, item_id, sha256, output), with ``fresh`` only those made since ``resumed_at``."""
    each = extracted.select("item_id", "sha256", *(["resumed_at"] if fresh else []), F.explode("outputs").alias("output"))
    each = each.where("output.stage_index >= resumed_at") if fresh else each
    return each.select(F.element_at(F.array(*map(F.lit, ids)), F.col("output.stage_index") + 1).alias("prefix_id"), "item_id", "sha256", "output").distinct()


def snapshot_id(stages: list[tuple[str, dict]]) -> str:
    """The id of an ordered list of (extractor, configuration); whatever has it was extracted alike."""
    return hashlib.sha256(json.dumps(stages, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def reuse(items: DataFrame, stored: DataFrame, snapshot: str, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(item_id, sha256, text_out, reused): results of a snapshot that exist, and those of ``extract`` for other items.

    items: (item_id, sha256 of the content, ...); stored: (snapshot_id, item_id, sha256, text_out), of any snapshots. What
    was extracted under another configuration, or from another content, isn't taken; an item whose extraction gave
    null is not extracted again. ``extract`` gets the missing items with all their columns and adds text_out.
    Rows that repeat an item come back once for each content.
    """
    mine = stored.where(F.col("snapshot_id") == snapshot).groupBy("item_id", "sha256").agg(F.max("text_out").alias("text_out"))
    missing = items.dropDuplicates(["item_id", "sha256"]).join(mine, ["item_id", "sha256"], "left_anti")
    kept = mine.join(items.select("item_id", "sha256"), ["item_id", "sha256"], "left_semi").select("item_id", "sha256", "text_out", F.lit(True).alias("reused"))
    return kept.unionByName(extract(missing).select("item_id", "sha256", "text_out", F.lit(False).alias("reused")))


def counters(extracted: DataFrame) -> DataFrame:
    done = F.col("final_stage").isNotNull()
    return extracted.agg(F.count("*").alias("items"), F.count_if(done).alias("extracted"), F.count_if(~done).alias("skipped"), F.count_if(done & (T.blank(F.col("text_out")))).alias("empty"))


def given() -> Column:
    """Outputs so far that have a text."""
    return F.filter("outputs", lambda o: o.text.isNotNull())


def _first(outputs: Column) -> Column:
    return F.get(outputs, F.lit(0)).text


def _last(outputs: Column) -> Column:
    return F.when(F.size(outputs) > 0, F.element_at(outputs, -1).text)


def pass_through() -> Column:
    """Text items as they are, Markdown without front matter, others not."""
    return F.when(F.col("media_type") == "text/markdown", front_matter(F.col("text")).body).when(F.col("media_type").startswith("text/"), F.col("text"))


def metadata_text() -> Column:
    """The title, then "tags: a, b"; null without both."""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("tags: "), F.array_join("tags", ", ")))
    return F.nullif(F.concat_ws("\n", F.nullif(T.strip(F.col("title")), F.lit("")), tags), F.lit(""))


def select_first() -> Column:
    """The first output that isn't blank, else the first."""
    return F.coalesce(_first(F.filter(given(), lambda o: ~T.blank(o.text))), _first(given()))


def select_longest() -> Column:
    """The longest output by trimmed length, ties to the earliest stage."""
    best = F.array_max(F.transform(given(), lambda o: F.struct(F.length(T.strip(o.text)).alias("n"), (-o.stage_index).alias("i"), o.text.alias("text"))))
    return best.text


def select_override(patterns: tuple[str, ...], fallback_to_first: bool) -> Column:
    """The last output; with the fallback, the first one for other media types."""
    return F.when(_matches(patterns) | F.lit(not fallback_to_first), _last(given())).otherwise(_first(given()))


def select_smart(patterns: tuple[str, ...], least_length: int, least_confidence: float) -> Column:
    """For matching media types the last output if it means something, else the surest earlier one that does (the
    first of equals), else the last; for others the last."""
    good = lambda o: (F.length(T.strip(o.text)) >= least_length) & (o.confidence.isNull() | (o.confidence >= least_confidence))
    all_ = given()
    earlier = F.filter(F.slice(all_, 1, F.greatest(F.size(all_) - 1, F.lit(0))), good)
    best = F.array_max(F.transform(earlier, lambda o: F.struct(F.coalesce(o.confidence, F.lit(0.0)).alias("c"), (-o.stage_index).alias("i"), o.text.alias("text"))))
    last_good = F.size(F.filter(F.slice(all_, F.greatest(F.size(all_), F.lit(1)), 1), good)) > 0
    return F.when(~_matches(patterns) | last_good, _last(all_)).otherwise(F.coalesce(best.text, _last(all_)))


def _matches(patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.col("media_type").rlike(glob_regex(p))
    return out


def join_confident(words: Column, least: float, glue: str = " ") -> Column:
    """(text, confidence) of recognised words (text, confidence): those sure enough, joined, and their mean."""
    kept = F.filter(words, lambda w: (w.confidence >= least) & (~T.blank(w.text)))
    mean = F.aggregate(kept, F.lit(0.0), lambda a, w: a + w.confidence) / F.size(kept)
    return F.struct(F.array_join(F.transform(kept, lambda w: w.text), glue).alias("text"), F.when(F.size(kept) > 0, mean).alias("confidence"))


def layout_text(regions: Column, least: float, glue: str = " ") -> Column:
    """(text, confidence, regions_processed, regions_with_text) of a page's regions (order, bbox, words (text, confidence)).

    Regions are read by their order, those without one as 999th, equals as they stand; one without four numbers of
    a box isn't read. Each one's sure words are joined, regions with some by a blank line; confidence is the mean of all sure words.
    """
    boxed = F.filter(F.transform(regions, lambda r, i: F.struct(F.coalesce(r.order, F.lit(999)).alias("o"), i.alias("i"), r.bbox.alias("b"), r.words.alias("w"))), lambda r: F.size(r.b) == 4)
    words = F.transform(F.array_sort(boxed), lambda r: F.filter(r.w, lambda w: (w.confidence >= least) & (~T.blank(w.text))))

    def page(read: Column) -> Column:
        text = F.array_join(F.transform(read, lambda ws: F.array_join(ws.text, glue)), "\n\n")
        sure = F.flatten(F.transform(read, lambda ws: ws.confidence))
        mean = F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, c: a + c) / F.size(sure))
        return F.struct(text.alias("text"), mean.alias("confidence"), F.size(regions).alias("regions_processed"), F.size(read).alias("regions_with_text"))

    return T.let(F.filter(words, lambda ws: F.size(ws) > 0), page)


def transcript_text(payload: Column, channel: int | None = None, speaker: int | None = None) -> Column:
    """Utterances of a transcript's JSON as lines, prefixed by their speaker; filters keep one channel or speaker. Without
    utterances the transcript itself."""
    p = F.from_json(payload, "transcript string, utterances array<struct<speaker:int,channel:int,transcript:string>>")
    kept = p.utterances
    if channel is not None:
        kept = F.filter(kept, lambda u: u.channel == channel)
    if speaker is not None:
        kept = F.filter(kept, lambda u: u.speaker == speaker)
    lines = F.transform(kept, lambda u: F.concat(F.lit("Speaker "), u.speaker, F.lit(": "), T.strip(u.transcript)))
    return F.when(F.size(F.coalesce(p.utterances, F.array())) > 0, F.array_join(lines, "\n")).otherwise(T.strip(p.transcript))
