"""Edits of texts: replacements that must fit one place, applied in order."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import fold_groups
from .lineage import cut

MARKUP = re.compile(r"<span\b[^>]*>|</span>|<slice\s*/>")


def refused(text: str, old: str | None, new: str | None, insert_only: bool = True) -> str | None:
    """Why a replacement can't be applied to a text; null if it can."""
    if not old or not new:
        return "old_str and new_str must not be empty"
    if old == new:
        return "the replacement changes nothing"
    found = text.count(old)
    if found != 1:
        return f"old_str must match exactly once (found {found} matches)"
    if insert_only and MARKUP.sub("", old) != MARKUP.sub("", new):
        return "replacements may only insert markup"
    return None


def apply_edits(texts: DataFrame, edits: DataFrame, insert_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(texts, errors) of texts (doc_id, text) and edits (doc_id, seq, old_str, new_str).

    A document's edits are applied in order of seq, each to what those before it have made. One whose old_str doesn't
    stand in the text exactly once, that changes nothing, or, with ``insert_only``, that changes more than span and slice
    tags, is refused: the text stays as it is, never a wrong one, and the next edit goes on. texts: (doc_id, text, applied,
    refused, last_error), a row for each document; last_error is null if its last edit was applied. errors: (doc_id, seq,
    error) of all refused edits, and of edits to documents that there are not. A null text is empty, rows without doc_id
    are left out, those that repeat one count once (the largest text); edits of equal seq come by old_str and new_str.

    Texts and edits are dealt by document and streamed in order; a task holds one text at a time, not its edits.
    """
    own = texts.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    null = F.lit(None)
    rows = own.select("doc_id", F.lit(0).alias("part"), null.cast("long").alias("seq"), "text", null.cast("string").alias("old_str"), null.cast("string").alias("new_str"))
    rows = rows.unionByName(edits.where("doc_id is not null").select("doc_id", F.lit(1).alias("part"), F.col("seq").cast("long").alias("seq"), null.cast("string").alias("text"), "old_str", "new_str"))

    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        if row["part"] == 0:
            return state | {"text": row["text"]}, []
        error = refused(state["text"], row["old_str"], row["new_str"], insert_only) if state["text"] is not None else "there is no such document"
        if error is None:
            return state | {"text": state["text"].replace(row["old_str"], row["new_str"]), "applied": state["applied"] + 1, "last_error": None}, []
        return state | {"refused": state["refused"] + 1, "last_error": error}, [{"doc_id": row["doc_id"], "seq": row["seq"], "error": error}]

    def end(doc_id: object, state: dict) -> list[dict]:
        return [] if state["text"] is None else [{"doc_id": doc_id, "whole": True, **state}]

    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, seq long, error string, whole boolean, text string, applied int, refused int, last_error string"
    done = cut(fold_groups(rows, "doc_id", ["part", "seq", "old_str", "new_str"], lambda: {"text": None, "applied": 0, "refused": 0, "last_error": None}, step, end, schema))
    return done.where("whole").select("doc_id", "text", "applied", "refused", "last_error"), done.where("whole is null").select("doc_id", "seq", "error")
