"""License scan: ordered signature rules behind a keyword prefilter, overlaps settled by priority and containment."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import Rule, rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE = "array<struct<k:string,p:string,label:string,priority:int,base:boolean,i:int>>"


def normalised(text: Column) -> Column:
    """Words in lower case (A-Z only) with a space before, between and after them; one space if there are none."""
    words = F.trim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(words == "", " ").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _beginnings(words: list[str]) -> str:
    """A pattern of all ``words`` by common beginnings, so that few of them are tried at each place of a text."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    if "" in heads:  # a word ends here: whatever goes on is found too
        return ""
    tails = [re.escape(h) + _beginnings(own) for h, own in sorted(heads.items())]
    return tails[0] if len(tails) == 1 else f"(?:{'|'.join(tails)})"


def _spaces(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ' ', '')))"


#: Places of one rule in words: every match gets a mark, and the words that bear one are counted from the start.
_PLACES = f"""
zip_with(
  filter(transform(split(substring(regexp_replace(norm, r.p, '\\u0001$0'), 2), ' ', -1), (w, n) -> if(startswith(w, '\\u0001'), n, null)), n -> n is not null),
  regexp_extract_all(norm, r.p, 0),
  (n, hit) -> struct(n as a, n + 1 + {_spaces('hit')} as b))"""

_DETECTIONS = f"""
if(size(keys) = 0, cast(array() as array<struct<label:string,a:int,b:int,priority:int,base:boolean,i:int>>),
  flatten(transform(filter(rules, r -> array_contains(keys, r.k) and regexp_like(norm, r.p)),
    r -> transform({_PLACES}, s -> struct(r.label as label, s.a as a, s.b as b, r.priority as priority, r.base as base, r.i as i)))))"""

#: In this order whatever can cover a detection stands before it.
_SORTED = """
array_sort(found, (x, y) -> case when x.a <> y.a then x.a - y.a when x.b <> y.b then y.b - x.b when x.priority <> y.priority then y.priority - x.priority else x.i - y.i end)"""

#: How many places back that can be at most: a cover starts within the longest detection's length of it.
_BACK = """
case when size(found) <= 16 then size(found) {} else size(found) end""".format(
    "".join(f" when forall(sequence({k}, size(found) - 1), j -> found[j - {k}].a <= found[j].a - longest) then {k}" for k in (16, 64, 256, 1024, 4096))
)

#: A detection goes if another one covers it and has priority, or the same and more words, or stands earlier in order.
_KEPT = """
filter(found, (d, j) -> not exists(slice(found, greatest(1, j + 1 - back), least(j, back)), e -> e.b >= d.b and e.priority >= d.priority))"""


def license_scan(documents: DataFrame, own: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, found, kept) of documents (doc_id, text), by built-in functions alone.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. found are all detections of all
    rules as (label, a, b, priority, base, i): words a to b - 1, rule i. kept are those that no detection covers which
    has a higher priority, or the same and more words, or the same and an earlier rule; base rules are detections
    like others there. A rule is tried only on texts that hold its keyword, which begins a word of
    every match. Null texts are empty; every row comes
    back once, those without doc_id and repeated ones too. Nothing is shuffled or broadcast.
    """
    table = own if own is not None else rules()
    packed = json.dumps([{"k": r.keyword, "p": f"(?<= )(?:{r.pattern})(?= )", "label": r.label, "priority": r.priority, "base": r.base, "i": i} for i, r in enumerate(table)])
    words = sorted({r.keyword for r in table})
    none = F.array().cast("array<string>")
    held = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("norm"), w)) if words else none
    keys = F.when(F.col("norm").rlike(" " + _beginnings(words)), held).otherwise(none) if words else none
    steps = [
        lambda df: df.select(F.col("doc_id"), normalised(F.col("text")).alias("norm")),
        lambda df: df.withColumn("keys", keys),
        lambda df: df.withColumn("rules", F.from_json(F.lit(packed), RULE)),
        lambda df: df.withColumn("found", F.expr(_DETECTIONS)),
        lambda df: df.withColumn("found", F.expr(_SORTED)).withColumn("longest", F.expr("array_max(transform(found, d -> d.b - d.a))")),
        lambda df: df.withColumn("back", F.expr(_BACK)),
        lambda df: df.select("doc_id", F.expr(f"if(norm = ' ', 0, {_spaces('norm')} - 1)").cast("long").alias("n_words"), "found", F.expr(_KEPT).alias("kept")),
    ]
    return reduce(lambda df, step: step(df), steps, documents)


def license_report(documents: DataFrame, own: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): the scan, summed up by document.

    n_base counts the places of base rules, first_word and last_word are their first and last (null without any),
    base_labels and labels the distinct labels of base rules, and of those with the kept detections, sorted and
    joined by commas. score is 0 without a detection, else 0.5 and a tenth for each step of the best priority.
    """
    base = "filter(found, d -> d.base)"
    return license_scan(documents, own).select(
        "doc_id",
        "n_words",
        F.expr(f"cast(size({base}) as long)").alias("n_base"),
        F.expr(f"cast(array_min(transform({base}, d -> d.a)) as long)").alias("first_word"),
        F.expr(f"cast(array_max(transform({base}, d -> d.a)) as long)").alias("last_word"),
        F.expr(f"array_join(array_sort(array_distinct(transform({base}, d -> d.label))), ',')").alias("base_labels"),
        F.expr(f"array_join(array_sort(array_distinct(concat(transform({base}, d -> d.label), transform(kept, d -> d.label)))), ',')").alias("labels"),
        F.expr("if(size(kept) = 0, 0.0D, least(1.0D, 0.5D + array_max(transform(kept, d -> d.priority)) / 10.0D))").alias("score"),
    )
