"""Span markup: parsing, stripping, validation and slices."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from . import text as T

TAG = re.compile(r"<span((?:\s+[\w-]+=\"[^\"]*\")*)\s*>|</span>")
#: Whatever begins as a span's tag does, and an attribute in it.
ANY_TAG = re.compile(r"<span\b[^>]*>|</span>")
ATTRIBUTE = re.compile(r"([A-Za-z_][A-Za-z0-9_-]*)=\"([^\"]*)\"")
SPAN = StructType([StructField("index", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("text", StringType()), StructField("attributes", MapType(StringType(), StringType()))])


def strict_attributes(tag: str) -> dict[str, str]:
    """A tag's attributes; one that comes twice, or anything else in the tag, is an error. Quotes may be escaped."""
    inner = tag[len("<span") : -1].replace('\\"', '"')
    found = ATTRIBUTE.findall(inner)
    if len(dict(found)) < len(found):
        raise ValueError("spans must not have an attribute twice")
    if ATTRIBUTE.sub("", inner).strip():
        raise ValueError("span tags must hold nothing but attributes")
    return dict(found)


def parse(marked: str, strict: bool = False) -> list[dict]:
    """Spans with offsets in the text without tags; a span in a span, or a lone end, is an error. A tag that isn't well
    formed is text, or an error if ``strict``."""
    out, plain, at, open_ = [], "", 0, None
    for m in (ANY_TAG if strict else TAG).finditer(marked):
        plain += marked[at : m.start()]
        at = m.end()
        if m.group().startswith("</"):
            if open_ is None:
                raise ValueError("span end without start")
            out.append({"index": len(out) + 1, "start": open_[0], "end": len(plain), "text": plain[open_[0] :], "attributes": open_[1]})
            open_ = None
        elif open_ is not None:
            raise ValueError("spans must not be nested")
        else:
            open_ = (len(plain), strict_attributes(m.group()) if strict else dict(re.findall(r"([\w-]+)=\"([^\"]*)\"", m.group(1))))
    if open_ is not None:
        raise ValueError("span without end")
    return out


@F.udf(ArrayType(SPAN), useArrow=False)
def parse_spans(marked: str | None) -> list[dict] | None:
    """``parse`` of each text, a hundred rows at a time: an Arrow batch of ten thousand and its spans would lie in memory."""
    return None if marked is None else parse(marked)


@F.udf(StructType([StructField("spans", ArrayType(SPAN)), StructField("error", StringType())]), useArrow=False)
def read_spans(marked: str | None) -> tuple[list[dict] | None, str | None] | None:
    """Spans of each text by the strict ``parse``, or why it has none; null for null."""
    if marked is None:
        return None
    try:
        return parse(marked, strict=True), None
    except ValueError as e:
        return None, str(e)


def span_values(label: str | None) -> Callable[[Column], Column]:
    """(text, value) of the spans of short texts, ``value`` being their attribute ``label``; null texts have none."""

    @F.arrow_udf("array<struct<text:string,value:string>>")
    def read(marked: pa.Array) -> pa.Array:
        ends, texts, values = [0], [], []
        for m in marked.to_pylist():
            for s in parse(m) if m is not None else ():
                texts.append(s["text"])
                values.append(s["attributes"].get(label))
            ends.append(len(texts))
        spans = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(values, pa.string())], ["text", "value"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)

    return read


def strip_tags(marked: Column) -> Column:
    return F.regexp_replace(marked, r'<span(?:\s+[\w-]+="[^"]*")*\s*>|</span>', "")


def slices(marked: Column) -> Column:
    """Text between ``<slice/>`` marks, trimmed, blank ones gone."""
    return F.filter(F.transform(F.split(marked, r"<slice\s*/>"), T.strip), lambda s: s != "")


def annotation_errors(marked: Column, allowed: tuple[str, ...]) -> Column:
    """Errors (index, error) of marked texts whose spans need exactly one attribute, of an allowed name, that isn't empty.

    A span with a wrong name and an empty value has two errors; its text doesn't matter. A text whose markup can't be read
    has one, without an index. Null for null.
    """
    read = read_spans(marked)
    error = lambda index, *parts: F.struct(index.alias("index"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("error"))
    names = f"Allowed attributes: {', '.join(allowed)}"

    def found(s: Column) -> Column:
        i, n = s["index"], F.size(F.map_keys(s.attributes))
        name, value = F.get(F.map_keys(s.attributes), F.lit(0)), F.get(F.map_values(s.attributes), F.lit(0))
        wrong = F.when(n == 0, error(i, "the span has no attribute. ", names)).when(n > 1, error(i, "the span has more than one attribute")).when(~name.isin(*allowed), error(i, "the span has the attribute '", name, "'. ", names))
        return F.filter(F.array(wrong, F.when((n == 1) & T.blank(value), error(i, "the span's attribute '", name, "' is empty"))), lambda e: e.isNotNull())

    return F.when(read.error.isNotNull(), F.array(error(F.lit(None).cast("int"), read.error))).otherwise(F.flatten(F.transform(read.spans, found)))


def redaction_errors(spans: Column, types: tuple[str, ...]) -> Column:
    """Spans have one attribute at most, ``redact`` of an allowed type if there are types, else none."""
    value = lambda s: F.element_at(s.attributes, "redact")
    bad = (lambda s: (F.size(F.map_keys(s.attributes)) != 1) | value(s).isNull() | ~value(s).isin(*types)) if types else (lambda s: F.size(F.map_keys(s.attributes)) > 0)
    return F.transform(F.filter(spans, bad), lambda s: s["index"])


def link_errors(spans: Column, prefix: str = "link_") -> Column:
    """Index of spans that have not one of id and ref, an id without the prefix or seen before, or a ref to no id before
    it or to one of another text."""
    a = lambda s, k: F.element_at(s.attributes, k)
    before = lambda s, key: F.filter(spans, lambda o: (o["index"] < s["index"]) & (a(o, "id") == key))

    def bad(s: Column) -> Column:
        id_, ref = a(s, "id"), a(s, "ref")
        met = before(s, ref)
        return (id_.isNotNull() == ref.isNotNull()) | F.coalesce(~id_.startswith(prefix) | (F.size(before(s, id_)) > 0), F.lit(False)) | F.coalesce((F.size(met) == 0) | F.exists(met, lambda o: F.lower(o.text) != F.lower(s.text)), F.lit(False)) & ref.isNotNull()

    return F.transform(F.filter(spans, bad), lambda s: s["index"])


def covered(spans: Column, start: Column, end: Column) -> Column:
    """Whether any span overlaps [start, end)."""
    return F.exists(spans, lambda s: (s.start < end) & (s.end > start))


@F.pandas_udf(ArrayType(SPAN))
def filled_links(text: pd.Series, spans: pd.Series) -> pd.Series:
    """``fill_links`` of every text and its spans; null where either is."""
    return pd.Series([None if t is None or s is None else fill_links(t, [dict(x, attributes=dict(x["attributes"])) for x in s]) for t, s in zip(text, spans, strict=True)])


def promote_refs(spans: list[dict], prefix: str = "link_") -> list[dict]:
    """Spans where the first ref of a text of which no span has an id is an id, if it begins with the prefix."""
    named = {s["text"] for s in spans if "id" in s["attributes"]}
    first = {}
    for s in sorted((s for s in spans if "ref" in s["attributes"]), key=lambda s: (s["start"], s["end"])):
        first.setdefault(s["text"], s)
    new = [s for text, s in first.items() if text not in named and s["attributes"]["ref"].startswith(prefix)]
    return [dict(s, attributes={"id": s["attributes"]["ref"]}) if any(s is x for x in new) else s for s in spans]


def fill_links(text: str, found: list[dict], prefix: str = "link_") -> list[dict]:
    """Links with a ref at every other place of an id's text that no span covers, inside words too, after ``promote_refs``.

    Spans are taken as they stand; places of a text are found from its start on, without overlaps, whether or not the
    first of them is the span itself. Indexes count anew by place.
    """
    out = promote_refs(found, prefix)
    taken = sorted((s["start"], s["end"]) for s in out)  # spans don't overlap
    for s in [s for s in out if s["attributes"].get("id") and s["text"]]:
        at = text.find(s["text"])
        while at >= 0:
            end = at + len(s["text"])
            i = bisect_left(taken, (at, at))
            if not (i < len(taken) and taken[i][0] < end or i and taken[i - 1][1] > at):
                out.append({"index": 0, "start": at, "end": end, "text": s["text"], "attributes": {"ref": s["attributes"]["id"]}})
                taken.insert(i, (at, end))
            at = text.find(s["text"], end)
    out.sort(key=lambda s: (s["start"], s["end"]))
    return [dict(s, index=i) for i, s in enumerate(out, 1)]
