"""Span markup over conversation turns, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as M
from ..operators.edit import apply_edits
from .registry import query, table


def marked(spark: SparkSession, d: str) -> DataFrame:
    """Every third word of a turn in a span."""
    words = F.transform(F.split("text", " "), lambda w, i: F.when(i % 3 == 2, F.concat(F.lit('<span kind="'), F.when(i % 2 == 0, "a").otherwise("b"), F.lit('">'), w, F.lit("</span>"))).otherwise(w))
    return table(spark, d, "conversations").select("conv_id", "turn", "text", F.array_join(words, " ").alias("marked"))


@query("SELECT conv_id, turn, text AS stripped FROM conversations")
def spans_strip(spark: SparkSession, d: str) -> DataFrame:
    return marked(spark, d).select("conv_id", "turn", M.strip_tags(F.col("marked")).alias("stripped"))


@query("SELECT conv_id, turn, (len(string_split(text, ' ')) // 3)::INTEGER AS n, true AS exact FROM conversations")
def spans_parse(spark: SparkSession, d: str) -> DataFrame:
    parsed = marked(spark, d).withColumn("s", M.parse_spans("marked"))
    return parsed.select("conv_id", "turn", F.size("s").alias("n"), F.forall("s", lambda s: F.substring(F.col("text"), s.start + 1, s.end - s.start) == s.text).alias("exact"))


@query("SELECT conv_id, turn, (SELECT count(*) FROM (SELECT unnest(range(2, len(string_split(text, ' ')), 3)) AS i) WHERE i % 2 = 1)::INTEGER AS refused FROM conversations", "spans_valid")
def spans_valid(spark: SparkSession, d: str) -> DataFrame:
    """Spans that the annotation rules refuse, as every second one has an attribute that isn't allowed. A turn without text
    has none; one whose own tags break the markup is refused as a whole, which counts once."""
    errors = M.annotation_errors(F.regexp_replace("marked", 'kind="b"', 'other="b"'), ("kind",))
    return marked(spark, d).select("conv_id", "turn", F.coalesce(F.size(F.array_distinct(errors["index"])), F.lit(0)).alias("refused"))


@query("SELECT conv_id, turn, len([x for x in string_split(text, chr(10)) if trim(x) <> ''])::INTEGER AS n FROM conversations", "spans_slice")
def spans_slice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(M.slices(F.replace("text", F.lit("\n"), F.lit("<slice/>")))).alias("n"))


@query("""WITH w AS (SELECT conv_id, turn, text, string_split(text, ' ')[1] AS k FROM conversations), v AS (SELECT *, (length(text) - length(replace(text, k, ''))) // length(k) AS n FROM w WHERE k <> '' AND NOT regexp_matches(k, '[<>"]') AND NOT contains(text, '<'))
SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 1 ELSE n END::INTEGER AS links, CASE WHEN turn % 4 = 3 THEN 1 ELSE n - 1 END::INTEGER AS refs FROM v""")
def link_fill(spark: SparkSession, d: str) -> DataFrame:
    """The first word of every turn as a link's ref without an id: it becomes the id, and its other places, also inside
    words, get refs; but not where the ref lacks the prefix."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text", F.get(F.split("text", " "), F.lit(0)).alias("k")).where((F.col("k") != "") & ~F.col("k").rlike('[<>"]') & ~F.contains("text", F.lit("<")))
    ref = F.when(F.col("turn") % 4 == 3, "other_1").otherwise("link_1")
    marked_ = F.concat(F.lit('<span ref="'), ref, F.lit('">'), "k", F.lit("</span>"), F.substr("text", F.length("k") + 1))
    links = turns.select("conv_id", "turn", M.filled_links(F.col("text"), M.parse_spans(marked_)).alias("s"))
    return links.select("conv_id", "turn", F.size("s").alias("links"), F.size(F.filter("s", lambda s: F.map_contains_key(s.attributes, F.lit("ref")))).alias("refs"))


_COUNT = "(length({0}) - length(replace({0}, {1}, ''))) // length({1})"


@query(f"""WITH w AS (SELECT conv_id, turn, text AS t0, string_split(text, ' ')[1] AS a, string_split(text, ' ')[-1] AS b FROM conversations),
x AS (SELECT *, CASE WHEN a = '' THEN 'empty' WHEN {_COUNT.format('t0', 'a')} = 1 THEN 'ok' ELSE 'many' END AS e1 FROM w), y AS (SELECT *, CASE WHEN e1 = 'ok' THEN replace(t0, a, '<span kind="a">' || a || '</span>') ELSE t0 END AS t1 FROM x),
z AS (SELECT *, CASE WHEN b = '' THEN 'empty' WHEN {_COUNT.format('t1', 'b')} = 1 THEN 'ok' ELSE 'many' END AS e2 FROM y), u AS (SELECT *, CASE WHEN e2 = 'ok' THEN replace(t1, b, b || '<slice/>') ELSE t1 END AS t2 FROM z)
SELECT conv_id * 1000 + turn AS doc_id, md5(t2) AS digest, ((e1 = 'ok')::INTEGER + (e2 = 'ok')::INTEGER) AS applied, (3 - (e1 = 'ok')::INTEGER - (e2 = 'ok')::INTEGER) AS refused,
  CASE WHEN b = '' THEN 'old_str and new_str must not be empty' WHEN {_COUNT.format('t2', 'b')} <> 1 THEN format('old_str must match exactly once (found {{}} matches)', {_COUNT.format('t2', 'b')}) ELSE 'replacements may only insert markup' END AS last_error FROM u""")
def tx_edits(spark: SparkSession, d: str) -> DataFrame:
    """A span around each turn's first word, a slice mark after its last, and a change of words, which is refused."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    a, b = F.element_at(F.split("text", " "), 1), F.element_at(F.split("text", " "), -1)
    made = [(a, F.concat(F.lit('<span kind="a">'), a, F.lit("</span>"))), (b, F.concat(b, F.lit("<slice/>"))), (b, F.concat(b, F.lit("!")))]
    edits = turns.select("doc_id", F.posexplode(F.array(*[F.struct(x.alias("old_str"), F.when(x == "", "").otherwise(y).alias("new_str")) for x, y in made])).alias("seq", "e")).select("doc_id", "seq", "e.*")
    return apply_edits(turns, edits)[0].select("doc_id", F.md5("text").alias("digest"), "applied", "refused", "last_error")


@query("SELECT conv_id, turn, len(w) > 2 AND length(w[1]) + length(w[2]) + 2 < 25 AS covered FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)")
def j_cover(spark: SparkSession, d: str) -> DataFrame:
    return marked(spark, d).select("conv_id", "turn", M.covered(M.parse_spans("marked"), F.lit(0), F.lit(25)).alias("covered"))
