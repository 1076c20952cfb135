"""Profiling, sequences and topics over whole tables, with their SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analyse as A
from ..operators import chunk as C
from ..operators import density as D
from ..operators import markov as H
from .registry import query, table

_ITEMS = "(SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'text/markdown' ELSE 'text/plain' END AS media_type, CASE WHEN doc_id % 4 = 0 THEN [] ELSE [lang, 'q' || n_chars % 7] END AS tags FROM documents)"


def items(spark: SparkSession, d: str) -> DataFrame:
    tags = F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", F.concat(F.lit("q"), F.col("n_chars") % 7)))
    return table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "text/markdown").otherwise("text/plain").alias("media_type"), tags.alias("tags"))


@query(f"SELECT media_type, count(*) AS n FROM {_ITEMS} GROUP BY ALL")
def agg_media(spark: SparkSession, d: str) -> DataFrame:
    return A.media_counts(items(spark, d))


@query("SELECT count(*) AS n, min(n_chars)::DOUBLE AS min, max(n_chars)::DOUBLE AS max, round(avg(n_chars), 9) AS mean, quantile_disc(n_chars, 0.5)::DOUBLE AS p50, quantile_disc(n_chars, 0.9)::DOUBLE AS p90, quantile_disc(n_chars, 0.99)::DOUBLE AS p99 FROM documents")
def agg_dist(spark: SparkSession, d: str) -> DataFrame:
    return A.distribution(table(spark, d, "documents"), "n_chars", (50, 90, 99))


@query(f"SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM {_ITEMS}) GROUP BY tag ORDER BY n DESC, tag LIMIT 10")
def agg_tags(spark: SparkSession, d: str) -> DataFrame:
    return A.tag_report(items(spark, d), 10)[1]


@query(f"SELECT count(*) FILTER (len(tags) > 0) AS tagged, count(*) FILTER (len(tags) = 0) AS untagged, (SELECT count(DISTINCT tag) FROM (SELECT unnest(tags) AS tag FROM {_ITEMS})) AS unique_tags FROM {_ITEMS}")
def an_profile(spark: SparkSession, d: str) -> DataFrame:
    return A.tag_report(items(spark, d), 10)[0]


@query("SELECT count(*) AS source, count(*) FILTER (length(trim(text)) >= 200) AS nonempty, count(*) FILTER (length(trim(text)) < 200) AS empty, count(*) FILTER (text IS NULL) AS missing FROM documents")
def agg_textrep(spark: SparkSession, d: str) -> DataFrame:
    return A.text_report(table(spark, d, "documents"), 200)


@query(f"SELECT doc_id FROM {_ITEMS} WHERE list_contains(tags, 'en')")
def f_tags(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).where(F.array_contains("tags", "en")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE trim(text) <> '' AND length(trim(text)) >= 100", "f_nonblank")
def f_nonblank(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("trim(text) <> '' and length(trim(text)) >= 100").select("doc_id")


@query("SELECT w AS term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) GROUP BY w", "agg_df")
def agg_df(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import retrieve as R

    tf = R.term_frequencies(table(spark, d, "documents"), "doc_id")
    return tf.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


_SEG = "(SELECT conv_id AS seq, turn + 1 AS idx, text, role AS state FROM conversations)"


def segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("seq"), (F.col("turn") + 1).alias("idx"), "text", F.col("role").alias("state"))


@query(f"""WITH t AS (SELECT seq * 1000 + idx AS key, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM {_SEG}),
g AS (SELECT key, unnest(ws) AS term FROM t UNION ALL SELECT key, unnest([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) FROM t),
f AS (SELECT key, term, count(*) AS tf FROM g GROUP BY ALL), v AS (SELECT term, count(*) AS df FROM f GROUP BY term ORDER BY df DESC, term LIMIT 200),
k AS (SELECT f.*, df, sum(tf) OVER (PARTITION BY key) AS l FROM f JOIN v USING (term))
SELECT key, term, round(tf / l * ((SELECT count(*) FROM conversations) + 1) / (df + 1), 9) AS value FROM k""")
def mk_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return A.tfidf(segments(spark, d).select((F.col("seq") * 1000 + F.col("idx")).alias("key"), "text"), 200)


@query(f"WITH s AS (SELECT state AS prev, lead(state) OVER (ORDER BY seq, idx) AS next FROM {_SEG}), c AS (SELECT prev, next, count(*) AS n FROM s WHERE next IS NOT NULL GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY prev), 9) AS p FROM c")
def agg_trans(spark: SparkSession, d: str) -> DataFrame:
    return A.transitions(segments(spark, d), None)


@query(f"SELECT seq, array_to_string(list(state ORDER BY idx), '>') AS path FROM {_SEG} GROUP BY seq")
def agg_paths(spark: SparkSession, d: str) -> DataFrame:
    return A.paths_of(segments(spark, d)).select("seq", F.array_join("path", ">").alias("path"))


_B = f"b AS (SELECT seq, idx + 1 AS idx, text, state FROM {_SEG} UNION ALL SELECT seq, 1, 'START', 'START' FROM {_SEG} GROUP BY seq UNION ALL SELECT seq, max(idx) + 2, 'END', 'END' FROM {_SEG} GROUP BY seq)"


@query(f"WITH {_B} SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY idx)::INTEGER AS idx, md5(text) AS digest FROM b")
def w_bound(spark: SparkSession, d: str) -> DataFrame:
    return A.with_boundaries(segments(spark, d)).select("seq", "idx", F.md5("text").alias("digest"))


@query(f"SELECT seq, count(*) AS n FROM {_SEG} GROUP BY seq")
def w_len(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).groupBy("seq").agg(F.count("*").alias("n"))


@query(f"""WITH {_B}, r AS (SELECT seq, state, lag(state) OVER w AS p, lead(state) OVER w AS n, row_number() OVER w - 1 AS a, count(*) OVER (PARTITION BY seq) AS z FROM b WINDOW w AS (PARTITION BY seq ORDER BY idx)),
c AS (SELECT state, count(*) FILTER (p = 'START') AS s, count(*) FILTER (n = 'END') AS e, avg(a / (z - 1)) FILTER (state NOT IN ('START', 'END')) AS q FROM r GROUP BY state)
SELECT state, round(s / (SELECT sum(s) FROM c), 9) AS after_start, round(e / (SELECT sum(e) FROM c), 9) AS before_end, round(coalesce(q, 0), 9) AS position FROM c WHERE s > 0 OR e > 0 OR q IS NOT NULL""")
def agg_pos(spark: SparkSession, d: str) -> DataFrame:
    named = A.with_boundaries(segments(spark, d).withColumn("text", F.col("state"))).withColumnRenamed("text", "state")
    return A.state_positions(named, F.lit("START"), F.lit("END"))


@query(f"WITH s AS (SELECT *, 'L' || length(text) % 3 AS label, row_number() OVER (PARTITION BY state ORDER BY seq, idx) AS i FROM {_SEG}), l AS (SELECT state, label, count(*) AS m, min(i) AS f FROM s GROUP BY ALL) SELECT state, sum(m)::BIGINT AS n, arg_max(label, m * 1000000 - f) AS label, (SELECT md5(string_agg(text, '|' ORDER BY i)) FROM s WHERE s.state = l.state AND i <= 3) AS examples FROM l GROUP BY state")
def agg_states(spark: SparkSession, d: str) -> DataFrame:
    labelled = segments(spark, d).withColumn("label", F.concat(F.lit("L"), F.length("text") % 3))
    return A.state_report(labelled, 3).select("state", "n", "label", F.md5(F.array_join("examples", "|")).alias("examples"))


@query("SELECT role, (dense_rank() OVER (ORDER BY role) - 1)::INTEGER AS code FROM conversations GROUP BY role", "mk_enc")
def mk_enc(spark: SparkSession, d: str) -> DataFrame:
    return A.codes(table(spark, d, "conversations"), "role")


@query("""WITH s AS (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 300 THEN 1 ELSE ceil((length(text) - 300) / 250.0)::BIGINT + 1 END)) * 250 AS a FROM documents),
c AS (SELECT doc_id, a, trim(text[a + 1 : least(a + 300, length(text))], ' ' || chr(10)) AS text FROM s)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a)::INTEGER AS idx, text FROM c WHERE text <> ''""")
def mk_seg_window(spark: SparkSession, d: str) -> DataFrame:
    windows = C.char_windows(F.col("text"), 300, 50)
    return table(spark, d, "documents").select("doc_id", F.posexplode(windows).alias("i", "c")).select("doc_id", (F.col("i") + 1).alias("idx"), T.strip(F.col("c.text")).alias("text"))


@query("""WITH s AS (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 400 THEN 1 ELSE ceil((length(text) - 400) / 300.0)::BIGINT + 1 END)) * 300 AS a FROM documents),
c AS (SELECT doc_id, a, string_split(text[a + 1 : least(a + 400, length(text))], chr(10)) AS ls FROM s), l AS (SELECT doc_id, a, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM c),
n AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a, i))::INTEGER AS idx, (CASE WHEN i % 2 = 0 THEN 'even' ELSE 'odd' END || chr(10) || trim(line, ' ' || chr(9) || chr(13))) AS t FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
g AS (SELECT doc_id, list([{'t': t, 'i': idx}] ORDER BY idx) AS g FROM n GROUP BY doc_id),
m AS (SELECT doc_id, list_reduce(g, lambda a, x: CASE WHEN contains(a[len(a)].t, x[1].t) THEN a WHEN contains(x[1].t, a[len(a)].t) THEN list_concat(a[1:len(a) - 1], x) ELSE list_concat(a, x) END) AS m FROM g),
o AS (SELECT doc_id, generate_subscripts(m, 1)::INTEGER AS nth, unnest(m) AS x FROM m) SELECT doc_id, nth, x.i AS idx, md5(x.t) AS digest FROM o""")
def mk_seg_span(spark: SparkSession, d: str) -> DataFrame:
    """Lines of overlapping chunks as spans labelled by their place in the chunk, stitched."""
    def mark(chunk: Column) -> Column:
        lines = F.transform(F.split(chunk, "\n"), lambda x, i: F.concat(F.when(i % 2 == 1, '<span kind="even">').otherwise('<span kind="odd">'), x, F.lit("</span>")))
        return F.array_join(lines, "\n")

    found = A.span_segments(table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.translate("text", "<>", "()").alias("text")), mark, 400, 100, "kind", prepend_label=True)
    return found.select(F.col("seq").alias("doc_id"), "nth", "idx", F.md5("text").alias("digest"))


@query()
def mk_fit(spark: SparkSession, d: str) -> DataFrame:
    symbols = segments(spark, d).select("seq", "idx", (F.length("text") % 5).cast("int").alias("symbol"))
    return A.decode_hmm(symbols, A.fit_hmm(symbols, 3, 5))


@query()
def mk_fit_gaussian(spark: SparkSession, d: str) -> DataFrame:
    """States of a document's lines, by length and share of spaces; of all lines of all documents."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    n = F.length("line")
    vector = H.column_vector(F.log1p(n), (n - F.length(F.replace("line", F.lit(" ")))) / F.greatest(n, F.lit(1)))
    return H.gaussian_paths(lines.select("seq", F.col("idx").cast("long").alias("idx"), vector.alias("vector")), 3, 5)[0]


@query(f"""WITH s AS (SELECT state AS prev, lead(state) OVER (ORDER BY seq, idx) AS next FROM {_SEG}), c AS (SELECT prev, next, count(*) AS n FROM s WHERE next IS NOT NULL GROUP BY ALL), e AS (SELECT prev, next, round(n / sum(n) OVER (PARTITION BY prev), 9) AS p FROM c)
SELECT 'digraph states {{' || chr(10) || string_agg(format('  "{{}}" -> "{{}}" [label="{{:.1f}}%"];', prev, next, 100 * p), chr(10) ORDER BY prev, next) || chr(10) || '}}' AS dot FROM e WHERE p >= 0.05 AND prev <> 'END'""")
def mk_dot(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(A.dot_graph(A.transitions(segments(spark, d), None), 0.05),)], "dot string")


@query(f"""WITH t AS (SELECT seq, list([text] ORDER BY idx) AS t FROM {_SEG} GROUP BY seq),
m AS (SELECT seq, list_reduce(t, lambda a, x: CASE WHEN contains(a[len(a)], x[1]) THEN a WHEN contains(x[1], a[len(a)]) THEN list_concat(a[1:len(a) - 1], x) ELSE list_concat(a, x) END) AS m FROM t)
SELECT seq, generate_subscripts(m, 1)::INTEGER AS idx, unnest(m) AS text FROM m""")
def set_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return A.merge_adjacent(segments(spark, d))


_TOPIC = r"""WITH f AS (SELECT topic, w AS term, count(*) AS tf FROM (SELECT lang AS topic, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) GROUP BY ALL),
s AS (SELECT topic, sum(tf) AS size FROM f GROUP BY topic), g AS (SELECT term, sum(tf) AS freq FROM f GROUP BY term),
c AS (SELECT topic, term, round(tf / size * ln(1 + (SELECT avg(size) FROM s) / freq), 9) AS score FROM f JOIN s USING (topic) JOIN g USING (term)),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term)::INTEGER AS rank FROM c) SELECT * FROM r WHERE rank <= 10"""


@query(_TOPIC)
def tm_keywords(spark: SparkSession, d: str) -> DataFrame:
    return A.topic_keywords(table(spark, d, "documents").select(F.col("lang").alias("topic"), "text"), 10)


@query(_TOPIC.replace("SELECT lang AS topic, unnest", "SELECT p % 3 AS topic, unnest").replace("lower(text)", "x").replace("FROM documents)", "FROM l WHERE length(x) >= 20)").replace("WITH f AS", r"""WITH p AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS p, unnest(ls) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE trim(text) <> '')),
l AS (SELECT doc_id, p, trim(regexp_replace(translate(lower(regexp_replace(t, '[A-Z]{2,}', '', 'g')), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\s+', ' ', 'g')) AS x FROM p), f AS""", 1).replace("SELECT * FROM r WHERE rank <= 10", ", z AS (SELECT p % 3 AS topic, count(*) AS n FROM l WHERE length(x) >= 20 GROUP BY ALL) SELECT topic::INTEGER AS topic, n, list(term ORDER BY rank)[1] AS label, array_to_string(list(term ORDER BY rank), ' ') AS keywords FROM r JOIN z USING (topic) WHERE rank <= 10 GROUP BY topic, n"))
def tm_run(spark: SparkSession, d: str) -> DataFrame:
    """Lines as texts, without words in capitals; topics are given by a line's place, so that SQL can say the same."""
    topics, _, _ = A.topic_run(
        table(spark, d, "documents").select("doc_id", "text"), lambda t: t.withColumn("topic", F.col("part") % 3), lambda t: F.split(t, "\n"), lambda t: F.regexp_replace(t, "[A-Z]{2,}", ""), least=20
    )
    return topics.select("topic", "n", "label", F.array_join("keywords", " ").alias("keywords"))


@query(f"SELECT state, CASE state WHEN 'user' THEN 'START' ELSE 'the ' || state || ' turn' END AS label FROM (SELECT DISTINCT state FROM {_SEG})")
def mk_name(spark: SparkSession, d: str) -> DataFrame:
    """Names by a stand-in that first gives all states one name, and is asked again."""
    said = F.when((F.col("state") == "user") & (F.col("idx") == 1), "START").otherwise(F.col("text"))
    report = A.state_report(segments(spark, d).withColumn("text", said).withColumn("label", F.lit("x")), 3)

    def ask(prompt: str) -> str:
        states = re.findall(r"^(\w+): ", prompt, re.M)
        return json.dumps({s: f"the {s} turn" if "given twice" in prompt or len(states) == 1 else "same" for s in states})

    return A.name_states(report, ask)


@query()
def tm_cluster(spark: SparkSession, d: str) -> DataFrame:
    return A.cluster_topics(table(spark, d, "documents"), 6).select("doc_id", "topic")


@query()
def tm_density(spark: SparkSession, d: str) -> DataFrame:
    """Documents on the three main components of their hashed words; topics by density, -1 for documents in none."""
    found = D.density_clusters(D.projected(table(spark, d, "documents").select("doc_id", "text")), 0.03, 5, 10)
    return found.select(F.col("id").alias("doc_id"), F.col("cluster").alias("topic"))
