"""Graphs of conversations and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.lineage import scratch
from ..operators.store import GraphStore
from .registry import query, table


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), "text")


_CO = """WITH t AS (SELECT conv_id * 1000 + turn AS item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations),
i AS (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM t), u AS (SELECT item_id, i, unnest(list_distinct(w[i : i + 3])) AS x FROM i)
SELECT a.item_id, a.x AS a, b.x AS b, count(*) AS n FROM u a JOIN u b ON a.item_id = b.item_id AND a.i = b.i AND a.x < b.x GROUP BY ALL"""


@query(_CO)
def gr_cooc(spark: SparkSession, d: str) -> DataFrame:
    return G.cooccurrences(_turns(spark, d))


@query(f"SELECT * FROM ({_CO}) WHERE n >= 3")
def agg_cooc(spark: SparkSession, d: str) -> DataFrame:
    return G.cooccurrences(_turns(spark, d), least=3)


#: Letters beyond ASCII count as words' characters but match nothing, so word boundaries fall where they do in Unicode.
_ENTITIES = r"""t AS (SELECT doc_id AS item_id, unnest(regexp_split_to_array(regexp_replace(text, '[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C1}\x{370}-\x{1FFF}\x{2C00}-\x{D7FF}]', '_', 'g'), '[.!?]+')) AS s FROM documents),
m AS (SELECT item_id, list_distinct([x for x in list_concat(regexp_extract_all(s, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}\b'), regexp_extract_all(s, '\b[A-Z]{2,}\b')) if length(x) >= 3]) AS es FROM t)"""
_CANONICAL = "coalesce(nullif(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), lower({0}))"
_RELATIONS = f"""WITH {_ENTITIES}, u AS (SELECT item_id, row_number() OVER () AS i, list_distinct([{_CANONICAL.format('x')} for x in es]) AS es FROM m),
e AS (SELECT item_id, i, unnest(es) AS x FROM u) SELECT a.item_id, a.x AS a, b.x AS b, count(*) AS n FROM e a JOIN e b ON a.i = b.i AND a.x < b.x GROUP BY ALL"""


@query(f"WITH {_ENTITIES}, e AS (SELECT item_id, unnest(es) AS label FROM m) SELECT item_id, label, count(*) AS n, {_CANONICAL.format('label')} AS entity FROM e GROUP BY item_id, label")
def agg_mentions(spark: SparkSession, d: str) -> DataFrame:
    return G.mentions(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text"))


@query(_RELATIONS)
def gr_simple(spark: SparkSession, d: str) -> DataFrame:
    return G.relations(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text"))


@query(f"""WITH {_ENTITIES}, l AS (SELECT DISTINCT item_id, {_CANONICAL.format('x')} AS x FROM (SELECT item_id, unnest(es) AS x FROM m)),
r AS (SELECT count(*) AS n FROM ({_RELATIONS})), z AS (SELECT count(*) AS items, count(*) FILTER (doc_id % 7 = 0 OR trim(text) = '') AS skipped FROM documents)
SELECT items, skipped, (SELECT count(*) FROM l WHERE item_id % 7 <> 0) + items - skipped AS nodes, (SELECT count(*) FROM l WHERE item_id % 7 <> 0) + (SELECT count(*) FROM ({_RELATIONS}) WHERE item_id % 7 <> 0) AS edges FROM z""")
def gr_build(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh document has no text yet, so it is skipped and counted."""
    text = F.when(F.col("doc_id") % 7 != 0, F.col("text"))
    return G.build(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), text.alias("text")))[2]


_NODES = "n AS (SELECT source AS node_id, max(doc_id) AS version FROM documents GROUP BY source)"


@query(f"WITH {_NODES}, e AS (SELECT source || '>' || 'src' || n_chars % 40 AS edge_id, source AS src, 'src' || n_chars % 40 AS dst, doc_id AS version FROM documents), l AS (SELECT edge_id, src, dst, max(version) AS version FROM e GROUP BY ALL) SELECT * FROM l WHERE src IN (SELECT node_id FROM n) AND dst IN (SELECT node_id FROM n)", "sink_graph")
def sink_graph(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    dst = F.concat(F.lit("src"), F.col("n_chars") % 40)
    nodes = docs.select(F.col("source").alias("node_id"), F.col("doc_id").alias("version"))
    edges = docs.select(F.concat("source", F.lit(">"), dst).alias("edge_id"), F.col("source").alias("src"), dst.alias("dst"), F.col("doc_id").alias("version"))
    return G.upsert(nodes, edges)[1].select("edge_id", "src", "dst", "version")


_MERGED = """WITH d AS (SELECT doc_id, source AS n, 'src' || n_chars % 40 AS m, lang AS item, doc_id IN (SELECT doc_id FROM labels) AS a, doc_id % 3 = 0 AS b FROM documents),
n1 AS (SELECT item, n, max(doc_id) AS v FROM d WHERE a GROUP BY ALL), n2 AS (SELECT item, n, max(doc_id) AS v FROM d WHERE b GROUP BY ALL), n AS (SELECT item, n FROM n1 UNION SELECT item, n FROM n2),
e1 AS (SELECT item, n, m, max(doc_id) AS v FROM d WHERE a AND (item, m) IN (SELECT (item, n) FROM n1) GROUP BY ALL), e2 AS (SELECT item, n, m, max(doc_id) AS v FROM d WHERE b AND (item, m) IN (SELECT (item, n) FROM n) GROUP BY ALL)
SELECT item AS item_id, n AS id, coalesce(n2.v, n1.v)::DOUBLE AS value FROM n1 FULL JOIN n2 USING (item, n) UNION ALL SELECT item, n || '>' || m, coalesce(e2.v, e1.v)::DOUBLE FROM e1 FULL JOIN e2 USING (item, n, m)"""


@query(_MERGED)
def sink_graph_store(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents' nodes and edges, and then every third document's, in a graph that is kept; the latter merge twice."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("src"), F.col("n_chars") % 40).alias("dst"), F.lit("g").alias("graph_id"), F.lit("s").alias("snapshot_id"), F.col("lang").alias("item_id"))
    padded = F.lpad(F.col("doc_id").cast("string"), 20, "0")
    store = GraphStore(spark, scratch(spark), 16)
    labelled, third = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi"), docs.where("doc_id % 3 = 0")
    for part in (labelled, third, third):
        key = ["graph_id", "snapshot_id", "item_id"]
        store.merge(part.select(*key, F.col("source").alias("node_id"), padded.alias("label")), part.select(*key, F.concat("source", F.lit(">"), "dst").alias("edge_id"), F.col("source").alias("src"), "dst", F.col("doc_id").cast("double").alias("weight")))
    nodes = store.nodes().select("item_id", F.col("node_id").alias("id"), F.col("label").cast("double").alias("value"))
    return nodes.unionByName(store.edges().select("item_id", F.col("edge_id").alias("id"), F.col("weight").alias("value")))
