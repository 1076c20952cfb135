"""Context packs of scan evidence, chat history and allocation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly as Y
from ..operators import context as X
from ..operators import rank as K
from ..operators import retrieve as R
from . import retrieval_queries as RQ
from .registry import query, table

_TOP = f"WITH {RQ._SCAN}, b AS (SELECT query_id, rank AS position, trim(text) AS block FROM r WHERE rank <= 30)"


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return R.retrieve(RQ._scanned(spark, d).select("query_id", "item_id", "score"), RQ.items(spark, d), K.QueryBudget(30), "scan")


@query(f"{_TOP} SELECT query_id, count(*) AS n_blocks, md5(string_agg(block, chr(10) || chr(10) ORDER BY position)) AS digest FROM b GROUP BY query_id")
def cp_build(spark: SparkSession, d: str) -> DataFrame:
    return X.join_blocks(X.blocks(_evidence(spark, d))).select("query_id", "n_blocks", F.md5("text").alias("digest"))


@query(f"WITH {RQ._SCAN} SELECT query_id, count(*) AS n_blocks, md5(string_agg('item_id: ' || item_id || chr(10) || 'source_uri: ' || source_uri || chr(10) || 'media_type: text/plain' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY source_uri, rank)) AS digest FROM r WHERE rank <= 30 GROUP BY query_id")
def cp_header(spark: SparkSession, d: str) -> DataFrame:
    head = X.metadata_header({c: F.col(c) for c in ("item_id", "source_uri", "media_type")})
    return X.join_blocks(X.blocks(_evidence(spark, d), "source", head)).select("query_id", "n_blocks", F.md5("text").alias("digest"))


@query(rf"{_TOP}, u AS (SELECT *, sum(len([x for x in regexp_split_to_array(block, '\s+') if x <> ''])) OVER (PARTITION BY query_id ORDER BY position) AS used FROM b) SELECT query_id, position FROM u WHERE used <= 2000")
def cp_tokens(spark: SparkSession, d: str) -> DataFrame:
    return X.fit_tokens(X.blocks(_evidence(spark, d)), 2000).select("query_id", "position")


@query(f"{_TOP}, u AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY position) + 2 * (position - 1) AS used FROM b) SELECT query_id, position FROM u WHERE used <= 20000")
def cp_chars(spark: SparkSession, d: str) -> DataFrame:
    return X.fit_characters(X.blocks(_evidence(spark, d)), 20000).select("query_id", "position")


@query(r"WITH u AS (SELECT conv_id, turn, sum(len([x for x in regexp_split_to_array(text, '\s+') if x <> ''])) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM conversations) SELECT conv_id, turn FROM u WHERE used <= 150")
def ce_history(spark: SparkSession, d: str) -> DataFrame:
    return X.evict_history(table(spark, d, "conversations"), 150).select("conv_id", "turn")


@query("WITH s AS (SELECT lang AS name, count(*) AS w FROM documents GROUP BY lang), a AS (SELECT name, w, floor(1000 * w / sum(w) OVER ())::BIGINT AS share, row_number() OVER (ORDER BY w DESC, name) AS i FROM s) SELECT name, (CASE WHEN i = 1 THEN share + 1000 - sum(share) OVER () ELSE share END)::BIGINT AS share FROM a")
def ce_alloc(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "documents").groupBy("lang").count().orderBy("lang").collect()  # a row for each language
    return spark.createDataFrame(list(X.allocate([(r.lang, 0, float(r["count"])) for r in sizes], 1000).items()), "name string, share long")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, item_id, score, characters, tokens) of every hit of the scan."""
    found = R.scan(RQ.items(spark, d), RQ.queries(spark))
    return found.select("query_id", "item_id", "score", F.length("text").alias("characters"), T.token_count(F.col("text")).cast("long").alias("tokens"))


_COUNT = r"len([x for x in regexp_split_to_array({0}, '\s+') if x <> ''])"
_C = f"{RQ._SCAN}, c AS MATERIALIZED (SELECT query_id, item_id, rank, length(text) AS n, {_COUNT.format('text')} AS tk, trim(text, ' ' || chr(10)) AS t FROM r)"


@query(f"""WITH {_C}, p AS (SELECT query_id, item_id, rank, tk, (rank - 1) // 3 AS page FROM c WHERE rank <= 18), z AS (SELECT query_id, page, count(*) AS n, sum(tk) AS t FROM p GROUP BY ALL),
e AS (SELECT query_id, min(page) AS last FROM (SELECT query_id, page, n, sum(t) OVER (PARTITION BY query_id ORDER BY page) AS u FROM z) WHERE n < 3 OR u >= floor(CASE WHEN query_id = 'q1' THEN 500 ELSE 4000 END * 0.9) GROUP BY query_id)
SELECT p.query_id, page::INTEGER AS page, rank, item_id FROM p LEFT JOIN e USING (query_id) WHERE last IS NULL OR page <= last""")
def ce_expand(spark: SparkSession, d: str) -> DataFrame:
    target = F.when(F.col("query_id") == "q1", 500).otherwise(4000)
    requests = RQ.queries(spark).select("query_id", F.lit(3).alias("limit"), F.lit(6).alias("max_pages"), target.alias("target_tokens"), F.lit(0.9).alias("ratio"))
    ranked = K.rank_by_score(evidence(spark, d)).where(F.col("rank") <= 18)  # the pages' reach, which Spark cuts each task's rows at
    return Y.expand_pages(ranked, requests).select("query_id", "page", "rank", "item_id")


def _filled_sql(tag: str, source: str, most: int) -> str:
    """CTEs up to ``tag`` (ctx, pack, k, query_id, item_id, tk, t) of packs (ctx, pack, query_id, lim, ch, tok)."""
    steps = [f"{tag}0 AS (SELECT *, 0 AS rank, 0 AS used FROM {source})"]
    for i in range(1, most + 1):
        steps.append(f"{tag}{i} AS (SELECT p.ctx, p.pack, p.query_id, p.lim, p.ch, p.tok, min(c.rank) AS rank, any_value(p.used) + arg_min(c.n, c.rank) AS used FROM {tag}{i - 1} p JOIN c ON c.query_id = p.query_id AND c.rank > p.rank AND p.used + c.n <= p.ch WHERE p.lim >= {i} GROUP BY ALL)")
    union = " UNION ALL ".join(f"SELECT ctx, pack, query_id, tok, {i} AS k, rank FROM {tag}{i}" for i in range(1, most + 1))
    return f"{', '.join(steps)}, {tag}u AS ({union}), {tag}v AS (SELECT u.*, c.item_id, c.tk, c.t, sum(c.tk) OVER (PARTITION BY ctx, pack ORDER BY k) AS upto FROM {tag}u u JOIN c USING (query_id, rank)), {tag} AS (SELECT * FROM {tag}v WHERE upto <= tok)"


_SYSTEM, _USER = "Answer from the documents", "What do they say"


def _assembled_sql() -> str:
    """Two rounds, written out: shares, packs, what is kept of the history, and the prompt cut."""
    ctx = "x AS (SELECT query_id || '-' || v AS ctx, query_id, v, CASE v WHEN 0 THEN 120 WHEN 1 THEN 900 ELSE 100000 END AS most, CASE v WHEN 0 THEN 200 WHEN 1 THEN 1500 ELSE 600 END AS total FROM q, (VALUES (0), (1), (2)) w(v))"
    said = f"h0 AS (SELECT x.ctx, turn, {_COUNT.format('text')} AS n FROM conversations JOIN x ON conv_id = (SELECT min(conv_id) FROM conversations) + v), h AS (SELECT ctx, row_number() OVER w AS nth, sum(n) OVER w AS upto FROM h0 WINDOW w AS (PARTITION BY ctx ORDER BY turn DESC))"
    head, tail = len(_SYSTEM.split()), len(_USER.split())
    parts = [RQ._Q, ctx, said, "s0 AS (SELECT ctx, x.query_id, most, total, 1000000 AS kept FROM x)"]
    for i in (1, 2):
        b = "total" if i == 1 else "greatest(1, total // 2)"
        share = lambda w: f"greatest(1, {b} * {w} // 3)"  # noqa: B023, E731
        chars = lambda tok: f"4 * ({tok})" if i == 1 else f"greatest(1, (4 * ({tok})) // 2)"  # noqa: B023, E731
        first = f"{share(2)} + {b} - {share(2)} - {share(1)}"
        parts.append(f"l{i} AS (SELECT ctx, 0 AS pack, query_id, {6 if i == 1 else 3} AS lim, {chars(first)} AS ch, {first} AS tok FROM s{i - 1} UNION ALL SELECT ctx, 1, 'q1', {4 if i == 1 else 2}, {chars(share(1))}, {share(1)} FROM s{i - 1})")
        parts.append(_filled_sql(f"f{i}", f"l{i}", 6 if i == 1 else 3))
        parts.append(f"g{i} AS (SELECT s.*, {head} + coalesce((SELECT sum(tk) FROM f{i} f WHERE f.ctx = s.ctx), 0) AS pt FROM s{i - 1} s)")
        parts.append(f"m{i} AS (SELECT g.*, coalesce((SELECT max(nth) FROM h WHERE h.ctx = g.ctx AND nth <= kept), 0) AS now, coalesce((SELECT max(upto) FROM h WHERE h.ctx = g.ctx AND nth <= kept), 0) AS nowt, coalesce((SELECT max(nth) FROM h WHERE h.ctx = g.ctx AND nth <= kept AND upto <= most - pt - {tail}), 0) AS fit, coalesce((SELECT max(upto) FROM h WHERE h.ctx = g.ctx AND nth <= kept AND upto <= most - pt - {tail}), 0) AS fitt FROM g{i} g)")
        parts.append(f"n{i} AS (SELECT *, pt + {tail} + nowt > most AS big, pt + {tail} > most AS over FROM m{i})")
        parts.append(f"s{i} AS (SELECT ctx, query_id, most, total, fit AS kept FROM n{i} WHERE big)")
        done = "NOT big" if i == 1 else "true"
        parts.append(f"d{i} AS (SELECT ctx, {i} AS rounds, CASE WHEN big THEN fit ELSE now END AS n_history, CASE WHEN big AND over THEN greatest(0, most - {tail}) + {tail} WHEN big THEN pt + {tail} + fitt ELSE pt + {tail} + nowt END AS token_count, CASE WHEN big AND over THEN most - {tail} END AS cut_to, big AS compacted FROM n{i} WHERE {done})")
        parts.append(f"t{i} AS (SELECT ctx, string_agg(t, chr(10) || chr(10) ORDER BY pack, k) AS t FROM f{i} WHERE t <> '' GROUP BY ctx)")
    body = " UNION ALL ".join(f"SELECT d.*, concat_ws(chr(10) || chr(10), '{_SYSTEM}', t.t) AS prompt FROM d{i} d LEFT JOIN t{i} t USING (ctx)" for i in (1, 2))
    text = r"CASE WHEN cut_to IS NOT NULL THEN array_to_string([x for x in regexp_split_to_array(prompt, '\s+') if x <> ''][1:cut_to], ' ') ELSE prompt END"
    parts[0] = _C
    return f"WITH {', '.join(parts)} SELECT ctx AS context_id, rounds::INTEGER AS rounds, md5({text}) AS digest, n_history::BIGINT AS n_history, token_count::BIGINT AS token_count, compacted FROM ({body})"


def contexts(spark: SparkSession) -> DataFrame:
    """Three contexts for each query: one that only fits when it is cut, one that fits when it is made again, a large one."""
    v = F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("v")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), F.col("v") + 1)
    rows = RQ.queries(spark).select("query_id", v)
    return rows.select("query_id", "v", F.concat_ws("-", "query_id", "v").alias("context_id"), pick(120, 900, 100_000).alias("max_tokens"), F.lit("compact").alias("overflow"), F.lit(2).alias("max_rounds"), pick(200, 1500, 600).alias("pack_tokens"), F.lit(_SYSTEM).alias("system"), F.lit(_USER).alias("user"))


def _pack(position: int, weight: float, query_id: Column, limit: int, child: Column | None = None) -> list[Column]:
    return [F.lit(position).alias("position"), F.lit(0).alias("priority"), F.lit(weight).alias("weight"), (F.lit(None).cast("string") if child is None else child).alias("child"), query_id.alias("query_id"), F.lit(limit).alias("limit"), F.lit(0).alias("offset"), F.lit(None).cast("long").alias("max_characters")]


@query(_assembled_sql())
def ce_assemble(spark: SparkSession, d: str) -> DataFrame:
    """Packs of the context's own query and of another, and the messages of a conversation."""
    asked, talks = contexts(spark), table(spark, d, "conversations")
    packs = asked.select("context_id", *_pack(0, 2.0, F.col("query_id"), 6)).unionByName(asked.select("context_id", *_pack(1, 1.0, F.lit("q1"), 4)))
    first = talks.agg(F.min("conv_id")).first()[0]
    said = talks.join(asked.select("context_id", (F.lit(first) + F.col("v")).alias("conv_id")), "conv_id").select("context_id", "turn", "text")
    made = Y.assemble_contexts(asked, packs, evidence(spark, d), said, RQ.items(spark, d).select("item_id", "text"))
    return made.select("context_id", "rounds", F.md5("prompt").alias("digest"), "n_history", "token_count", "compacted")


_CONV = "SELECT conv_id, turn, role FROM conversations"


@query(f"WITH a AS ({_CONV} WHERE turn <= 1), b AS ({_CONV} WHERE role = 'user') SELECT * FROM a UNION SELECT * FROM b", "set_union")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return t.where("turn <= 1").unionByName(t.where("role = 'user'")).distinct()


@query(f"WITH a AS ({_CONV} WHERE turn <= 1), b AS ({_CONV} WHERE role = 'user') SELECT *, 1 AS both FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 0 FROM (SELECT * FROM a EXCEPT SELECT * FROM b)", "set_inter")
def set_inter(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select("conv_id", "turn", "role")
    a, b = t.where("turn <= 1"), t.where("role = 'user'")
    return a.intersect(b).withColumn("both", F.lit(1)).unionByName(a.exceptAll(b).distinct().withColumn("both", F.lit(0)))


@query(f"""WITH {_C}, p AS (SELECT query_id AS ctx, 0 AS pack, query_id, 3 AS lim, 800 AS ch, 200 AS tok FROM q UNION ALL SELECT query_id, 1, 'q1', 4, 1200, 300 FROM q), {_filled_sql('f', 'p', 4)}
SELECT q.query_id, coalesce(count(f.ctx), 0) AS n_blocks, coalesce(sum(f.tk), 0)::BIGINT AS tokens, md5(concat_ws(chr(10) || chr(10), 'About ' || q.query_id, string_agg(f.t, chr(10) || chr(10) ORDER BY pack, k) FILTER (f.t <> ''))) AS digest FROM q LEFT JOIN f ON f.ctx = q.query_id GROUP BY q.query_id""")
def ce_nested(spark: SparkSession, d: str) -> DataFrame:
    """A retrieval and a context with a retrieval of its own, whose bound of 300 is less than the 400 that its place allots."""
    null = F.lit(None)
    outer = RQ.queries(spark).select(F.col("query_id").alias("context_id"), null.cast("long").alias("max_tokens"), null.cast("string").alias("overflow"), F.lit(1).alias("max_rounds"), F.lit(600).cast("long").alias("pack_tokens"), F.concat(F.lit("About "), "query_id").alias("system"), F.lit("").alias("user"))
    inner = outer.limit(1).withColumn("context_id", F.lit("inner")).withColumn("pack_tokens", F.lit(300).cast("long")).withColumn("system", F.lit(""))
    packs = outer.select("context_id", *_pack(0, 1.0, F.col("context_id"), 3)).unionByName(outer.select("context_id", *_pack(1, 2.0, null.cast("string"), 0, F.lit("inner")))).unionByName(inner.select("context_id", *_pack(0, 1.0, F.lit("q1"), 4)))
    all_, items = outer.unionByName(inner), RQ.items(spark, d).select("item_id", "text")
    found = evidence(spark, d)
    made = Y.assemble_contexts(all_, packs, found, table(spark, d, "conversations").limit(0).select(F.lit("").alias("context_id"), "turn", "text"), items).where("context_id <> 'inner'")
    leaves = Y.leaf_packs(all_.select("context_id", "pack_tokens"), packs, outer.select(F.col("context_id").alias("root"), F.lit(1.0).alias("scale")))
    filled = Y.fill_packs(leaves.withColumn("max_characters", F.least("max_characters", F.col("tokens") * 4)), Y.useful_evidence(found, packs)).groupBy(F.col("root").alias("context_id")).agg(F.count("*").alias("n_blocks"), F.sum("tokens").alias("tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return made.join(filled, "context_id", "left").select(F.col("context_id").alias("query_id"), zero("n_blocks"), zero("tokens"), F.md5("prompt").alias("digest"))
