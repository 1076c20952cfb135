"""A full-text index that stays: postings by term in buckets, grown by what is new, read by the terms asked for."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import cut, drop

#: Buckets of terms, a folder of postings each; and chunk ids in one block of a term's postings.
BUCKETS, SPAN = 64, 4096
#: Blocks whose chunks are scored first to find what a query's last hit must reach.
FIRST_BLOCKS = 8

BATCHES = "batch string, chunks long, words long"


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """Postings of chunks (chunk_id long, text), stored under ``path``, a folder that all executors share.

    postings/batch=b/bucket=k: (term, block, chunks, most, shortest, hits), a row for each term and each ``SPAN`` of chunk
    ids: how many of its chunks hold the term, how often at most, how many words the shortest has, and (chunk_id, tf, len)
    of each. chunks/batch=b: (chunk_id, hash, len). batches: a row (batch, chunks, words) for each ``add``, written last:
    what a lost driver left behind without it is never read. Adding again what is stored adds nothing.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def batches(self) -> DataFrame:
        """What was added, a row each."""
        if not self._exists("batches"):
            return self.spark.createDataFrame([], BATCHES)
        return self.spark.read.schema(BATCHES).parquet(f"{self.path}/batches")

    def _stored(self, name: str, schema: str) -> DataFrame:
        """Rows of the batches that are complete; their names, one for each ``add``, go into the plan and prune folders."""
        done = [r.batch for r in self.batches().collect()]
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("batch").isin(*done))

    def chunks(self) -> DataFrame:
        return self._stored("chunks", "chunk_id long, hash string, len int, batch string")

    def postings(self) -> DataFrame:
        return self._stored("postings", "term string, block long, chunks long, most long, shortest int, hits array<struct<chunk_id:long,tf:long,len:int>>, batch string, bucket int")

    def add(self, chunks: DataFrame) -> int:
        """Adds the chunks (chunk_id, text) whose id isn't stored, and returns how many these are.

        A stored id with another text is an error, as the index would hold words that aren't there any more. Null texts
        are empty, rows without chunk_id are left out, equal rows that repeat count once. An add that ends early can be
        repeated; two at once of the same chunks can't.
        """
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # dealt by chunk_id once: equal rows, what is stored and the terms of a chunk are met without another deal
        rows = chunks.where("chunk_id is not null").select(F.col("chunk_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).repartition(n, "chunk_id")
        hashed = rows.withColumn("hash", F.sha2("text", 256)).dropDuplicates(["chunk_id", "hash"])
        known = self.chunks().select("chunk_id", F.col("hash").alias("old"))
        both = hashed.join(known, "chunk_id", "left")
        changed = F.raise_error(F.concat(F.lit("the index has another text of chunk "), F.col("chunk_id").cast("string")))
        new = both.where(F.when(F.col("old") != F.col("hash"), changed).otherwise(F.col("old").isNull())).drop("old")
        tokens = cut(new.select("chunk_id", "hash", T.folded_tokens(F.col("text")).alias("tokens")))
        sizes = tokens.agg(F.count("*"), F.count_distinct("chunk_id"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
        if sizes[0] != sizes[1]:
            raise ValueError("two texts have the same chunk_id")
        if sizes[0]:
            batch = uuid.uuid4().hex
            dealt = tokens.repartition(n, "chunk_id")  # a chunk's terms are counted where its tokens are
            tf = dealt.select("chunk_id", F.size("tokens").alias("len"), F.explode("tokens").alias("term")).groupBy("chunk_id", "len", "term").agg(F.count("*").alias("tf"))
            # a bucket's rows meet in few tasks, so it has few files; rows of a frequent term spread by their block
            placed = tf.withColumn("block", F.floor(F.col("chunk_id") / SPAN)).withColumn("bucket", bucket_of(F.col("term"))).withColumn("far", F.floor(F.col("block") / 64)).repartition(n, "bucket", "far")
            hit = F.struct("chunk_id", "tf", "len")
            held = placed.groupBy("bucket", "far", "term", "block").agg(F.count("*").alias("chunks"), F.max("tf").alias("most"), F.min("len").alias("shortest"), F.sort_array(F.collect_list(hit)).alias("hits"))  # a span's chunks at most
            held.drop("far").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{self.path}/postings/batch={batch}")
            tokens.select("chunk_id", "hash", F.size("tokens").alias("len")).write.parquet(f"{self.path}/chunks/batch={batch}")
            self.spark.createDataFrame([(batch, sizes[0], sizes[2])], BATCHES).coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
        drop(tokens)
        return sizes[0]

    def asked(self, terms: DataFrame) -> DataFrame:
        """Postings of the terms of queries (query_id, terms): (query_id, needed, term, block, chunks, most, shortest, hits).

        The different terms, a stated set, go into the plan with their buckets, so that only these buckets' files are read.
        """
        words = [r[0] for r in terms.select(F.explode("terms").alias("term")).distinct().collect()]
        buckets = [r[0] for r in self.spark.createDataFrame([(w,) for w in words], "term string").select(bucket_of(F.col("term"))).distinct().collect()] if words else []
        mine = self.postings().where(F.col("bucket").isin(*buckets) & F.col("term").isin(*words) if words else F.lit(False))
        q = terms.select("query_id", F.size("terms").alias("needed"), F.explode("terms").alias("term"))
        return mine.drop("batch", "bucket").join(F.broadcast(q), "term")  # the stated set

    def bm25(self, terms: DataFrame, limit: int | None = None) -> DataFrame:
        """(query_id, chunk_id, score) of chunks that hold every term of a query (query_id, terms), as ``retrieve.bm25``.

        With ``limit`` only each query's best ones, ties to smaller ids: blocks are taken by what their chunks can reach at
        most, from how often a term stands in a chunk at most and the shortest chunk; the best few give the score that the
        last hit has at least, and blocks that can't reach it are not opened.
        """
        total, words = self.batches().agg(F.coalesce(F.sum("chunks"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        mean = words / total if total and words else 1.0
        met = self.asked(terms)
        met = met.withColumn("idf", self._idf(total, met))
        if limit is None:
            return self._scored(met, mean)
        met = cut(met)
        part = _part(F.col("idf"), F.col("most"), F.col("shortest"), mean)
        reach = met.groupBy("query_id", "needed", "block", "term").agg(F.max(part).alias("most")).groupBy("query_id", "block", "needed").agg(F.count("*").alias("held"), F.sum("most").alias("most")).where("held = needed")
        order = Window.partitionBy("query_id").orderBy(F.col("most").desc(), "block")
        first = cut(reach.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max(FIRST_BLOCKS, 1)).select("query_id", "block"))
        head = cut(self._scored(met.join(first, ["query_id", "block"], "left_semi"), mean))
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
        least = head.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == limit).select("query_id", F.col("score").alias("least"))
        open_ = reach.join(first, ["query_id", "block"], "left_anti").join(least, "query_id", "left").where("least is null or most >= least - 1e-6")  # scores are rounded to 6 places
        rest = self._scored(met.join(open_.select("query_id", "block"), ["query_id", "block"], "left_semi"), mean)
        return head.unionByName(rest).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= limit).drop("nth")

    @staticmethod
    def _idf(total: int, met: DataFrame) -> Column:
        n = F.sum("chunks").over(Window.partitionBy("query_id", "term"))  # a row for each span of chunk ids
        return F.greatest(F.log((total - n + 0.5) / (n + 0.5)), F.lit(1e-6))

    @staticmethod
    def _scored(met: DataFrame, mean: float) -> DataFrame:
        each = met.select("query_id", "needed", "term", "idf", F.explode("hits").alias("h"))
        part = _part(F.col("idf"), F.col("h.tf"), F.col("h.len"), mean)
        scored = each.groupBy("query_id", F.col("h.chunk_id").alias("chunk_id"), "needed").agg(F.count("*").alias("held"), F.sum(part).alias("score")).where("held = needed")
        return scored.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def _part(idf: Column, tf: Column, length: Column, mean: float) -> Column:
    """What a term adds to a chunk's score; it grows with tf and falls with the length."""
    return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / F.lit(mean)))
