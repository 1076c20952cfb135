"""Files as items, and tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import media_type_of, not_ignored, sniff_media_type

SCHEMES = ("file", "hdfs", "s3a", "viewfs", "abfss", "gs")


def load(spark: SparkSession, uri: str, root: str | None = None, allow_external: bool = False) -> DataFrame:
    """(source_uri, relpath, content, bytes, sha256, media_type) of a file or folder. With a root, paths outside it are
    refused unless allowed; unknown schemes always are."""
    scheme = uri.split("://", 1)[0] if "://" in uri else "file"
    if scheme not in SCHEMES:
        raise ValueError(f"unsupported source scheme: {scheme}")
    if root is not None and not allow_external and not uri.removeprefix("file://").startswith(root.rstrip("/") + "/"):
        raise ValueError("source lies outside the root")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri)
    base = uri.removeprefix("file://").rstrip("/")
    relpath = F.regexp_replace(F.col("path"), "^.*?" + base.replace(".", r"\.") + "/?", "")
    return files.select(F.col("path").alias("source_uri"), relpath.alias("relpath"), "content", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.coalesce(sniff_media_type(F.col("content")), media_type_of(F.col("path"))).alias("media_type"))


def import_tree(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(items, one row of scanned, imported, ignored)."""
    found = load(spark, root)
    kept = not_ignored(found, ignore)
    counts = found.agg(F.count("*").alias("scanned")).crossJoin(kept.agg(F.count("*").alias("imported")))  # two single rows
    return kept, counts.withColumn("ignored", F.col("scanned") - F.col("imported"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Keyed upsert: one row for each node and edge key, edges only between known nodes."""
    from ..operators.graph import upsert

    n, e = upsert(nodes, edges)
    n.write.mode("overwrite").partitionBy("node_type").parquet(f"{path}/nodes")
    e.write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edges")
