"""A graph kept in files: nodes and edges merged by key into hash buckets, of which a merge writes only those it touches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import _remove

BUCKETS = 128
LOG = "version long, kind string, bucket int, folder string"
#: What tells graphs of one store apart; with node_id or edge_id it is a row's key.
SCOPE = ("graph_id", "snapshot_id", "item_id")
NODE = "graph_id string, snapshot_id string, item_id string, node_id string, node_type string, label string, properties string"
EDGE = "graph_id string, snapshot_id string, item_id string, edge_id string, src string, dst string, edge_type string, weight double, properties string"


class GraphStore:
    """Nodes and edges under ``path``, a folder that all executors share.

    nodes/<folder>/bucket=k and edges/<folder>/bucket=k hold rows; log holds, for each merge, which folder a bucket is in
    from then on. A merge writes the buckets of its keys into new folders and then its log rows in one file: until that
    is there, all readers see the store as it was, and what a lost driver has left is in no log and can be swept. One
    merge at a time. A store keeps the number of buckets that it began with.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _path(self, name: str):  # noqa: ANN202
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _log(self) -> list:
        """(version, kind, bucket, folder): the newest of each bucket; a store has ``buckets`` of each kind."""
        where = self._path("log")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return []
        log = self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        return log.groupBy("kind", "bucket").agg(F.max(F.struct("version", "folder")).alias("x")).select("x.version", "kind", "bucket", "x.folder").collect()

    def _rows(self, kind: str, schema: str, buckets: set[int] | None = None) -> DataFrame:
        mine = {}
        for r in self._log():
            if r.kind == kind and (buckets is None or r.bucket in buckets):
                mine.setdefault(r.folder, []).append(r.bucket)
        out = self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{kind}/{folder}/bucket={b}" for folder, own in mine.items() for b in own]
        return self.spark.read.schema(schema).parquet(*paths) if paths else out

    def nodes(self) -> DataFrame:
        return self._rows("nodes", NODE)

    def edges(self) -> DataFrame:
        return self._rows("edges", EDGE)

    def files(self, kind: str) -> dict[int, str]:
        """The folder of every bucket there is."""
        return {r.bucket: r.folder for r in self._log() if r.kind == kind}

    def merge(self, nodes: DataFrame, edges: DataFrame) -> int:
        """Puts rows in, in place of those of the same key, and returns the store's version.

        Keys are graph_id, snapshot_id and item_id with node_id or edge_id (nulls are equal; rows without node_id or edge_id
        are left out); columns that aren't given are null. Of rows of one key in a merge the largest counts. An edge is
        kept only if both its ends are nodes of its item, in the store or in this merge. Merging the same once more changes
        no row.
        """
        version = max((r.version for r in self._log()), default=0) + 1
        folder = uuid.uuid4().hex
        own = _last(_shaped(nodes, NODE).where("node_id is not null"), "node_id")
        touched = self._write("nodes", NODE, "node_id", own, folder)
        ends = self._ends(own)
        tied = _shaped(edges, EDGE).where("edge_id is not null")
        for end in ("src", "dst"):
            same = [F.col(f"e.{c}").eqNullSafe(F.col(f"n.{c}")) for c in SCOPE]
            tied = tied.alias("e").join(ends.alias("n"), [*same, F.col(f"e.{end}") == F.col("n.node_id")], "left_semi")
        touched += self._write("edges", EDGE, "edge_id", _last(tied, "edge_id"), folder)
        if touched:
            rows = [(version, kind, b, folder) for kind, b in touched]
            self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return version if touched else version - 1

    def _ends(self, own: DataFrame) -> DataFrame:
        """Keys of the nodes that there are and of those that come."""
        keys = [*SCOPE, "node_id"]
        return self.nodes().select(*keys).unionByName(own.select(*keys)).distinct()

    def _write(self, kind: str, schema: str, key: str, incoming: DataFrame, folder: str) -> list[tuple[str, int]]:
        placed = incoming.withColumn("bucket", self._bucket(key))
        touched = {r.bucket for r in placed.select("bucket").distinct().collect()}
        if touched:
            old = self._rows(kind, schema, touched).withColumn("fresh", F.lit(0))
            both = old.unionByName(incoming.withColumn("fresh", F.lit(1)))
            columns = [c for c in incoming.columns if c not in (*SCOPE, key)]
            last = both.groupBy(*SCOPE, key).agg(F.max_by(F.struct(*columns), "fresh").alias("r")).select(*SCOPE, key, "r.*")
            last.withColumn("bucket", self._bucket(key)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{kind}/{folder}")
        return [(kind, b) for b in sorted(touched)]

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(*SCOPE, key), F.lit(self.buckets)).cast("int")

    def sweep(self) -> None:
        """Removes buckets that no reader sees any more, and what unfinished merges have left; not while others read or merge."""
        for kind in ("nodes", "edges"):
            live = {(folder, b) for b, folder in self.files(kind).items()}
            where = self._path(kind)
            fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for folder in fs.listStatus(where) if fs.exists(where) else []:
                for bucket in fs.listStatus(folder.getPath()):
                    name = bucket.getPath().getName()
                    if name.startswith("bucket=") and (folder.getPath().getName(), int(name[7:])) not in live:
                        _remove(self.spark, bucket.getPath().toString())


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    fields = [f.split() for f in schema.split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def _last(df: DataFrame, key: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (*SCOPE, key)]
    return df.groupBy(*SCOPE, key).agg(F.max(F.struct(*rest)).alias("r")).select(*SCOPE, key, "r.*")
