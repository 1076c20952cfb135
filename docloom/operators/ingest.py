"""Items from sources: names, media types, front matter, catalog upkeep, ignore rules and hooks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: First bytes (hex) of media types.
MAGIC = {"25504446": "application/pdf", "89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "494433": "audio/mpeg", "FFFB": "audio/mpeg", "4F676753": "audio/ogg"}
#: Media types of file name endings.
ENDINGS = {
    "txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html", "csv": "text/csv", "json": "application/json", "pdf": "application/pdf",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "wav": "audio/wav", "mp3": "audio/mpeg", "ogg": "audio/ogg", "xml": "application/xml",
}


def sniff_media_type(content: Column) -> Column:
    """Media type from first bytes; null if unknown."""
    head = F.hex(F.substring(content, 1, 64))
    out = F.lit(None).cast("string")
    for magic, kind in MAGIC.items():
        out = F.when(head.startswith(magic), kind).otherwise(out)
    wave = head.startswith("52494646") & (F.substring(head, 17, 8) == "57415645")
    text = F.lower(F.ltrim(F.substring(content, 1, 64).cast("string")))
    return F.when(wave, "audio/wav").when(text.startswith("<!doctype html") | text.startswith("<html"), "text/html").otherwise(out)


def media_type_of(name: Column) -> Column:
    """Media type by the ending of a file name, application/octet-stream if unknown."""
    known = F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair])
    return F.coalesce(known[F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))], F.lit("application/octet-stream"))


def storage_name(name: Column) -> Column:
    """URL-encoded name; one of over 180 characters is its hash."""
    encoded = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
    return F.when(F.length(encoded) > 180, F.concat(F.lit("hash-"), F.sha2(name, 256))).otherwise(encoded)


def front_matter(text: Column) -> Column:
    """(head, body): a head needs a first line ``---`` and ends at the next such line; one newline before the body goes."""
    end = F.call_function("locate", F.lit("\n---\n"), text, F.lit(4))
    has = text.startswith("---\n") & (end > 0)
    body = F.substr(text, end + 5)
    return F.struct(F.when(has, F.substr(text, F.lit(5), F.greatest(end - 5, F.lit(0)))).alias("head"), F.when(has, F.regexp_replace(body, "^\n", "")).otherwise(text).alias("body"))


def flat_fields(head: Column) -> Column:
    """``key: value`` lines of a flat head as a map."""
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[A-Za-z_][^:]*:"))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, "^[^:]*:", "")))))


def merge_tags(first: Column, second: Column) -> Column:
    return F.array_distinct(F.concat(F.coalesce(first, F.array().cast("array<string>")), F.coalesce(second, F.array().cast("array<string>"))))


def merge_metadata(front: Column, sidecar: Column) -> Column:
    """Both maps; the sidecar wins."""
    return F.map_concat(F.map_filter(front, lambda k, v: ~F.array_contains(F.map_keys(sidecar), k)), sidecar)


def glob_regex(pattern: str) -> str:
    """A file-name pattern as a regular expression; * crosses /."""
    import fnmatch

    return "(?s)^" + fnmatch.translate(pattern).replace("(?s:", "(?:").removesuffix(r"\z").removesuffix(r"\Z") + "$"


def not_ignored(items: DataFrame, patterns: tuple[str, ...], path: str = "relpath") -> DataFrame:
    keep = F.lit(True)
    for p in patterns:
        keep = keep & ~F.col(path).rlike(glob_regex(p))
    return items.where(keep)


def ingest(new: DataFrame, catalog: DataFrame) -> DataFrame:
    """New items whose source_uri the catalog doesn't know, the first of each source_uri, with sha256 of the text."""
    first = new.withColumn("nth", F.row_number().over(Window.partitionBy("source_uri").orderBy("item_id"))).where("nth = 1").drop("nth")
    return first.join(catalog.select("source_uri").distinct(), "source_uri", "left_anti").withColumn("sha256", F.sha2("text", 256))


def duplicates(new: DataFrame, catalog: DataFrame) -> DataFrame:
    """New items that an item of the catalog has the source_uri of."""
    return new.join(catalog.select("source_uri").distinct(), "source_uri", "left_semi")


def streamed(content: Column, media_type: Column) -> Column:
    """(sha256, bytes) of items taken as bytes; Markdown must be taken as text, so it stops the query."""
    refused = F.raise_error(F.lit("Markdown can't be taken as a stream of bytes"))
    return F.when(media_type == "text/markdown", refused).otherwise(F.struct(F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("bytes")))


def note_uri(title: Column, text: Column) -> Column:
    return F.concat(F.lit("text:"), F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), text), 256))


def reindex(files: DataFrame, old: DataFrame) -> DataFrame:
    """(item_id, created_at, relpath, catalog order) of files (relpath, meta_id, created_at): the id is that of the metadata,
    else the uuid that starts the file name, else the file is skipped; known items keep created_at. Newest first."""
    uuid = F.nullif(F.regexp_extract("relpath", r"(?:^|/)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})--", 1), F.lit(""))
    named = files.withColumn("item_id", F.coalesce("meta_id", uuid)).where("item_id is not null")
    return named.join(old.select("item_id", F.col("created_at").alias("was")), "item_id", "left").select("item_id", F.coalesce("was", "created_at").alias("created_at"), "relpath")


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot, by created_at, extractor and id."""
    return snapshots.agg(F.max(F.struct("created_at", "extractor_id", "snapshot_id")).alias("s")).select("s.*")


def catalog_hash(items: DataFrame) -> DataFrame:
    """One hash of all items that doesn't depend on their order: sums of item hashes, so nothing is gathered."""
    h = F.sha2(F.concat_ws("|", "item_id", "sha256", "relpath"), 256)
    halves = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"h{i}") for i in range(4)]
    return items.agg(*halves).select(F.sha2(F.concat_ws(",", *[f"h{i}" for i in range(4)]), 256).alias("catalog_hash"))


def add_tags(tags: tuple[str, ...]) -> Callable[[DataFrame], DataFrame]:
    """A hook that gives every item these tags."""
    return lambda items: items.withColumn("tags", merge_tags(F.col("tags"), F.array(*[F.lit(t) for t in tags])))


def deny_all(items: DataFrame) -> DataFrame:
    """A hook that lets nothing in."""
    raise PermissionError("ingest denied by hook")


def run_hooks(items: DataFrame, hooks: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for hook in hooks:
        items = hook(items)
    return items


def purge(spark, path: str, confirm: str) -> None:
    """Delete a table's folder; ``confirm`` must repeat its last name."""
    if confirm != path.rstrip("/").rsplit("/", 1)[-1]:
        raise ValueError("confirmation does not name the table")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
