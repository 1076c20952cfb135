"""WARC records, and revisits resolved to the capture whose payload they stand for."""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions

RECORD = "record_id string, type string, url string, date string, http_status int, headers map<string,string>, payload binary"
#: Header fields that a 304 response may bring up to date (RFC 9110, section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't change what a URL names.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(=|$)"


def _fields(stream: io.BufferedIOBase) -> dict[str, str]:
    out = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class _Unpacked(io.RawIOBase):
    """What gzip members hold one after the other, up to where they are cut or damaged."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.member = memoryview(data), 0, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while True:
            packed = self.member.unconsumed_tail
            if not packed:
                packed = self.data[self.at : self.at + (1 << 16)]
                self.at += len(packed)
            if not packed:
                return 0
            try:
                piece = self.member.decompress(packed, len(out))
            except zlib.error:
                self.at, self.member = len(self.data), zlib.decompressobj(31)
                return 0
            if self.member.eof:
                self.at -= len(self.member.unused_data)
                self.member = zlib.decompressobj(31)
            if piece:
                out[: len(piece)] = piece
                return len(piece)


def parse_records(data: bytes) -> Iterator[tuple]:
    """Rows of RECORD from a WARC file's bytes, gzip-packed or not.

    What isn't a whole record ends the file, and the records before it count: a line that isn't a version, a
    Content-Length that is missing or no number, a block shorter than it, gzip data that is cut or damaged.
    """
    stream = io.BufferedReader(_Unpacked(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line.startswith(b"WARC/"):
            return
        own = _fields(stream)
        length = own.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            return
        block = stream.read(int(length))
        if len(block) < int(length):
            return
        status, headers, payload = None, {}, block
        if own.get("content-type", "").startswith("application/http"):
            http = io.BytesIO(block)
            words = http.readline().split()
            status = int(words[1]) if len(words) > 1 and words[1].isdigit() and len(words[1]) < 10 else None
            headers, payload = _fields(http), http.read()
        yield own.get("warc-record-id"), own.get("warc-type"), own.get("warc-target-uri"), own.get("warc-date"), status, headers, payload


def format_record(record_id: str, kind: str, url: str, date: str, status: int, headers: dict[str, str], payload: bytes) -> bytes:
    """One record as ``parse_records`` reads it."""
    http = f"HTTP/1.1 {status}\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items()) + b"\r\n" + payload
    head = f"WARC/1.1\r\nWARC-Record-ID: {record_id}\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\nContent-Type: application/http\r\nContent-Length: {len(http)}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files. A task holds one file at a time, so files should stay near the usual 1 GB."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for data in pdf.content:
                rows, size = [], 0
                for row in parse_records(data):
                    rows.append(row)
                    size += len(row[-1])
                    if size > 1 << 24:
                        yield pd.DataFrame(rows, columns=["record_id", "type", "url", "date", "http_status", "headers", "payload"])
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=["record_id", "type", "url", "date", "http_status", "headers", "payload"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORD)


def canonical_url(url: Column) -> Column:
    """Host in lower case without www, user and default port, path without a last slash, query sorted and without
    tracking; no scheme, no fragment. Null without a scheme and host."""
    u = F.trim(url)
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), r"^[^@]*@|:(80|443)$", "")
    host = F.regexp_replace(host, r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Each not-modified revisit with the latest earlier full response of its canonical URL.

    captures: (record_id, url, ts, kind, etag, last_modified, headers, digest), kind ``response`` or ``revisit``;
    other kinds are ignored. Earlier means a smaller (ts, record_id). Returns, for each revisit, record_id, url_key,
    ts, status, response_id, response_ts, digest and headers. status is ``resolved`` where the validators agree (entity
    tags, weakly compared, if both have one; else dates of last modification), ``mismatch`` where they differ,
    ``no_validator`` where there is none to compare, ``no_response`` without an earlier response or without a
    canonical URL, a ts or a record_id. Only resolved ones get digest and headers: those of the response, with the
    fields that a 304 may update taken from the revisit; names in lower case. Repeated rows give repeated rows.

    Captures are dealt by ranges of (URL, ts, record_id) and written once, so that a range stays what it is; a URL
    with a third of all rows falls into as many ranges as a third of the rows fill, even if all have one ts. The join is
    by URL and range; a range starts from the last response of the ranges before, one row for each URL and range.
    """
    spark = captures.sparkSession
    low = F.map_from_entries(F.array_sort(F.transform(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e.key).alias("key"), e.value.alias("value")))))
    rows = captures.where("kind in ('response', 'revisit')").select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts", (F.col("kind") == "response").alias("full"), F.nullif(F.regexp_replace(F.trim("etag"), "^W/", ""), F.lit("")).alias("etag"), F.nullif(F.trim("last_modified"), F.lit("")).alias("modified"), low.alias("headers"), "digest"
    )
    placed = rows.where("url_key is not null and ts is not null and record_id is not null")
    answer = F.struct("ts", "record_id", "etag", "modified", "headers", "digest")
    dealt = placed.repartitionByRange(partitions(spark), "url_key", "ts", "record_id").withColumn("part", F.spark_partition_id())
    placed = cut(dealt).withColumn("answer", F.when(F.col("full"), answer))
    placed.createOrReplaceTempView("docloom_captures")
    inside = spark.sql("""
        select *, last_value(answer, true) over (partition by url_key, part order by ts, record_id, full rows between unbounded preceding and 1 preceding) as met
        from docloom_captures""").where("not full")
    lasts = placed.where("full").groupBy("url_key", "part").agg(F.max_by("answer", F.struct("ts", "record_id")).alias("last"))
    lasts.unionByName(inside.where("met is null").select("url_key", "part").distinct().withColumn("last", F.lit(None).cast(lasts.schema["last"].dataType))).createOrReplaceTempView("docloom_lasts")
    carried = spark.sql("""
        select url_key, part, carry from (
          select url_key, part, last, last_value(last, true) over (partition by url_key order by part range between unbounded preceding and 1 preceding) as carry from docloom_lasts)
        where last is null""")
    spark.catalog.dropTempView("docloom_captures")
    spark.catalog.dropTempView("docloom_lasts")
    found = inside.join(carried, ["url_key", "part"], "left").withColumn("r", F.coalesce("met", "carry"))
    lost = rows.where("not full and (url_key is null or ts is null or record_id is null)").withColumn("r", F.lit(None).cast(found.schema["r"].dataType))
    found = found.select(*lost.columns).unionByName(lost)
    tags = F.col("etag").isNotNull() & F.col("r.etag").isNotNull()
    dates = F.col("modified").isNotNull() & F.col("r.modified").isNotNull()
    same = F.when(tags, F.col("etag") == F.col("r.etag")).when(dates, F.col("modified") == F.col("r.modified"))
    status = F.when(F.col("r").isNull(), "no_response").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("mismatch")
    permitted = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter("r.headers", lambda k, v: ~F.array_contains(F.map_keys(permitted), k))
    ok = status == "resolved"
    return found.select("record_id", "url_key", "ts", status.alias("status"), F.col("r.record_id").alias("response_id"), F.col("r.ts").alias("response_ts"), F.when(ok, F.col("r.digest")).alias("digest"), F.when(ok, F.map_concat(kept, permitted)).alias("headers"))
