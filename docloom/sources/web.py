"""Links of web pages and crawling over stored pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..operators.ingest import glob_regex
from ..operators.lineage import cut, drop, scratch

#: A comment, an element whose content isn't markup, or a start tag with its attributes.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b(?P<raw_attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>.*?(?:</(?P=raw)\s*>|\Z)|<[A-Za-z][^\s/>]*(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"(?P<name>[^\s=/>\"']+)\s*(?:=\s*(?:\"(?P<double>[^\"]*)\"|'(?P<single>[^']*)'|(?P<bare>[^\s\"'>]+)))?", re.S)
LINK = StructType([StructField("raw", StringType()), StructField("url", StringType())])


def found_links(html: str) -> Iterator[str]:
    """Values of href and src attributes, entities decoded and white space at their ends gone, in order; blank ones are left
    out, and so is what stands in comments and in the content of scripts and styles."""
    for tag in _MARKUP.finditer(html):
        inside = tag["attributes"] or tag["raw_attributes"]
        for a in _ATTRIBUTE.finditer(inside) if inside else ():
            if a["name"].lower() in ("href", "src"):
                value = unescape(next((a[k] for k in ("double", "single", "bare") if a[k] is not None), "")).strip()
                if value:
                    yield value


def absolute(base: str, link: str) -> str | None:
    """The URL a link on a page leads to, without its fragment; null for mail and script links and for what is no URL."""
    try:
        url = urljoin(base, link).partition("#")[0].strip()
    except ValueError:
        return None
    return None if url.startswith(("mailto:", "javascript:")) else url


@F.pandas_udf(ArrayType(LINK))
def page_links(html: pd.Series, base: pd.Series) -> pd.Series:
    """Each page's links as they stand and as URLs, found and resolved in one pass; none for a null page."""
    rows = [[{"raw": x, "url": absolute(b or "", x)} for x in found_links(h or "")] for h, b in zip(html, base, strict=True)]
    return pd.Series(rows, dtype=object)


def raw_links(html: Column) -> Column:
    """Links as they stand in the page."""
    return F.transform(page_links(html, F.lit("")), lambda x: x.raw)


def linked_urls(html: Column, base: Column) -> Column:
    """URLs that a page's links lead to; those that are null in ``page_links`` are left out."""
    return F.filter(F.transform(page_links(html, base), lambda x: x.url), lambda u: u.isNotNull())


def relative_path(url: Column, prefix: str) -> Column:
    """The URL after the prefix, without slashes before it; where it is empty or ends in slashes, index.html instead of them."""
    rest = F.regexp_replace(F.substr(url, F.lit(len(prefix) + 1)), "^/+", "")
    return F.when(rest == "", "index.html").otherwise(F.regexp_replace(rest, "/+$", "/index.html"))


def crawl_log(pages: DataFrame, root: str, prefix: str, most: int, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(url, depth, status) of every URL met from ``root`` on, breadth first, each once, until ``most`` are stored.

    status is outside (it doesn't begin with the prefix), ignored (its ``relative_path`` matches one of the patterns),
    errored (there is no such page) or stored; only stored ones are followed. Within a depth they come by URL, and
    what would come after the last one stored is left out. pages (url, html), and media_type if not all are HTML:
    only links of HTML are followed. Equal URLs that repeat are one page with the links of all.

    Links are found once, in one table of those from pages that can be stored. Each round's new URLs are a folder of one
    table; a round joins the last folder with the links and leaves out what any folder has, so a plan stays as long
    in round 1,000 as in round 1, and a round that a lost driver left is not read, as the path is its own.
    """
    spark = pages.sparkSession
    html = pages.where(F.col("media_type").startswith("text/html")) if "media_type" in pages.columns else pages
    skip = F.lit(False)
    for p in ignored:
        skip = skip | relative_path(F.col("url"), prefix).rlike(glob_regex(p))
    held = cut(pages.select("url").where(F.col("url").startswith(prefix)).distinct())
    status = F.when(~F.col("url").startswith(prefix), "outside").when(skip, "ignored").when(F.col("held").isNull(), "errored").otherwise("stored")
    inside = html.where(F.col("url").startswith(prefix) & ~skip)
    links = cut(inside.select("url", F.explode(linked_urls(F.col("html"), F.col("url"))).alias("to")).distinct())
    path = scratch(spark)

    def put(urls: DataFrame, depth: int) -> DataFrame:
        known = urls.join(held.withColumn("held", F.lit(1)), "url", "left").select("url", status.alias("status"))
        known.write.parquet(f"{path}/depth={depth}")
        return spark.read.schema("url string, status string").parquet(f"{path}/depth={depth}")

    last, depth = put(spark.createDataFrame([(root,)], "url string"), 0), 0
    stored = last.where("status = 'stored'").count()
    while stored < most:
        met = spark.read.schema("url string, status string, depth int").parquet(path)
        new = links.join(last.where("status = 'stored'"), "url", "left_semi").select(F.col("to").alias("url")).distinct().join(met.select("url"), "url", "left_anti")
        depth += 1
        last = put(new, depth)
        found, more = last.agg(F.count("*"), F.count_if(F.col("status") == "stored")).first()
        if not found:
            break
        stored += more
    drop(links, held)
    log = spark.read.schema("url string, status string, depth int").parquet(path).select("url", "depth", "status")
    if stored <= most:
        return log
    # the round that met the bound: its URLs come in order up to the last one stored
    before = log.where(F.col("depth") < depth).agg(F.count_if(F.col("status") == "stored")).first()[0]
    ends = log.where((F.col("depth") == depth) & (F.col("status") == "stored")).orderBy("url").limit(most - before).agg(F.max("url")).first()[0]
    return log.where((F.col("depth") < depth) | (F.col("url") <= ends))


def crawl_counts(log: DataFrame) -> DataFrame:
    """One row of what a crawl met, by status."""
    of = lambda s: F.count_if(F.col("status") == s)
    return log.agg(F.count("*").alias("discovered_items"), of("stored").alias("fetched_items"), of("stored").alias("stored_items"), of("outside").alias("skipped_outside_prefix_items"), of("ignored").alias("skipped_ignored_items"), of("errored").alias("errored_items"))


def crawl(pages: DataFrame, root: str, prefix: str, most: int, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(url, depth) of the pages that ``crawl_log`` stores."""
    return crawl_log(pages, root, prefix, most, ignored).where("status = 'stored'").select("url", "depth")
