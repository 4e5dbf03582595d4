"""Page dumps in MediaWiki XML, plain or compressed, read in splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "title string, ns string, redirect struct<_title:string>, revision struct<text:struct<_VALUE:string,_bytes:bigint>>"
STRICT = {"mode": "FAILFAST", "ignoreSurroundingSpaces": "false"}


def pages(spark: SparkSession, path: str) -> DataFrame:
    """ord, title, ns, redirect, text of every page of a dump.

    The file is split at </page>, so a large one is read by many tasks, and the Hadoop codecs read bz2 and gz. A
    page that doesn't parse fails the read. ``ord`` follows the order of the dump. ns is null where it is no
    number, which no filter for namespace 0 admits.
    """
    raw = spark.read.option("lineSep", "</page>").text(path).where("instr(value, '<page>') > 0")
    one = raw.select(F.monotonically_increasing_id().alias("ord"), F.from_xml(F.concat(F.expr("substr(value, instr(value, '<page>'))"), F.lit("</page>")), PAGE, STRICT).alias("p"))
    text = F.coalesce(F.col("p.revision.text._VALUE"), F.lit(""))
    return one.select("ord", F.coalesce("p.title", F.lit("")).alias("title"), F.trim("p.ns").try_cast("bigint").alias("ns"), F.col("p.redirect._title").alias("redirect"), text.alias("text"))


def namespaces(spark: SparkSession, path: str) -> list[str]:
    """Names of the namespaces in the dump's head, about thirty; only the part before the first page is parsed."""
    head = spark.read.option("lineSep", "<page>").text(path).where("instr(value, '<namespaces>') > 0").limit(1)
    found = head.select(F.explode(F.regexp_extract_all("value", F.lit("<namespace [^>]*>([^<]*)</namespace>"), F.lit(1))).alias("name"))
    return [r["name"].strip() for r in found.collect() if r["name"].strip()]


def html_links(pages_: DataFrame) -> DataFrame:
    """src, pos, raw of anchors in pages (page_id, html)."""
    from loomgraph.functions.text import hrefs

    return pages_.select(F.col("page_id").alias("src"), F.posexplode(hrefs(F.col("html"))).alias("pos", "raw"))
