"""From page dumps to a link graph: identity, redirects, link resolution, side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T

#: Hops after the first that a redirect is followed.
MORE_HOPS = 4


def redirect_closure(pages: DataFrame) -> DataFrame:
    """key, is_redirect, final of pages (key, target): what a title leads to after at most five hops.

    A cycle, a longer chain or a missing target gives null. Each hop is one equi-join.
    """
    own = pages.select("key", "target").groupBy("key").agg(F.max("target").alias("target"))
    to = own.select(F.col("key").alias("k"), F.col("target").alias("t"))
    r = own.where("target IS NOT NULL").select("key", F.col("target").alias("at"))
    for _ in range(MORE_HOPS):
        # a redirect moves on; an article, or a missing page, stays
        r = r.join(to, F.col("at") == F.col("k"), "left").select("key", F.when(F.col("t").isNotNull(), F.col("t")).otherwise(F.col("at")).alias("at"))
    alive = own.where("target IS NULL").select(F.col("key").alias("k"))
    r = r.join(alive, F.col("at") == F.col("k"), "left").select("key", F.lit(True).alias("is_redirect"), F.col("k").alias("final"))
    return r.unionByName(own.where("target IS NULL").select("key", F.lit(False).alias("is_redirect"), F.col("key").alias("final")))


def dense_ids(articles: DataFrame, order: str, block: str = "_part") -> DataFrame:
    """Articles with id, dense from 0 in the order of ``order``: ranks inside ranges, then offsets of the ranges."""
    spark = articles.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    from loomgraph.plans.lineage import cut

    r = cut(articles.repartitionByRange(n, order).withColumn(block, F.spark_partition_id()))
    sums = r.groupBy(block).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(block, before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy(block).orderBy(order)) - 1
    return r.withColumn("_rank", rank).join(F.broadcast(sums), block).withColumn("id", (F.col("_before") + F.col("_rank")).cast("bigint")).drop(block, "_rank", "_before")


def classify_links(links: DataFrame, index: DataFrame, namespaces: list[str]) -> DataFrame:
    """links (src, raw, pos) with dst and kind: foreign, red, self, duplicate or edge.

    Namespaces are tested on the raw target, before the join; the first of equal links of a page is the edge.
    """
    c = links.withColumn("foreign", T.is_foreign(F.col("raw"), namespaces)).withColumn("key", F.when(~F.col("foreign"), T.normalize_title(F.col("raw"))))
    c = c.join(index.select("key", F.col("id").alias("dst")), "key", "left")
    nth = F.row_number().over(Window.partitionBy("src", "dst").orderBy("pos"))
    kind = F.when(F.col("foreign"), "foreign").when(F.col("dst").isNull(), "red").when(F.col("dst") == F.col("src"), "self").when(nth > 1, "duplicate").otherwise("edge")
    return c.withColumn("kind", kind).select("src", "raw", "pos", "dst", "kind")


def page_categories(pages: DataFrame, most: int = 6) -> DataFrame:
    """id, category, ord: the first categories of each page's raw wikitext, upkeep ones left out first."""
    c = pages.select("id", F.posexplode(T.links(F.col("text"))).alias("pos", "raw")).withColumn("category", T.category_name(F.col("raw")))
    c = c.where(F.col("category").isNotNull() & ~T.is_maintenance(F.col("category"))).groupBy("id", "category").agg(F.min("pos").alias("pos"))
    ord_ = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    return c.withColumn("ord", ord_).where(F.col("ord") <= most).select("id", "category", "ord")


def build(pages: DataFrame, namespaces: list[str], references: bool = True, templates: bool = False, citations: bool = True) -> dict[str, DataFrame]:
    """All tables of a dump: titles, redirects, links (classified), edges, categories, sizes, extras.

    ``pages`` has ord, title, ns, redirect, text. Only namespace 0 counts. A title that any page redirects is a
    redirect for good, to its last target.
    """
    main = pages.where("ns = 0").withColumn("key", T.normalize_title(F.col("title"))).where("key IS NOT NULL")
    one = main.groupBy("key").agg(F.min("ord").alias("ord"), F.max_by(T.normalize_title(F.col("redirect")), F.when(F.col("redirect").isNotNull(), F.col("ord"))).alias("target"), F.max(F.col("redirect").isNotNull()).alias("is_redirect"))
    one = one.withColumn("target", F.when(F.col("is_redirect"), F.coalesce("target", F.lit(""))))
    closure = redirect_closure(one.select("key", "target"))
    titles = dense_ids(one.where(~F.col("is_redirect")).select("key", "ord"), "ord").select("id", F.col("key").alias("title"), "ord")
    index = closure.join(titles.select(F.col("title").alias("final"), "id"), "final").select("key", "id", "is_redirect")
    bodies = main.where("redirect IS NULL").join(titles.select(F.col("title").alias("key"), "id", F.col("ord").alias("first")), "key").where("ord = first")
    bodies = bodies.select("id", "key", "text")
    found = bodies.select(F.col("id").alias("src"), F.posexplode(T.links(T.clean(F.col("text"), references, templates, citations))).alias("pos", "raw"))
    links = classify_links(found, index, namespaces)
    t = F.col("text")
    extras = bodies.select("id", T.short_description(t).alias("description"), T.infobox_kind(t).alias("kind"), T.flags(t, F.col("key")).alias("flags"), T.coordinates(t).alias("at"), F.octet_length(t).alias("bytes"))
    return {
        "titles": titles.select("id", "title"), "redirects": index.where("is_redirect").select(F.col("id").alias("article_id"), F.col("key").alias("alias")), "links": links,
        "edges": links.where("kind = 'edge'").select("src", "dst"), "categories": page_categories(bodies.select("id", "text")), "extras": extras,
    }


def funnel(links: DataFrame) -> DataFrame:
    """kind, n of classified links."""
    return links.groupBy("kind").agg(F.count("*").alias("n"))


def pageviews(lines: DataFrame, titles: DataFrame, aliases: DataFrame, project: str = "en.wikipedia") -> DataFrame:
    """id, views of a view dump (value: "project title page_id access total ..."), titles before aliases.

    Malformed numbers are skipped; totals are clipped to 32 bits.
    """
    from loomgraph.operators.regions import resolve_index

    p = F.split("value", " ")
    d = lines.where(F.startswith("value", F.lit(project + " "))).select(T.normalize_dump_title(F.get(p, F.lit(1))).alias("key"), F.get(p, F.lit(4)).try_cast("bigint").alias("n")).where("n IS NOT NULL")
    by = d.groupBy("key").agg(F.sum("n").alias("n")).join(resolve_index(titles, aliases), "key").groupBy("id").agg(F.sum("n").alias("views"))
    return by.select("id", F.greatest(F.lit(0), F.least("views", F.lit(4294967295))).alias("views"))
