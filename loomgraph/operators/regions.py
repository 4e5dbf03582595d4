"""Communities of an article graph: statistics, top members, landmarks, names, meta-graph, top-k lists, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T


def community_stats(nodes: DataFrame) -> DataFrame:
    """community, size, pct_of_total, avg_rank, max_rank, avg_degree of nodes (community, pagerank, degree)."""
    g = nodes.groupBy("community").agg(F.count("*").alias("size"), F.avg("pagerank").alias("avg_rank"), F.max("pagerank").alias("max_rank"), F.avg("degree").alias("avg_degree"))
    total = nodes.agg(F.count("*").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("community", "size", F.round(100.0 * F.col("size") / F.col("total"), 2).alias("pct_of_total"), "avg_rank", "max_rank", "avg_degree")


def first_k(rows: DataFrame, by: str | list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1."""
    by = [by] if isinstance(by, str) else by
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(out) <= k)


def landmarks(nodes: DataFrame, most: int) -> DataFrame:
    """The node of highest degree in each community, ties by id; communities by size, then name."""
    g = nodes.groupBy("community").agg(F.count("*").alias("size"), F.min(F.struct((-F.col("degree")).alias("minus"), "id", "title")).alias("best"))
    return g.select("community", "size", F.col("best.id").alias("id"), F.col("best.title").alias("title"), (-F.col("best.minus")).alias("degree")).orderBy(F.desc("size"), "community").limit(most)


def meta_edges(edges: DataFrame, member: DataFrame) -> DataFrame:
    """Links between communities: a, b, weight of member (id, community)."""
    j = edges.join(member.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(member.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    return j.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def region_votes(members: DataFrame, categories: DataFrame, sample: int = 20_000, least: int = 3, most: int = 12) -> DataFrame:
    """community, category, votes, rank: the categories of each community's first members by id."""
    first = first_k(members.select("community", "id"), "community", ["id"], sample, "_r").drop("_r")
    v = first.join(categories, "id").groupBy("community", "category").agg(F.count("*").alias("votes")).where((F.col("votes") >= least) & ~T.is_vacuous(F.col("category")))
    return first_k(v, "community", [F.desc("votes"), "category"], most)


def region_names(votes: DataFrame, sizes: DataFrame) -> DataFrame:
    """community, name: larger communities choose first, each the best category not yet taken.

    The choice is sequential over at most a few thousand communities with twelve candidates each, which the
    driver makes.
    """
    rows = votes.join(sizes, "community").select("community", "category", "rank", "size").collect()
    wish: dict = {}
    for r in rows:
        wish.setdefault((-r["size"], r["community"]), []).append((r["rank"], r["category"]))
    taken: set[str] = set()
    out = []
    for key in sorted(wish):
        name = next((c for _, c in sorted(wish[key]) if c not in taken), None)
        if name is not None:
            taken.add(name)
            out.append((key[1], name))
    return votes.sparkSession.createDataFrame(out, "community string, name string")


def search_entries(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """lower, owner, degree: titles, and aliases (id, alias) that differ from their owner's title."""
    own = nodes.select(F.lower("title").alias("lower"), F.col("id").alias("owner"), "degree")
    a = aliases.join(nodes.select("id", "title", "degree"), "id").where(F.lower("alias") != F.lower("title"))
    return own.unionByName(a.select(F.lower("alias").alias("lower"), F.col("id").alias("owner"), "degree"))


def search(entries: DataFrame, q: str, most: int = 10) -> DataFrame:
    """owner, score of the best entry of each owner, by score, ties by owner. A blank query finds nothing."""
    q = q.strip().lower()
    e = entries.withColumn("score", T.search_score(F.col("lower"), q, F.col("degree"))).where(F.lit(bool(q)) & F.col("score").isNotNull())
    return e.groupBy("owner").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "owner").limit(min(most, 50))


def search_prefix(entries: DataFrame, q: str, enough: int = 15, most: int = 15) -> DataFrame:
    """owner, degree, total: owners of entries with the prefix; if fewer than ``enough``, with the part; by degree."""
    q = q.strip().lower()
    e = entries.where(F.contains("lower", F.lit(q))).groupBy("owner").agg(F.max("degree").alias("degree"), F.max(F.startswith("lower", F.lit(q)).cast("int")).alias("prefix"))
    n = e.agg(F.sum("prefix").alias("prefixed"), F.count("*").alias("every"))
    e = e.crossJoin(F.broadcast(n)).where((F.col("prefix") == 1) | (F.col("prefixed") < enough))
    total = F.when(F.col("prefixed") < enough, F.col("every")).otherwise(F.col("prefixed"))
    return e.withColumn("total", total).orderBy(F.desc("degree"), "owner").limit(most).select("owner", "degree", "total")


def article_links(edges: DataFrame, nodes: DataFrame, id_: int, ban: int | None, goal: int | None = None) -> DataFrame:
    """The links of one article with the attributes of their targets; banned: degree above ``ban``, the goal exempt."""
    near = edges.where(F.col("src") == id_).select(F.col("dst").alias("id"))
    banned = (F.col("degree") > ban) & (F.col("id") != (goal if goal is not None else -1)) if ban is not None else F.lit(False)
    return nodes.join(near, "id", "left_semi").withColumn("banned", banned)


def link_groups(links: DataFrame, least: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``by``, community, n: the links of each group by community; those below ``least`` are pooled as
    __misc if there are several."""
    g = links.groupBy(*by, "community").agg(F.count("*").alias("n"))
    small = g.groupBy(*by).agg(F.count_if(F.col("n") < least).alias("small"))
    named = F.when((F.col("n") < least) & (F.col("small") > 1), F.lit("__misc")).otherwise(F.col("community"))
    both = g.join(small, list(by)) if by else g.crossJoin(F.broadcast(small))
    return both.groupBy(*by, named.alias("community")).agg(F.sum("n").alias("n"))


def resolve_index(titles: DataFrame, aliases: DataFrame) -> DataFrame:
    """key, id: normalised titles and aliases; an article's own title wins over aliases, then the least id."""
    t = titles.select(T.normalize_title(F.col("title")).alias("key"), "id", F.lit(0).alias("p"))
    a = aliases.select(T.normalize_title(F.col("alias")).alias("key"), "id", F.lit(1).alias("p"))
    return t.unionByName(a).where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("p", "id"))["id"].alias("id"))


def labelled(community: Column, names: Column) -> Column:
    """A community's name, or Cluster id."""
    return F.coalesce(F.nullif(names, F.lit("")), F.concat(F.lit("Cluster "), community.cast("string")))
