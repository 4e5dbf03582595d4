"""Degrees, hubs, symmetry and topology of a graph given as nodes (id, ...) and edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with in_degree and out_degree; isolated nodes have 0. Edges are read once, both ends in one aggregation."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    d = ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return nodes.join(d, "id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0))).withColumn("out_degree", F.coalesce("out_degree", F.lit(0)))


def top_hubs(deg: DataFrame, k: int) -> DataFrame:
    """The k nodes of highest in-degree, ties by id."""
    return deg.orderBy(F.desc("in_degree"), "id").limit(k)


def hub_cut(deg: DataFrame, n: int) -> DataFrame:
    """threshold: in-degree of the hub of rank n (0 if there are no more than n nodes); excluded: nodes above it."""
    ranked = top_hubs(deg.select("id", "in_degree"), n + 1).agg(F.count("*").alias("have"), F.sort_array(F.collect_list("in_degree"), asc=False).alias("top"))
    cut = ranked.select(F.when(F.col("have") > n, F.get("top", F.lit(n - 1))).otherwise(0).alias("threshold"))
    return deg.crossJoin(F.broadcast(cut)).groupBy("threshold").agg(F.count_if(F.col("in_degree") > F.col("threshold")).alias("excluded"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, distinct, without loops."""
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def reciprocal(edges: DataFrame) -> DataFrame:
    """Edges whose reverse exists: a semi-join with itself."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["src", "dst"], "left_semi")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.lit(100.0) * part / whole)


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, orphans, dead ends, isolated nodes, reciprocal edges and share, mean out-degree."""
    deg = with_degrees(nodes, edges)
    one = deg.agg(
        F.count("*").alias("n_nodes"), F.sum("out_degree").alias("n_edges"), F.count_if(F.col("in_degree") == 0).alias("orphans"), F.count_if(F.col("out_degree") == 0).alias("dead_ends"),
        F.count_if((F.col("in_degree") == 0) & (F.col("out_degree") == 0)).alias("isolated"),
    )
    two = reciprocal(edges).agg(F.count("*").alias("reciprocal"))
    return one.crossJoin(F.broadcast(two)).withColumn("reciprocity_pct", F.round(percent(F.col("reciprocal"), F.col("n_edges")), 4)).withColumn("mean_out_degree", F.round(F.col("n_edges") / F.col("n_nodes"), 4))


def core(deg: DataFrame, by: str, k: int) -> DataFrame:
    """Nodes whose value is at least the k-th largest; ties are all in."""
    cut = deg.select(by).orderBy(F.desc(by)).limit(k).agg(F.min(by).alias("least"))
    return deg.join(F.broadcast(cut), F.col(by) >= F.col("least"), "left_semi")


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in ``keep`` (id)."""
    return edges.join(keep.select(F.col("id").alias("src")), "src", "left_semi").join(keep.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def offsets(counts: DataFrame, block: int = 4096) -> DataFrame:
    """Exclusive running sum of ``n`` by ascending ``id``: inside blocks of ids first, then over the blocks' sums."""
    b = counts.withColumn("block", F.floor(F.col("id") / block))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.coalesce(F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = b.groupBy("block").agg(F.sum("n").alias("total")).select("block", before.alias("before"))
    return b.withColumn("inside", inside).join(sums, "block").select("id", "n", (F.col("before") + F.col("inside")).alias("offset"))


def playable(deg: DataFrame, denied: DataFrame, least_out: int = 10, disambiguation: Column | None = None) -> DataFrame:
    """Nodes with enough links that are neither denied (id) nor disambiguation pages."""
    ok = deg.where(F.col("out_degree") >= least_out)
    if disambiguation is not None:
        ok = ok.where(~disambiguation)
    return ok.join(denied.select("id"), "id", "left_anti")


def thinned(edges: DataFrame, most: int, total: int) -> DataFrame:
    """A deterministic share of the edges by a multiplicative hash of both ends, about ``most`` of ``total``."""
    keep = min(1.0, most / max(1, total))
    h = F.pmod(F.col("src") * F.lit(2654435761) + F.col("dst") * F.lit(40503), F.lit(1 << 20))
    return edges.where(h < int(keep * (1 << 20)))
