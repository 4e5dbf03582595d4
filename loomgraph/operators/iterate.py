"""PageRank, connected components and communities by iteration over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.lineage import cut


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, iterations: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """id, pagerank over directed edges; the mass of nodes without links is spread evenly. Stops at an L1 change
    below ``tolerance``."""
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("pagerank"))
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    e = cut(edges.join(out, "src").select("src", "dst", "out"))
    dangling = cut(nodes.select("id").join(out.select(F.col("src").alias("id")), "id", "left_anti"))
    r = cut(nodes.select("id", F.lit(1.0 / n).alias("pagerank")))
    for _ in range(iterations):
        loose = r.join(dangling, "id", "left_semi").agg(F.sum("pagerank")).first()[0] or 0.0
        sent = e.join(r, e["src"] == r["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("pagerank") / F.col("out")).alias("got"))
        base = (1 - alpha) / n + alpha * loose / n
        new = r.join(sent, "id", "left").select("id", (F.lit(base) + alpha * F.coalesce("got", F.lit(0.0))).alias("new"), "pagerank")
        new = cut(new)
        change = new.agg(F.sum(F.abs(F.col("new") - F.col("pagerank")))).first()[0] if tolerance else 1.0
        r = new.select("id", F.col("new").alias("pagerank"))
        if tolerance and change < tolerance:
            break
    return r


def components(nodes: DataFrame, edges: DataFrame, most: int = 60) -> DataFrame:
    """id, component: the least id that is connected, directions ignored; by alternating large and small stars."""
    e = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        new = cut(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        same = new.count() == e.count() and new.exceptAll(e).isEmpty()
        e = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.select("id").join(e.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def modularity(edges: DataFrame, member: DataFrame, resolution: float = 1.0) -> float:
    """Of an undirected graph (each edge in both directions) under member (id, community)."""
    m2 = edges.count()
    if not m2:
        return 0.0
    j = edges.join(member.withColumnsRenamed({"id": "src", "community": "a"}), "src").join(member.withColumnsRenamed({"id": "dst", "community": "b"}), "dst")
    inside = j.where("a = b").count()
    degree = edges.groupBy("src").count().join(member.withColumnRenamed("id", "src"), "src").groupBy("community").agg(F.sum("count").alias("k"))
    square = degree.agg(F.sum(F.col("k").cast("double") * F.col("k"))).first()[0]
    return inside / m2 - resolution * square / m2 / m2


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 8) -> DataFrame:
    """id, community of an undirected graph (both directions): parallel moves by modularity gain.

    In each round a hash-chosen half of the nodes moves to the neighbouring community of greatest gain, ties to
    the least community; so two neighbours seldom swap. The best round by modularity is returned.
    """
    e = cut(edges)
    m2 = float(max(1, e.count()))
    degree = cut(e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k")))
    member = cut(degree.select("id", F.col("id").alias("community")))
    best, worth = member, modularity(e, member, resolution)
    for turn in range(rounds):
        total = member.join(degree, "id").groupBy("community").agg(F.sum("k").alias("total"))
        near = e.join(member.withColumnsRenamed({"id": "dst", "community": "to"}), "dst").groupBy(F.col("src").alias("id"), "to").agg(F.count("*").alias("links"))
        own = member.join(degree, "id")
        c = near.join(own, "id").join(total.withColumnRenamed("community", "to"), "to")
        gain = F.col("links") - resolution * F.col("k") * (F.col("total") - F.when(F.col("to") == F.col("community"), F.col("k")).otherwise(0)) / m2
        c = c.withColumn("gain", gain)
        pick = c.groupBy("id").agg(F.max(F.struct("gain", (-F.col("to")).alias("minus"))).alias("p"), F.max(F.when(F.col("to") == F.col("community"), F.col("gain"))).alias("stay"))
        moves = pick.where(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0).where(F.col("p.gain") > F.coalesce("stay", F.lit(0.0))).select("id", (-F.col("p.minus")).alias("new"))
        member = cut(member.join(moves, "id", "left").select("id", F.coalesce("new", "community").alias("community")))
        now = modularity(e, member, resolution)
        if now > worth:
            best, worth = member, now
    return best
