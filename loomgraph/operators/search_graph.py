"""Breadth-first operators: distances, levels, shortest paths and their number, many sources at once.

Frontiers are tables keyed by (source, node), so one loop of small jobs serves any number of sources. Depth is
bounded, the frontier is deduplicated before it is stored, and every level is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.lineage import cut, fit

#: Path counts saturate here.
MOST = 18446744073709551615


def distances(edges: DataFrame, sources: DataFrame, max_depth: int, banned: DataFrame | None = None, reverse: bool = False) -> DataFrame:
    """source, id, dist for every node within ``max_depth`` of each source (column id).

    ``banned`` (id) are never entered; sources are exempt. ``reverse`` follows links backwards.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    e = edges.select(F.col(a).alias("id"), F.col(b).alias("next"))
    if banned is not None:
        banned = cut(banned.select("id"))
        e = e.join(banned.withColumnRenamed("id", "next"), "next", "left_anti")
    e = cut(e)
    level = cut(sources.select(F.col("id").alias("source"), "id").distinct().withColumn("dist", F.lit(0)))
    seen = level
    for d in range(1, max_depth + 1):
        step = level.join(e, "id").select("source", F.col("next").alias("id")).distinct()
        level = cut(step.join(seen.select("source", "id"), ["source", "id"], "left_anti").select("source", "id").withColumn("dist", F.lit(d)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def levels(edges: DataFrame, goal: int, max_depth: int, cap: int) -> DataFrame:
    """id, dist of complete levels towards ``goal``, the goal left out.

    Level 1 is always whole; a later level is left out, and all after it, if the nodes told so far with it
    exceed ``cap``.
    """
    spark = edges.sparkSession
    d = cut(distances(edges, spark.range(goal, goal + 1), max_depth, reverse=True).where("dist > 0").select("id", "dist"))
    sizes = {r["dist"]: r["count"] for r in d.groupBy("dist").count().collect()}  # at most max_depth rows
    last, told = 0, 0
    for k in sorted(sizes):
        told += sizes[k]
        if k > 1 and told > cap:
            break
        last = k
    return d.where(F.col("dist") <= last)


def path_counts(edges: DataFrame, pairs: DataFrame, max_depth: int, banned: DataFrame | None = None) -> DataFrame:
    """pair_id, length, paths: the length and number of shortest paths of each pair (pair_id, src, dst).

    Both ends are exempt from ``banned``. Pairs farther apart than ``max_depth`` are absent; src = dst has
    length 0 and no path to count. Counts saturate at MOST. Frontiers are walked from either end in turn; a pair is at
    as many links as levels were walked when its two last levels first share a node, each of its shortest paths
    crosses them at one node, and it is walked no farther.
    """
    e = cut(edges)
    banned = None if banned is None else cut(banned.select("id"))
    n_banned = banned.count() if banned is not None else 0
    most = F.lit(str(MOST)).cast("decimal(38,0)")
    p = cut(pairs.select("pair_id", "src", "dst"))
    product = F.least(F.col("n").cast("double") * F.col("m").cast("double"), F.lit(float(MOST)))
    exact = F.when(product < 9e15, (F.col("n").cast("bigint") * F.col("m").cast("bigint")).cast("decimal(38,0)")).otherwise(most)

    def start(a: str, b: str) -> dict:
        level = p.select("pair_id", F.col(a).alias("v"), F.col(b).alias("goal"), F.lit(1).cast("decimal(38,0)").alias("n"))
        return {"by": a, "to": b, "level": level, "rows": p.count(), "seen": level.select("pair_id", "v"), "told": p.count()}

    def walk(x: dict) -> None:
        links = e.select(F.col(x["by"]).alias("v"), F.col(x["to"]).alias("w"))
        step = links.join(fit(x["level"], x["rows"]), "v").groupBy("pair_id", F.col("w").alias("v"), "goal").agg(F.sum("n").alias("n"))
        step = step.join(fit(x["seen"], x["told"]), ["pair_id", "v"], "left_anti")
        if n_banned:
            bad = banned.select(F.col("id").alias("v"), F.lit(True).alias("bad"))
            step = step.join(fit(bad, n_banned), "v", "left").where("bad IS NULL OR v = goal")
        x["level"] = cut(step.select("pair_id", "v", "goal", F.least("n", most).cast("decimal(38,0)").alias("n")))
        x["rows"] = x["level"].count()
        x["seen"], x["told"] = x["seen"].unionByName(x["level"].select("pair_id", "v")), x["told"] + x["rows"]

    f, g = start("src", "dst"), start("dst", "src")
    out = None
    for length in range(max_depth + 1):
        if length:
            walk(f if length % 2 else g)
        less, more = sorted((f, g), key=lambda x: x["rows"])
        other = less["level"].select("pair_id", "v", F.col("n").alias("m"))
        met = more["level"].join(fit(other, less["rows"]), ["pair_id", "v"])
        met = cut(met.groupBy("pair_id").agg(F.least(F.sum(exact), most).alias("paths")).select("pair_id", F.lit(length).alias("length"), "paths"))
        out = met if out is None else out.unionByName(met)
        n = met.count()
        for x in (f, g) if n else ():
            x["level"] = cut(x["level"].join(fit(met.select("pair_id"), n), "pair_id", "left_anti"))
            x["rows"] = x["level"].count()
        if not f["rows"] or not g["rows"]:
            break
    return out.select("pair_id", "length", F.when(F.col("length") == 0, F.lit(1)).otherwise(F.col("paths")).cast("decimal(20,0)").alias("paths"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int, banned: DataFrame | None = None) -> DataFrame:
    """pair_id, length, path: of each pair (pair_id, src, dst) the shortest path with the least predecessors.

    Walking forward, a node's predecessor is its least one on a shortest path; so results don't depend on the
    order of edges. Ends are exempt from ``banned``; pairs without a path within ``max_depth`` are absent.
    """
    e = cut(edges)
    p = cut(pairs.select("pair_id", "src", "dst"))
    banned = None if banned is None else cut(banned.select("id"))
    level = p.select("pair_id", F.col("src").alias("v"), F.array("src").alias("path"), "dst")
    seen = level.select("pair_id", "v")
    done = level.where("v = dst").select("pair_id", F.lit(0).alias("length"), "path")
    level = level.where("v <> dst")
    for k in range(1, max_depth + 1):
        step = level.join(e.select(F.col("src").alias("v"), F.col("dst").alias("w")), "v")
        if banned is not None:
            bad = banned.select(F.col("id").alias("w"), F.lit(True).alias("bad"))
            step = step.join(bad, "w", "left").where("bad IS NULL OR w = dst").drop("bad")
        step = step.groupBy("pair_id", "w", "dst").agg(F.min_by("path", "v").alias("path")).withColumnRenamed("w", "v")
        step = step.join(seen, ["pair_id", "v"], "left_anti").withColumn("path", F.concat("path", F.array("v")))
        step = cut(step)
        if step.isEmpty():
            break
        hit = step.where("v = dst")
        done = done.unionByName(hit.select("pair_id", F.lit(k).alias("length"), "path"))
        seen = seen.unionByName(step.select("pair_id", "v"))
        # a pair that has arrived walks no farther
        level = step.join(hit.select("pair_id"), "pair_id", "left_anti")
    return done


def check_paths(paths: DataFrame, edges: DataFrame, runs: DataFrame, n_nodes: int, banned: DataFrame, longest: int = 500) -> DataFrame:
    """run_id, verdict of played paths (run_id, path) against runs (run_id, start, goal).

    Verdicts in order of precedence: id_out_of_range, too_long, wrong_start, wrong_goal, broken_link,
    banned_article (inside the path only), ok.
    """
    p = paths.join(runs, "run_id")
    hops = p.select("run_id", F.posexplode(F.arrays_zip(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("a"), F.slice("path", 2, F.size("path")).alias("b"))).alias("pos", "hop"))
    hops = hops.select("run_id", "pos", F.col("hop.a").alias("src"), F.col("hop.b").alias("dst"))
    broken = hops.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").groupBy("run_id").agg(F.min("pos").alias("broken_at"))
    inner = p.select("run_id", F.explode(F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0)))).alias("id"))
    bad = inner.join(banned.select("id"), "id", "left_semi").groupBy("run_id").agg(F.count("*").alias("n_banned"))
    verdict = (
        F.when(F.exists("path", lambda x: (x < 0) | (x >= n_nodes)), "id_out_of_range")
        .when(F.size("path") > longest, "too_long")
        .when(F.coalesce(F.get("path", F.lit(0)) != F.col("start"), F.lit(True)), "wrong_start")
        .when(F.element_at("path", -1) != F.col("goal"), "wrong_goal")
        .when(F.col("broken_at").isNotNull(), "broken_link")
        .when(F.col("n_banned") > 0, "banned_article")
        .otherwise("ok")
    )
    return p.join(broken, "run_id", "left").join(bad, "run_id", "left").select("run_id", verdict.alias("verdict"))
