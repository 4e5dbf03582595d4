"""Placement and rasters: bounds, normalised positions, spirals, grids, pixel counts, nearest points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.lineage import cut

GOLDEN = 2.39996323
RADIUS = 1000.0


def bounds(points: DataFrame) -> DataFrame:
    """min_x, max_x, min_y, max_y of finite points."""
    ok = points.where(~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    return ok.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def normalized(points: DataFrame) -> DataFrame:
    """id, x, y about the medians, scaled so that the 99.5th percentile of distance is 0.55 x 1000, clamped there."""
    mid = points.agg(F.percentile("x", F.lit(0.5)).alias("mx"), F.percentile("y", F.lit(0.5)).alias("my"))
    p = points.crossJoin(F.broadcast(mid)).select("id", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y")).withColumn("r", F.hypot("x", "y"))
    far = p.agg(F.greatest(F.percentile("r", F.lit(0.995)), F.lit(1e-9)).alias("far"))
    limit = 0.55 * RADIUS
    p = p.crossJoin(F.broadcast(far)).withColumn("s", F.lit(limit) / F.col("far")).withColumn("s", F.when(F.col("r") * F.col("s") > limit, limit / F.col("r")).otherwise(F.col("s")))
    return p.select("id", (F.col("x") * F.col("s")).alias("x"), (F.col("y") * F.col("s")).alias("y"))


def spiral(members: DataFrame, centres: DataFrame, gap: float = 1.0) -> DataFrame:
    """id, x, y around the centre (community, cx, cy) of each community: rank by degree on a golden-angle spiral."""
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "id")) - 1
    m = members.withColumn("rank", rank).join(centres, "community")
    r, a = F.sqrt(F.col("rank")) * gap, F.col("rank") * GOLDEN
    return m.select("id", "community", "rank", (F.col("cx") + r * F.cos(a)).alias("x"), (F.col("cy") + r * F.sin(a)).alias("y"))


def propagate(placed: DataFrame, edges: DataFrame, nodes: DataFrame, rounds: int = 4, jitter: float = 0.0, seed: int = 7) -> DataFrame:
    """Positions of nodes without one: the mean of their placed neighbours' (undirected edges), round by round."""
    p = placed.select("id", "x", "y")
    for k in range(rounds):
        open_ = nodes.select("id").join(p, "id", "left_anti")
        mean = edges.join(p.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
        new = open_.join(mean, "id")
        if jitter:
            new = new.select("id", (F.col("x") + F.randn(seed + k) * jitter).alias("x"), (F.col("y") + F.randn(seed + 99 + k) * jitter).alias("y"))
        p = cut(p.unionByName(new.select("id", "x", "y")))
    return p


def raster(points: DataFrame, width: int, height: int, box: tuple[float, float, float, float]) -> DataFrame:
    """px, py, category, n of finite points (x, y, category) in a box (x0, y0, x1, y1)."""
    x0, y0, x1, y1 = box
    px = F.least(F.floor((F.col("x") - x0) / (x1 - x0) * width), F.lit(width - 1)).cast("bigint")
    py = F.least(F.floor((F.col("y") - y0) / (y1 - y0) * height), F.lit(height - 1)).cast("bigint")
    inside = points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1) & ~F.isnan("x") & ~F.isnan("y"))
    return inside.groupBy(px.alias("px"), py.alias("py"), "category").agg(F.count("*").alias("n"))


def winners(cells: DataFrame) -> DataFrame:
    """px, py, category, n, total, share: the most frequent category of each pixel, ties to the first by name."""
    g = cells.groupBy("px", "py").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("minus"), "category")).alias("b"))
    return g.select("px", "py", F.col("b.category").alias("category"), (-F.col("b.minus")).alias("n"), "total", F.round(-F.col("b.minus") / F.col("total"), 6).alias("share"))


def density(cells: DataFrame, width: int, height: int) -> DataFrame:
    """occupied_pct, max_over_mean, median_over_mean over all pixels, empty ones too."""
    size = width * height
    t = cells.groupBy("px", "py").agg(F.sum("n").alias("n"))
    a = t.agg(F.count("*").alias("used"), F.sum("n").alias("all"), F.max("n").alias("top"), F.sort_array(F.collect_list("n")).alias("each"))
    at = lambda i: F.when(i < size - F.col("used"), F.lit(0)).otherwise(F.get("each", (i - (size - F.col("used"))).cast("int")))
    median = (at(F.lit((size - 1) // 2)) + at(F.lit(size // 2))) / 2.0
    mean = F.col("all") / size
    return a.select(F.round(100.0 * F.col("used") / size, 4).alias("occupied_pct"), F.round(F.col("top") / mean, 4).alias("max_over_mean"), F.round(median / mean, 4).alias("median_over_mean"))


def nearest(queries: DataFrame, points: DataFrame, cell: float | None = None) -> DataFrame:
    """query, id, d2: the nearest point (id, x, y) of each finite query (query, x, y), ties to the least id.

    Points are dealt by grid cell; a query looks into the five by five cells around its own, so no cross join
    arises. Queries whose best is not surely nearer than the unsearched border look again in a grid of four times
    the cell, until one cell would hold all. Without a cell the first grid has about one cell a point. Both joins
    are asked to sort: the planner takes a query's 25 copies for one row, and would send them to every executor.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    left = cut(queries.where(finite("x") & finite("y")).select("query", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    p = points.where(finite("x") & finite("y")).groupBy(F.col("x").cast("double").alias("u"), F.col("y").cast("double").alias("v")).agg(F.min("id").alias("id"))
    p = cut(p)
    n, *box = p.agg(F.count("*"), F.min("u"), F.max("u"), F.min("v"), F.max("v")).first()
    q0, *around = left.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    none = p.limit(0).select(F.lit(None).cast(dict(left.dtypes)["query"]).alias("query"), "id", F.lit(0.0).alias("d2"))
    if not n or not q0:
        return none
    extent = max(max(box[1], around[1]) - min(box[0], around[0]), max(box[3], around[3]) - min(box[2], around[2]))
    start = cell or max(box[1] - box[0], box[3] - box[2]) / n**0.5
    cell = max(start, extent / 2**30) or 1.0  # cells are counted in whole numbers, exactly
    d2 = (F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("v")) * (F.col("y") - F.col("v"))
    found = none
    while True:
        at = lambda c, cell=cell: F.floor(F.col(c) / cell)
        near = lambda c: F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: at(c) + d))  # noqa: B023, E731
        j = left.withColumn("i", near("x")).withColumn("j", near("y")).join(p.withColumn("i", at("u")).withColumn("j", at("v")).hint("merge"), ["i", "j"])
        best = j.groupBy("query").agg(F.min(F.struct(d2.alias("d2"), "id")).alias("b")).select("query", F.col("b.id").alias("id"), F.col("b.d2").alias("d2"))
        last = cell >= extent
        best = cut(best if last else best.where(F.col("d2") < (1.99 * cell) ** 2))
        found = found.unionByName(best)
        if last:
            return found
        left = cut(left.join(best.select("query").hint("merge"), "query", "left_anti"))
        if left.isEmpty():
            return found
        cell *= 4
