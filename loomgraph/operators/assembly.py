"""What is put together from a graph's tables: first-pass counters, node tables, backbones, documents, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators.degrees import core, induced
from loomgraph.operators.ingest import redirect_closure
from loomgraph.operators.pools import EPOCH_DAY
from loomgraph.operators.regions import resolve_index
from loomgraph.plans.lineage import cut

#: Collisions that are told, articles that an explorer shows, points of a segment, races of a review.
COLLISIONS, SHOWN, SEGMENT, REVIEWED = 50, 24, 1500, 20


def _main(pages: DataFrame) -> DataFrame:
    return pages.where("ns = 0").withColumn("key", T.normalize_title(F.col("title"))).where("key IS NOT NULL")


def first_pass(pages: DataFrame) -> DataFrame:
    """One row of counts of pages (ord, title, ns, redirect): pages, ns0_pages, articles, redirects, broken_redirects,
    duplicate_titles. A title that any page redirects is a redirect; it is broken if it ends at no article."""
    m = _main(pages)
    by = m.groupBy("key").agg(
        F.count("*").alias("n"), F.count("redirect").alias("r"),
        F.max_by(T.normalize_title(F.col("redirect")), F.when(F.col("redirect").isNotNull(), F.col("ord"))).alias("target"),
    )
    by = by.withColumn("target", F.when(F.col("r") > 0, F.coalesce("target", F.lit(""))))
    broken = redirect_closure(by.select("key", "target")).agg(F.count_if(F.col("is_redirect") & F.col("final").isNull()).alias("broken_redirects"))
    n = F.coalesce(F.sum("n"), F.lit(0))
    r = F.coalesce(F.sum("r"), F.lit(0))
    one = by.agg(n.alias("ns0_pages"), (n - r).alias("articles"), r.alias("redirects"), (n - F.count("*")).alias("duplicate_titles"))
    every = pages.agg(F.count("*").alias("pages"))
    return every.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(broken)).select("pages", "ns0_pages", "articles", "redirects", "broken_redirects", "duplicate_titles")


def collisions(pages: DataFrame, most: int = COLLISIONS) -> DataFrame:
    """title, key of the first pages, by ord, whose key an earlier page has."""
    first = F.row_number().over(Window.partitionBy("key").orderBy("ord"))
    return _main(pages).withColumn("nth", first).where("nth > 1").orderBy("ord").limit(most).select("title", "key")


def component_sizes(member: DataFrame) -> DataFrame:
    """component, size, share of all nodes, giant (the largest, ties by least id) of member (id, component)."""
    by = member.groupBy("component").agg(F.count("*").alias("size"))
    whole = by.agg(F.sum("size").alias("total"), F.max(F.struct("size", (-F.col("component")).alias("minus"))).alias("top"))
    giant = (F.col("size") == F.col("top.size")) & (F.col("component") == -F.col("top.minus"))
    return by.crossJoin(F.broadcast(whole)).select("component", "size", (F.col("size") / F.col("total")).alias("share"), giant.alias("giant"))


def assembled(layout: DataFrame, metrics: DataFrame, titles: DataFrame) -> DataFrame:
    """Nodes placed (vertex, x, y) with their metrics (vertex, ...), where there are any, and title (id, title).

    A placed vertex without a title is an error, found by a count before the table is given.
    """
    lost = layout.join(titles.select(F.col("id").alias("vertex")), "vertex", "left_anti").count()
    if lost:
        raise ValueError(f"{lost} placed vertices have no title")
    return layout.join(metrics, "vertex", "left").join(titles.select(F.col("id").alias("vertex"), "title"), "vertex")


def backbone(nodes: DataFrame, edges: DataFrame, share: float, by: str = "pagerank") -> DataFrame:
    """Edges among the top ``share`` of the nodes by a value; two nodes at least; ties are all in."""
    k = max(2, int(nodes.count() * share))
    return induced(edges, core(nodes.select("id", by), by, k))


def explorer(edges: DataFrame, deg: DataFrame, id_: int, ban: int | None, most: int = SHOWN) -> DataFrame:
    """id, in_degree of an article's links that are not banned, those of highest in-degree."""
    near = edges.where(F.col("src") == id_).select(F.col("dst").alias("id"))
    ok = deg if ban is None else deg.where(F.col("in_degree") <= ban)
    return ok.join(near, "id", "left_semi").orderBy(F.desc("in_degree"), "id").limit(most).select("id", "in_degree")


def thinned_list(rows: DataFrame, by: str, order: str, step: int, most: int = SEGMENT) -> DataFrame:
    """Every ``step``-th row of each group in order, at most ``most`` of a group."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return rows.withColumn("_n", nth).where((F.col("_n") % step == 0) & (F.col("_n") < step * most)).drop("_n")


def named(rows: DataFrame, part: str) -> DataFrame:
    """Rows whose title has the part, whatever its case; all for a blank part."""
    q = part.strip().lower()
    return rows.where(F.contains(F.lower("title"), F.lit(q))) if q else rows


def category(community: Column, name: Column, kept: Column) -> Column:
    """A community's name, Cluster and its id where it has none, Other where it is not kept."""
    return F.when(kept, F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Cluster "), community.cast("string")))).otherwise(F.lit("Other"))


def daily_number(ts: Column) -> Column:
    """The number, from 1, of a time's daily race; none before the first."""
    n = F.unix_date(F.to_date(ts)) - EPOCH_DAY + 1
    return F.when(n >= 1, n)


def run_id(told: Column) -> Column:
    """A run's id, told as a number or as text; null unless it is an unsigned 64-bit number."""
    n = F.trim(told.cast("string")).try_cast("decimal(20,0)")
    return F.when(F.trim(told.cast("string")).rlike("^[0-9]{1,20}$") & (n <= F.lit(str((1 << 64) - 1)).cast("decimal(20,0)")), n)


def issued(numbers: DataFrame, secret: int) -> DataFrame:
    """number, run: an opaque id for each running number."""
    return numbers.select("number", F.abs(F.xxhash64("number", F.lit(secret))).alias("run"))


def sampled(edges: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """Each edge with the given probability, decided by a hash of its ends, so reruns agree whatever the partitions."""
    h = F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1 << 30))
    return edges.where(h < int(min(1.0, max(0.0, share)) * (1 << 30)))


def view_coverage(lines: DataFrame, titles: DataFrame, aliases: DataFrame, project: str = "en.wikipedia") -> DataFrame:
    """One row about a view dump (value): lines of the project seen, and matched to articles; articles, with views, share."""
    p = F.split("value", " ")
    d = lines.where(F.startswith("value", F.lit(project + " "))).select(T.normalize_dump_title(F.get(p, F.lit(1))).alias("key"), F.get(p, F.lit(4)).try_cast("bigint").alias("n")).where("n IS NOT NULL")
    j = d.join(resolve_index(titles, aliases), "key", "left")
    one = j.agg(F.count("*").alias("seen"), F.count("id").alias("matched"), F.countDistinct("id").alias("viewed"))
    n = titles.agg(F.countDistinct("id").alias("articles"))
    return one.crossJoin(F.broadcast(n)).withColumn("coverage_pct", F.round(100.0 * F.col("viewed") / F.col("articles"), 4))


def meta_document(nodes: DataFrame, edges: DataFrame, points: DataFrame, day: int, capable: dict[str, bool]) -> DataFrame:
    """One row of what a client asks first: articles, edges, bounds of the map, day and daily number, capabilities."""
    n, e = nodes.agg(F.count("*").alias("articles")), edges.agg(F.count("*").alias("edges"))
    box = points.agg(*[f(c).alias(f"{name}_{c}") for c in ("x", "y") for name, f in (("min", F.min), ("max", F.max))])
    out = n.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(box))
    return out.select("*", F.lit(day).alias("day"), F.lit(day - EPOCH_DAY + 1).alias("daily"), *[F.lit(v).alias(k) for k, v in sorted(capable.items())])


def regions_document(names: DataFrame) -> DataFrame:
    """One row, doc: the regions' names as a JSON object by region. Regions are few thousand at most."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col("community").cast("string").alias("key"), F.col("name").alias("value"))))
    return names.agg(F.to_json(F.map_from_entries(pairs)).alias("doc"))


def review(races: DataFrame, showcase: list[tuple[str, str]], most: int = REVIEWED, seed: int = 20_261_001) -> DataFrame:
    """src, dst, difficulty, reason: races (difficulty, src, dst, src_title, dst_title, views) that people should look at.

    First those of the showcase, then of each difficulty the two with the least views and the first with the end that
    recurs most; then others by hash, till there are ``most``.
    """
    listed = F.lit(False)
    for a, b in showcase:
        listed = listed | ((F.col("src_title") == a) & (F.col("dst_title") == b))
    # a number for each race, as races may recur; then a few rows are found by aggregates, so that no task holds a difficulty
    r = cut(races.select("difficulty", "src", "dst", "views", F.coalesce(listed, F.lit(False)).alias("listed"), F.monotonically_increasing_id().alias("row")).where("difficulty IS NOT NULL"))
    ends = r.select("difficulty", F.explode(F.array("src", "dst")).alias("end")).groupBy("difficulty", "end").agg(F.count("*").alias("n"))
    top = ends.groupBy("difficulty").agg(F.max(F.struct("n", (-F.col("end")).alias("minus"))).alias("top")).select("difficulty", (-F.col("top.minus")).alias("often"))
    whole = F.struct("difficulty", "src", "dst", "views", "listed", "row").alias("whole")
    by_views = F.struct("views", "src", "dst", "row")
    least = r.groupBy("difficulty").agg(F.min(F.struct(by_views.alias("at"), whole)).alias("b"))
    second = r.join(F.broadcast(least.select("difficulty", F.col("b.at").alias("first"))), "difficulty").where(by_views > F.col("first"))
    second = second.groupBy("difficulty").agg(F.min(F.struct(by_views.alias("at"), whole)).alias("b"))
    has = (F.col("src") == F.col("often")) | (F.col("dst") == F.col("often"))
    one = r.join(F.broadcast(top), "difficulty").where(has).groupBy("difficulty").agg(F.min(F.struct(F.struct("src", "dst", "row").alias("at"), whole)).alias("b"))
    told = lambda df, reason, order: df.select("b.whole.*", F.lit(reason).alias("reason"), F.lit(order).alias("o"))
    special = told(least, "least familiar", 0).unionByName(told(second, "least familiar", 0)).unionByName(told(one, "repeated end", 1))
    special = special.where(~F.col("listed")).groupBy("row").agg(F.min(F.struct("o", "difficulty", "src", "dst", "reason")).alias("b")).select("row", "b.difficulty", "b.src", "b.dst", "b.reason")
    special = cut(special)  # three rows a difficulty at most
    h = F.md5(F.concat_ws(":", "difficulty", "src", "dst", F.lit(str(seed))))
    out = r.where("listed").select("row", "difficulty", "src", "dst", F.lit("showcase").alias("reason")).orderBy(h, "row").limit(most)
    rest = r.where("NOT listed").join(F.broadcast(special.select("row")), "row", "left_anti").select("row", "difficulty", "src", "dst", F.lit("spot check").alias("reason")).orderBy(h, "row").limit(most)
    out = out.unionByName(special).unionByName(rest).withColumn("rank", F.when(F.col("reason") == "spot check", 1).otherwise(0))
    return out.orderBy("rank", h, "row").limit(most).select("difficulty", "src", "dst", "reason")
