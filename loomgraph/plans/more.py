"""Registered queries of races and of what is assembled from a graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import SparkSession as S
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import assembly, degrees, pools, puzzles
from loomgraph.operators import search_graph as bfs
from loomgraph.plans.lineage import cut
from loomgraph.plans.queries import COMPONENTS, RANKED, SITES, connected_components, deg, pool, ranked, sites
from loomgraph.plans.registry import query
from loomgraph.plans.tablegraph import GRAPH, NODES_SQL, RECURSIVE, edges, nodes, table
from loomgraph.sources import sinks

# --- races

#: A pool whose par is a claim that the search has to confirm.
CLAIMED = """claimed AS (SELECT CASE id % 2 WHEN 0 THEN 'easy' ELSE 'medium' END AS difficulty, (3 + id % 4)::INT AS par, id AS src,
  (id * 37 + 11) % 1000 AS dst, (id * 31 % 17)::BIGINT AS routes FROM nodes)"""


def board(spark: S, d: str) -> puzzles.Board:
    """Edges and degrees are made once, as a race reads them many times."""
    e = cut(edges(spark, d))
    n = cut(degrees.with_degrees(nodes(spark, d), e).select("id", "in_degree", "out_degree", "community"))
    k = F.col("id")
    claimed = nodes(spark, d).select(
        F.when(k % 2 == 0, "easy").otherwise("medium").alias("difficulty"), (k % 4 + 3).cast("int").alias("par"), k.alias("src"),
        ((k * 37 + 11) % 1000).alias("dst"), (k * 31 % 17).alias("routes"),
    )
    return puzzles.Board(n.select("id", "in_degree", "community"), e, n.where("out_degree >= 10").select("id"), claimed)


def _race_sql(tries: str, ban: int | None, least: int, most: int) -> str:
    """The first of the tries (attempt, src, dst) in range; bans hold inside a path."""
    free = "true" if ban is None else f"(t.in_degree <= {ban} OR e.dst = w.dst)"
    return f"""{tries},
w(attempt, id, dst, dist) AS (SELECT attempt, src, dst, 0 FROM tries UNION SELECT w.attempt, e.dst, w.dst, dist + 1 FROM w JOIN edges e ON e.src = w.id
  JOIN deg t ON t.id = e.dst WHERE dist < {most} AND w.id <> w.dst AND {free}),
f AS (SELECT attempt, min(dist)::INT AS par FROM w WHERE id = dst GROUP BY attempt)
SELECT src, dst, {'NULL' if ban is None else ban}::BIGINT AS ban, par FROM tries JOIN f USING (attempt)
WHERE src <> dst AND par BETWEEN {least} AND {most} ORDER BY attempt LIMIT 1"""


def _drawn_sql(ends: str, numbers: list[int]) -> str:
    drawn = ", ".join(f"({k}, {a}::UBIGINT, {b}::UBIGINT)" for k, (a, b) in enumerate(zip(numbers[::2], numbers[1::2], strict=True)))
    return RECURSIVE + f"""ends AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM ({ends})), size AS (SELECT count(*)::UBIGINT AS n FROM ends),
drawn AS (SELECT * FROM (VALUES {drawn}) v(attempt, a, b)),
tries AS (SELECT attempt, x.id AS src, y.id AS dst FROM drawn CROSS JOIN size JOIN ends x ON x.place = (a % n)::BIGINT JOIN ends y ON y.place = (b % n)::BIGINT)"""


@query(_race_sql(_drawn_sql("SELECT id FROM deg WHERE out_degree >= 10", pools.draws(4242, 120)), 24, 3, 6))
def free_race(spark, d):
    return puzzles.free_race(board(spark, d), 24, 3, 4242)


@query(_race_sql(_drawn_sql("SELECT id FROM deg WHERE out_degree >= 10 AND community = 'Brand#11' AND in_degree <= 1000", pools.draws(77, 120)), 1000, 3, 7))
def region_race(spark, d):
    return puzzles.region_race(board(spark, d), "Brand#11", "hard", 77)


@query(_race_sql(RECURSIVE + "tries AS (SELECT 0 AS attempt, 0::BIGINT AS src, 7::BIGINT AS dst)", 14, 1, 30))
def chosen_race(spark, d):
    return puzzles.chosen_race(board(spark, d), 0, 7, 14)


_PAR_DRAWS = ", ".join(f"({k}, {x}::UBIGINT)" for k, x in enumerate(pools.draws(99, puzzles.POOLED)))


@query(_race_sql(RECURSIVE + CLAIMED + f""", bucket AS (SELECT src, dst, row_number() OVER (ORDER BY routes, src, dst) - 1 AS place FROM claimed WHERE difficulty = 'medium' AND par = 4),
size AS (SELECT count(*)::UBIGINT AS n FROM bucket), drawn AS (SELECT * FROM (VALUES {_PAR_DRAWS}) v(attempt, x)),
tries AS (SELECT attempt, src, dst FROM drawn CROSS JOIN size JOIN bucket ON place = (x % n)::BIGINT)""", 5000, 4, 4))
def race_at_par(spark, d):
    return puzzles.race_at_par(board(spark, d), "medium", 4, 99)


@query()
def course_round(spark, d):
    return puzzles.course(board(spark, d), 20_700, 3)


@query()
def daily_race(spark, d):
    return puzzles.daily_race(board(spark, d), "medium", 18, 20_700)


@query(RECURSIVE + """pairs AS (SELECT id AS src, (id * 37 + 11) % 1000 AS dst FROM nodes WHERE id < 60),
w(src, v, dst, n, len) AS (SELECT src, src, dst, 1::HUGEINT, 0 FROM pairs
  UNION ALL SELECT * FROM (SELECT w.src, e.dst, w.dst, sum(w.n)::HUGEINT, len + 1 FROM w JOIN edges e ON e.src = w.v WHERE len < 3 GROUP BY w.src, e.dst, w.dst, len))
SELECT src, dst, len::INT AS par, least(n, 4294967295)::BIGINT AS routes FROM (SELECT *, min(len) OVER (PARTITION BY src) AS least FROM w WHERE v = dst)
WHERE len = least AND len BETWEEN 2 AND 3""")
def pool_rebucket(spark, d):
    pairs = nodes(spark, d).where("id < 60").select(F.col("id").alias("src"), ((F.col("id") * 37 + 11) % 1000).alias("dst"))
    return puzzles.rebucketed(board(spark, d), pairs, None, 2, 2)


# --- first pass and node tables

PAGES = """pg AS (SELECT id AS ord, category || ' ' || id % 600 AS title, (size % 5)::BIGINT AS ns,
  CASE WHEN id % 7 = 0 THEN category || ' ' || (id * 3) % 700 END AS redirect FROM nodes)"""


def made_pages(spark: S, d: str) -> DataFrame:
    k = F.col("id")
    t = lambda n: F.concat_ws(" ", "category", n.cast("string"))
    return nodes(spark, d).select(k.alias("ord"), t(k % 600).alias("title"), (F.col("size") % 5).alias("ns"), F.when(k % 7 == 0, t(k * 3 % 700)).alias("redirect"))


_HOP = "SELECT h.key, CASE WHEN q.key IS NOT NULL AND q.target IS NOT NULL THEN q.target ELSE h.goal END AS goal FROM {} h LEFT JOIN one q ON h.goal = q.key"


@query("WITH " + NODES_SQL + ", " + PAGES + f""", m AS (SELECT * FROM pg WHERE ns = 0),
one AS (SELECT title AS key, count(*) AS n, count(redirect) AS r, arg_max(redirect, ord) FILTER (redirect IS NOT NULL) AS target FROM m GROUP BY title),
h0 AS (SELECT key, target AS goal FROM one WHERE target IS NOT NULL), h1 AS ({_HOP.format('h0')}), h2 AS ({_HOP.format('h1')}), h3 AS ({_HOP.format('h2')}), h4 AS ({_HOP.format('h3')}),
b AS (SELECT count(*) AS broken FROM h4 WHERE goal NOT IN (SELECT key FROM one WHERE target IS NULL))
SELECT (SELECT count(*) FROM pg)::BIGINT AS pages, sum(n)::BIGINT AS ns0_pages, sum(n - r)::BIGINT AS articles, sum(r)::BIGINT AS redirects,
  (SELECT broken FROM b)::BIGINT AS broken_redirects, (sum(n) - count(*))::BIGINT AS duplicate_titles FROM one""")
def first_pass(spark, d):
    return assembly.first_pass(made_pages(spark, d))


@query("WITH " + NODES_SQL + ", " + PAGES + """ SELECT title, title AS key FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY ord) AS nth FROM pg WHERE ns = 0)
WHERE nth > 1 ORDER BY ord LIMIT 50""")
def title_collisions(spark, d):
    return assembly.collisions(made_pages(spark, d))


@query("WITH p AS (SELECT page_id, coalesce(regexp_extract(html, '<title>([^<]*)', 1), '') || '&#' || (65 + page_id % 5000) || ';&#x' || format('{:x}', 8000 + page_id % 300) || ';&amp;lt;&nosuch;&#0;& b' AS s FROM pages),"
""" l AS (SELECT page_id, string_split(s, '&') AS x FROM p),
c AS (SELECT page_id, x[1] AS head, list_transform(x[2:], lambda v: CASE
  WHEN regexp_matches(v, '^#[0-9]{1,7};') AND regexp_extract(v, '^#([0-9]+);', 1)::INT > 0 THEN {'t': chr(regexp_extract(v, '^#([0-9]+);', 1)::INT) || substr(v, strpos(v, ';') + 1), 'u': 0}
  WHEN regexp_matches(v, '^#x[0-9a-f]{1,6};') THEN {'t': chr(('0x' || regexp_extract(v, '^#x([0-9a-f]+);', 1))::INT) || substr(v, strpos(v, ';') + 1), 'u': 0}
  WHEN v LIKE 'amp;%' THEN {'t': '&' || substr(v, 5), 'u': 0} WHEN v LIKE 'lt;%' THEN {'t': '<' || substr(v, 4), 'u': 0} WHEN v LIKE 'gt;%' THEN {'t': '>' || substr(v, 4), 'u': 0}
  WHEN v LIKE 'quot;%' THEN {'t': '"' || substr(v, 6), 'u': 0} WHEN v LIKE 'apos;%' THEN {'t': '''' || substr(v, 6), 'u': 0}
  WHEN regexp_matches(v, '^[^&;]{1,32};') THEN {'t': '&' || v, 'u': 1} ELSE {'t': '&' || v, 'u': 0} END) AS y FROM l)
SELECT page_id, head || list_aggregate(list_transform(y, lambda v: v.t), 'string_agg', '') AS text, list_sum(list_transform(y, lambda v: v.u))::BIGINT AS unresolved FROM c""")
def decode_references(spark, d):
    k = F.col("page_id")
    s = F.concat(F.coalesce(F.regexp_extract("html", "<title>([^<]*)", 1), F.lit("")), F.lit("&#"), (k % 5000 + 65).cast("string"), F.lit(";&#x"), F.lower(F.hex(k % 300 + 8000)), F.lit(";&amp;lt;&nosuch;&#0;& b"))
    return table(spark, d, "pages").select("page_id", T.decode_references(s).alias("r")).select("page_id", "r.text", F.col("r.unresolved").cast("bigint").alias("unresolved"))


@query(COMPONENTS + """, s AS (SELECT component, count(*) AS size FROM c GROUP BY component)
SELECT component, size::BIGINT AS size, size / (SELECT sum(size) FROM s)::DOUBLE AS share, row_number() OVER (ORDER BY size DESC, component) = 1 AS giant FROM s""")
def component_sizes(spark, d):
    return assembly.component_sizes(connected_components(spark, d))


@query(RANKED + ", " + SITES + " SELECT id AS vertex, x, y, pagerank, n.title FROM sites s LEFT JOIN (SELECT * FROM ranked WHERE in_degree > 5) r USING (id) JOIN (SELECT id, title FROM nodes) n USING (id)")
def node_table(spark, d):
    r = ranked(spark, d)
    return assembly.assembled(sites(spark, d).withColumnRenamed("id", "vertex"), r.where("in_degree > 5").select(F.col("id").alias("vertex"), "pagerank"), r.select("id", "title"))


@query(RANKED + """, c AS (SELECT id FROM ranked WHERE pagerank >= (SELECT min(pagerank) FROM (SELECT pagerank FROM ranked ORDER BY pagerank DESC LIMIT (SELECT greatest(2, floor(count(*) * 0.1))::BIGINT FROM nodes))))
SELECT src, dst FROM edges WHERE src IN (SELECT id FROM c) AND dst IN (SELECT id FROM c)""")
def backbone_edges(spark, d):
    r = ranked(spark, d)
    return assembly.backbone(r, edges(spark, d), 0.1)


@query(GRAPH + "SELECT id, in_degree FROM deg WHERE in_degree <= 20 AND id IN (SELECT dst FROM edges WHERE src = 7) ORDER BY in_degree DESC, id LIMIT 24")
def explorer(spark, d):
    return assembly.explorer(edges(spark, d), deg(spark, d).select("id", "in_degree"), 7, 20)


@query(GRAPH + "SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS n FROM edges) WHERE n % 3 = 0 AND n < 3 * 1500")
def segment_thinning(spark, d):
    return assembly.thinned_list(edges(spark, d), "src", "dst", 3)


@query("WITH " + NODES_SQL + " SELECT id, title FROM nodes WHERE contains(lower(title), 'steel') OR contains(lower(title), '12')")
def title_filter(spark, d):
    n = nodes(spark, d).select("id", "title")
    return assembly.named(n, " STEEL ").unionByName(assembly.named(n, "12")).distinct()


@query("WITH " + NODES_SQL + """, t AS (SELECT community FROM nodes GROUP BY community ORDER BY count(*) DESC, community LIMIT 8)
SELECT id, CASE WHEN community NOT IN (SELECT community FROM t) THEN 'Other' WHEN right(community, 1) = '1' THEN 'Cluster ' || community ELSE 'Region ' || community END AS label FROM nodes""")
def category_labels(spark, d):
    n = nodes(spark, d)
    name = F.when(~F.endswith("community", F.lit("1")), F.concat(F.lit("Region "), "community"))
    top = n.groupBy("community").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "community").limit(8).select("community", F.lit(True).alias("kept"), name.alias("name"))
    return n.join(F.broadcast(top), "community", "left").select("id", assembly.category(F.col("community"), F.col("name"), F.coalesce("kept", F.lit(False))).alias("label"))


@query("SELECT event_id, (CASE WHEN n >= 1 THEN n END)::INT AS number FROM (SELECT event_id, (epoch(ts)::BIGINT // 86400)::BIGINT + 900 - 20683 + 1 AS n FROM events)")
def daily_numbers(spark, d):
    return table(spark, d, "events").select("event_id", assembly.daily_number(F.date_add(F.date_from_unix_date(T.rounded_day(F.col("ts")).cast("int")), 900)).alias("number"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN (o_orderkey * 1000003)::HUGEINT::DECIMAL(20,0) END AS run FROM orders")
def run_ids(spark, d):
    k = F.col("o_orderkey")
    n = (k * 1000003).cast("string")
    told = F.when(k % 4 == 0, n).when(k % 4 == 1, F.concat(F.lit(" "), n, F.lit(" "))).when(k % 4 == 2, F.concat(F.lit("000"), n)).otherwise(F.concat(F.lit("-"), n))
    return table(spark, d, "orders").select("o_orderkey", assembly.run_id(told).alias("run"))


@query(GRAPH + ", " + SITES + """ SELECT (SELECT count(*) FROM nodes)::BIGINT AS articles, (SELECT count(*) FROM edges)::BIGINT AS edges, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y,
  20700 AS day, 18 AS daily, true AS layout, false AS pools FROM sites""")
def meta_document(spark, d):
    return assembly.meta_document(nodes(spark, d), edges(spark, d), sites(spark, d), 20_700, {"layout": True, "pools": False})


@query("WITH " + NODES_SQL + """, n AS (SELECT community, min(category) AS name FROM nodes GROUP BY community)
SELECT '{' || string_agg('"' || community || '":"' || name || '"', ',' ORDER BY community) || '}' AS doc FROM n""")
def regions_document(spark, d):
    return assembly.regions_document(nodes(spark, d).groupBy("community").agg(F.min("category").alias("name")))


@query(RECURSIVE + """b(id, dist) AS (SELECT 7, 0 UNION SELECT e.src, dist + 1 FROM b JOIN edges e ON e.dst = b.id WHERE dist < 2)
SELECT id::BIGINT AS id, min(dist)::INT AS dist FROM b GROUP BY id HAVING min(dist) > 0""")
def compass_round_trip(spark, d):
    levels = bfs.levels(edges(spark, d), 7, 2, 10**9)
    return sinks.read_compass(sinks.compass_document(levels, spark)).select("id", F.col("dist").cast("int").alias("dist"))


_VIEWS = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'de.wikipedia' ELSE 'en.wikipedia' END AS project, 'Part_' || (o_custkey % 3000) AS title, o_orderkey % 90 AS n FROM orders"


@query(f"""WITH v AS ({_VIEWS}), t AS (SELECT p_partkey AS id, 'Part ' || p_partkey AS title FROM part),
j AS (SELECT id FROM v LEFT JOIN t ON replace(v.title, '_', ' ') = t.title WHERE project = 'en.wikipedia')
SELECT count(*)::BIGINT AS seen, count(id)::BIGINT AS matched, count(DISTINCT id)::BIGINT AS viewed, (SELECT count(*) FROM t)::BIGINT AS articles,
  round(100.0::DOUBLE * count(DISTINCT id) / (SELECT count(*) FROM t), 4) AS coverage_pct FROM j""")
def view_coverage(spark, d):
    k = F.col("o_orderkey")
    line = F.concat_ws(" ", F.when(k % 5 == 0, "de.wikipedia").otherwise("en.wikipedia"), F.concat(F.lit("Part_"), (F.col("o_custkey") % 3000).cast("string")), F.lit("1"), F.lit("desktop"), (k % 90).cast("string"))
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("title"))
    return assembly.view_coverage(table(spark, d, "orders").select(line.alias("value")), t, t.limit(0).withColumnRenamed("title", "alias"))


@query()
def review_set(spark, d):
    p = pool(spark, d).where("par < 6")
    t = lambda c: F.concat(F.lit("Article "), F.col(c).cast("string"))
    return assembly.review(p.select("difficulty", "src", "dst", t("src").alias("src_title"), t("dst").alias("dst_title"), (F.col("src") % 977 + F.col("dst") % 89).alias("views")), [("Article 1", "Article 37")])


_THIN = GRAPH + """, thin AS (SELECT src, dst FROM edges WHERE (src * 2654435761 + dst * 40503) % 1048576 < 131072),
tdeg AS (SELECT id, (SELECT count(*) FROM thin WHERE dst = id)::BIGINT AS in_degree, (SELECT count(*) FROM thin WHERE src = id)::BIGINT AS out_degree FROM nodes) """


def thin_degrees(spark: S, d: str) -> DataFrame:
    return degrees.with_degrees(nodes(spark, d), degrees.thinned(edges(spark, d), 1, 8))


@query(_THIN + "SELECT id, out_degree FROM tdeg WHERE in_degree = 0 ORDER BY out_degree DESC, id LIMIT 10")
def orphans(spark, d):
    """Articles that none links to, in the thinned graph."""
    return thin_degrees(spark, d).where("in_degree = 0").orderBy(F.desc("out_degree"), "id").limit(10).select("id", "out_degree")


@query(_THIN + "SELECT id, in_degree FROM tdeg WHERE out_degree = 0 ORDER BY in_degree DESC, id LIMIT 10")
def dead_ends(spark, d):
    """Articles that link to none, in the thinned graph."""
    return thin_degrees(spark, d).where("out_degree = 0").orderBy(F.desc("in_degree"), "id").limit(10).select("id", "in_degree")


