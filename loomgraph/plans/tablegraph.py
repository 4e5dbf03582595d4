"""A link graph over relational tables: parts are articles, consecutive items of an order are links.

Nodes: id, title, community, category, size. Edges: distinct (src, dst) without self links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("title"),
        F.col("p_brand").alias("community"), F.col("p_type").alias("category"), F.col("p_size").cast("bigint").alias("size"),
        F.floor("p_retailprice").cast("bigint").alias("views"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    b = a.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst").where("src <> dst").distinct()


def small_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive users of the event stream."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    # neighbours in time order: by day, so that no window holds the whole stream, and across day ends
    day = F.to_date("ts")
    w = Window.partitionBy("day").orderBy("ts", "event_id")
    e = e.select(day.alias("day"), "ts", "event_id", F.col("user_id").alias("src"))
    inner = e.withColumn("dst", F.lead("src").over(w))
    first = e.groupBy("day").agg(F.min_by("src", F.struct("ts", "event_id")).alias("first_src"))
    d = Window.orderBy("day")
    after = first.select("day", F.lead("first_src").over(d).alias("next_src"))
    return inner.join(F.broadcast(after), "day").select("src", F.coalesce("dst", "next_src").alias("dst")).where("dst IS NOT NULL AND src <> dst").distinct()


NODES_SQL = """nodes AS (SELECT p_partkey AS id, p_name || ' ' || p_partkey AS title, p_brand AS community, p_type AS category,
  p_size::BIGINT AS size, floor(p_retailprice)::BIGINT AS views FROM part)"""
EDGES_SQL = """edges AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"""
SMALL_SQL = """small AS (SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events)
  WHERE dst IS NOT NULL AND src <> dst)"""
DEGREE_SQL = """deg AS (SELECT n.*, coalesce(i.c, 0)::BIGINT AS in_degree, coalesce(o.c, 0)::BIGINT AS out_degree FROM nodes n
  LEFT JOIN (SELECT dst, count(*) c FROM edges GROUP BY dst) i ON n.id = i.dst LEFT JOIN (SELECT src, count(*) c FROM edges GROUP BY src) o ON n.id = o.src)"""
GRAPH = f"WITH {NODES_SQL}, {EDGES_SQL}, {DEGREE_SQL} "
RECURSIVE = f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, {DEGREE_SQL}, "
