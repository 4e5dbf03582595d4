"""Writers: graph tables, exports, static documents, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import cut_bytes, delta_encode

SHARD = 896


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet with zstd; ``by`` sorts inside files, so that their ranges of that column prune reads."""
    (df.sortWithinPartitions(by) if by else df).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Twice, dealt and sorted by either end, so that both directions of a lookup prune."""
    for a in ("src", "dst"):
        write_table(edges.repartition(a), f"{path}/by_{a}", a)


def write_gephi(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.select(F.col("id").alias("Id"), F.col("title").alias("Label"), "community", "pagerank").write.mode("overwrite").option("header", True).csv(f"{path}/nodes")
    edges.select(F.col("src").alias("Source"), F.col("dst").alias("Target")).write.mode("overwrite").option("header", True).csv(f"{path}/edges")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def shards(nodes: DataFrame, edges: DataFrame, size: int = SHARD) -> DataFrame:
    """shard, doc: a JSON document of the articles of each range of ids.

    ``a`` has [id, title, description, flags, views, community, degree, [targets as differences]] of each
    article; ``d`` has, for the distinct targets with either, their description and flags. nodes: id, title,
    description, flags, views, community, degree.
    """
    s = lambda c: F.floor(F.col(c) / size).alias("shard")
    out = edges.groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("ids"))
    j = F.to_json
    a = nodes.join(out, "id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
    text = lambda c: F.expr(f"substring(to_json(named_struct('x', coalesce({c}, ''))), 6, length(to_json(named_struct('x', coalesce({c}, '')))) - 6)")
    row = F.concat(
        F.lit("["), F.concat_ws(",", F.col("id").cast("string"), text("title"), text("description"), F.coalesce("flags", F.lit(0)).cast("string"), F.coalesce("views", F.lit(0)).cast("string"), text("cast(community as string)"), F.coalesce("degree", F.lit(0)).cast("string"), j(delta_encode(F.col("ids")))), F.lit("]"),
    )
    art = a.groupBy(s("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("id", row.alias("row")))), lambda x: x["row"]).alias("rows"))
    seen = edges.select(s("src"), F.col("dst").alias("id")).distinct().join(nodes.select("id", "description", "flags"), "id").where("coalesce(description, '') <> '' OR coalesce(flags, 0) <> 0")
    dic = seen.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(F.col("id"), cut_bytes(F.coalesce("description", F.lit("")), 120).alias("description"), F.coalesce("flags", F.lit(0)).alias("flags")))).alias("d"))
    return art.join(dic, "shard", "left").select("shard", F.concat(F.lit('{"a":['), F.concat_ws(",", "rows"), F.lit('],"d":'), j(F.coalesce("d", F.from_json(F.lit("[]"), "array<struct<id:bigint,description:string,flags:bigint>>"))), F.lit("}")).alias("doc"))


def read_shards(docs: DataFrame) -> DataFrame:
    """id, title, targets of shard documents, decoded."""
    from loomgraph.functions.text import delta_decode

    a = docs.select(F.explode(F.from_json(F.get_json_object("doc", "$.a"), "array<array<string>>")).alias("r"))
    ids = F.from_json(F.get("r", F.lit(7)), "array<bigint>")
    return a.select(F.get("r", F.lit(0)).cast("bigint").alias("id"), F.get("r", F.lit(1)).alias("title"), delta_decode(ids).alias("targets"))


def write_documents(docs: DataFrame, path: str, key: str) -> None:
    """One text file folder for each key."""
    docs.select(F.col(key), F.col("doc").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def compass_document(levels: DataFrame, spark: SparkSession) -> DataFrame:
    """doc of levels (id, dist): {d: deepest level, l: [ids of each level as differences]}."""
    by = levels.groupBy("dist").agg(delta_encode(F.collect_list(F.col("id").cast("bigint"))).alias("ids"))
    one = by.agg(F.max("dist").alias("d"), F.transform(F.sort_array(F.collect_list(F.struct("dist", "ids"))), lambda x: x["ids"]).alias("l"))
    return one.select(F.to_json(F.struct("d", "l")).alias("doc"))


def read_compass(docs: DataFrame) -> DataFrame:
    """id, dist of compass documents (doc), decoded."""
    from loomgraph.functions.text import delta_decode

    levels = F.from_json(F.get_json_object("doc", "$.l"), "array<array<bigint>>")
    return docs.select(F.posexplode(levels).alias("pos", "ids")).select(F.explode(delta_decode(F.col("ids"))).alias("id"), (F.col("pos") + 1).alias("dist"))
