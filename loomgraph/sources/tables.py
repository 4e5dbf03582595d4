"""Tables of a built graph: mandatory and optional reads, dense columns, capped lists, logs, lists, integrity."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException


@dataclass
class Config:
    """Settings with defaults; ``of`` lays given ones over them, section by section, and ignores unknown keys."""

    alpha: float = 0.85
    tolerance: float = 1e-9
    iterations: int = 100
    resolution: float = 6.0
    clean: dict = field(default_factory=lambda: {"references": True, "templates": False, "citations": True})

    @classmethod
    def of(cls, given: dict | None) -> Config:
        c = cls()
        for f in fields(cls):
            if given and f.name in given:
                old = getattr(c, f.name)
                setattr(c, f.name, old | given[f.name] if isinstance(old, dict) else given[f.name])
        return c


def optional_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, or an empty one of that schema where there is none."""
    try:
        return spark.read.parquet(path).select(*[F.col(c.name).cast(c.dataType) for c in spark.createDataFrame([], schema).schema])
    except AnalysisException:
        return spark.createDataFrame([], schema)


def dense_column(nodes: DataFrame, values: DataFrame, value: str, default: int = 0) -> DataFrame:
    """Nodes with a column of values (id, value): missing ones are the default, ids of no node are ignored."""
    return nodes.join(values.select("id", value), "id", "left").withColumn(value, F.coalesce(value, F.lit(default)))


def capped_list(rows: DataFrame, value: str, most: int, order: str) -> DataFrame:
    """id, values: the first ``most`` values of each id in the order of ``order``."""
    r = rows.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(order))).where(F.col("_r") <= most)
    return r.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", value))), lambda x: x[value]).alias("values"))


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """community, name of a JSON object of names by id; keys that are no numbers go; no file gives no rows."""
    try:
        text = spark.read.option("wholetext", "true").text(path)
    except AnalysisException:
        return spark.createDataFrame([], "community bigint, name string")
    m = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "name"))
    return m.select(F.col("k").try_cast("bigint").alias("community"), "name").where("community IS NOT NULL")


def replay(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an append-only log of JSON lines; blank and malformed lines are skipped."""
    bad = "_bad"
    return spark.read.schema(f"{schema}, {bad} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path).cache().where(F.col(bad).isNull()).drop(bad)


def deny_list(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """title, id of a list of titles: blank lines and comments go, titles are resolved by index (key, id); id is null
    where nothing matches, for a warning."""
    from loomgraph.functions.text import normalize_title

    lines = spark.read.text(path).select(F.trim("value").alias("title")).where("title <> '' AND NOT startswith(title, '#')")
    return lines.withColumn("key", normalize_title(F.col("title"))).join(index, "key", "left").select("title", "id")


def check_nodes(nodes: DataFrame, titles: DataFrame) -> int:
    """The number of nodes, which must be that of titles."""
    n, m = nodes.count(), titles.count()
    if n != m:
        raise ValueError(f"{n} nodes but {m} titles: the tables are of different builds")
    return n


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """SHA-256 over names, lengths and digests of files; it changes with any byte."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("digest"))
    h = hashlib.sha256()
    for r in sorted(map(tuple, rows.collect())):  # a row for each file of the two tables
        h.update(r[0].encode() + int(r[1]).to_bytes(8, "little") + r[2].encode())
    return h.hexdigest()


def check_pools(pool: DataFrame, n_nodes: int, stamp: dict, expected: dict) -> DataFrame:
    """The pool, if it belongs to this graph and all its rows are in range; else an error."""
    if stamp != expected:
        raise ValueError(f"the pools belong to another graph: {json.dumps(stamp)}")
    bad = pool.where(~F.col("difficulty").between(0, 2) | ~F.col("par").between(1, 7) | (F.greatest("src", "dst") >= n_nodes) | (F.least("src", "dst") < 0)).limit(1)
    if not bad.isEmpty():
        raise ValueError(f"a row of the pools is out of range: {bad.first()}")
    return pool
