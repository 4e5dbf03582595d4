"""Cutting lineage in iterative plans: tables written to the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, a temporary folder in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not found and context.getCheckpointDir().isDefined():
        found = context.getCheckpointDir().get()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='loomgraph-shared-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back, so later plans start there and its size is known. What a cut gave is not
    written again."""
    if getattr(df, "_is_cut", False):
        return df
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._is_cut = True
    return out


#: Rows up to which a table may go to every executor.
SMALL = 100_000


def fit(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of so many rows as a side of a join: sent to every executor if it is small by that count, else sorted. The
    planner goes by the bytes of a compressed file, of which ten million hold millions of rows."""
    return df.hint("broadcast" if rows <= SMALL else "merge")
