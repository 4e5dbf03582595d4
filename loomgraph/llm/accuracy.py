"""Held-out accuracy of the two classifiers: python -m loomgraph.llm.accuracy FOLDER_OF_TABLES

It runs the registered queries and compares their held-out rows with what the tables say. Nothing is chosen by it.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, table
from loomgraph.llm.queries import op8_toxicity, op9_language_id


def language(spark: SparkSession, sf_dir: str) -> dict:
    """Share of right predictions on held-out rows with a language, and the lowest tenth of a percent of their scores."""
    p = op9_language_id(spark, sf_dir).where("held_out").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'")
    r = p.agg(F.count("*").alias("rows"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("accuracy"), F.min("score").alias("least_score"), F.percentile_approx("score", 0.01).alias("score_1pct")).first()
    return r.asDict()


def toxicity(spark: SparkSession, sf_dir: str) -> dict:
    """Area under the curve, accuracy, precision and recall on held-out labelled rows."""
    y = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    p: DataFrame = cut(op8_toxicity(spark, sf_dir).where("held_out").join(y, "doc_id").select("score", "predicted", "y"))
    n = p.agg(F.count("*").alias("rows"), F.sum("y").alias("toxic"), F.avg((F.col("predicted") == F.col("y")).cast("double")).alias("accuracy"), F.sum(F.col("predicted") * F.col("y")).alias("hit"), F.sum("predicted").alias("said")).first()
    by = p.groupBy("score").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    below = F.sum("b").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1))
    pairs = by.withColumn("below", F.coalesce(below, F.lit(0))).agg(F.sum(F.col("a") * (F.col("below") + F.col("b") / 2))).first()[0]
    return {
        "rows": n["rows"], "toxic": n["toxic"], "accuracy": n["accuracy"], "precision": n["hit"] / max(1, n["said"]), "recall": n["hit"] / max(1, n["toxic"]),
        "area": float(pairs) / max(1, n["toxic"] * (n["rows"] - n["toxic"])),
    }


if __name__ == "__main__":
    session = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    print(json.dumps({"language": language(session, sys.argv[1]), "toxicity": toxicity(session, sys.argv[1])}, indent=1))
