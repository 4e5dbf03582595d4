"""Mixing sources to target weights by hash-threshold histograms.

A source's target is split into whole repeats of all its documents and a remainder. The remainder is taken
from the documents with the lowest hashes: sizes are summed by source and hash bucket, the bucket where the
running sum crosses the remainder is found, and only that bucket is refined, level by level, down to single
hashes. Deciding a document then needs its own hash and its source's threshold, so nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import cut

#: Hex digits of the hash that each level of the histogram adds, and the number of levels.
STEP, LEVELS = 3, 5
DIGITS = STEP * LEVELS


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def doc_hash(*key: Column) -> Column:
    """60 bits of a hash, the same in every engine, as hexadecimal digits."""
    return F.substring(F.md5(F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("")) for k in key])), 1, DIGITS)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Per source: source_size, target. One row a source; sources are few beside documents.

    Weights repeat over the sources in code point order, null last. All targets together are ``share`` times
    all sizes; none is above ``most`` times its source's size, and what a capped source cannot take is shared
    again by weight. With sources ordered by cap over weight, that is one prefix sum.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    r = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(r, F.lit(len(weights))) + 1).cast("int"))
    w = by.withColumn("weight", weight).withColumn("ratio", F.col("source_size") * F.lit(float(most)) / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = w.withColumn("capped", F.coalesce(F.sum(F.col("source_size") * F.lit(float(most))).over(before), F.lit(0.0)))
    w = w.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.col("capped")) / F.col("open"))
    w = w.withColumn("free", F.col("level") <= F.col("ratio"))
    w = w.withColumn("last", F.min(F.when(F.col("free"), F.struct("ratio", "level"))).over(every)["level"])
    cap = F.col("source_size") * F.lit(float(most))
    target = F.when(F.col("free") | F.col("last").isNotNull(), F.least(cap, F.col("last") * F.col("weight"))).otherwise(cap)
    return w.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole repeats, and the hash up to which documents are taken once more.

    ``sizes`` has source, size, h. A source's documents with ``h <= cut_at`` are taken ``whole + 1`` times.
    The threshold is the last hash at which the running sum is not above the remainder, so what a source
    takes is below its target by less than the documents of one hash.
    """
    t = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
    t = t.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    state = t.select("source", "whole", "rest", F.lit("").alias("prefix"), F.lit("").alias("cut_at"))
    for level in range(LEVELS):
        n = (level + 1) * STEP
        at = state.select(F.col("source").alias("s"), "prefix")
        inside = sizes.join(at, F.col("source").eqNullSafe(F.col("s")) & F.col("h").startswith(F.col("prefix"))).drop("s", "prefix")
        bins = inside.groupBy("source", F.substring("h", 1, n).alias("bin")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.sum("n").over(run)).withColumnRenamed("source", "s")
        found = state.join(bins, F.col("source").eqNullSafe(F.col("s")), "left").groupBy("source", "whole").agg(
            F.first("rest").alias("rest"), F.first("cut_at").alias("old"),
            F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("bin", "upto"))).alias("full"),
            F.min(F.when(F.col("upto") > F.col("rest"), F.col("bin"))).alias("next"),
        )
        state = cut(
            found.select(
                "source", "whole", (F.col("rest") - F.coalesce(F.col("full.upto"), F.lit(0))).alias("rest"),
                # no bucket has this prefix once the whole source fits
                F.coalesce("next", F.lit("-")).alias("prefix"), F.coalesce(F.rpad(F.col("full.bin"), DIGITS, "f"), F.col("old")).alias("cut_at"),
            )
        )
    return state.select("source", "whole", "cut_at")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """All columns of ``docs`` with size, source_size, target, repeats and taken.

    Size counts runs of characters other than ASCII white space; a null text has size 0. Documents of size 0
    are repeated like others but take nothing. A document without an id is told from others by its text. A null source is a source of its own. Repeated rows share a
    hash and are decided alike. An empty table gives an empty table. Columns of ``docs`` named like a new one
    are replaced.
    """
    own = {"size", "source_size", "target", "repeats", "taken"}
    kept = [c for c in docs.columns if c not in own]
    at = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    # documents without an id differ by text
    mark = F.coalesce(F.col("row.doc_id").cast("string"), F.concat(F.lit("null "), F.coalesce(F.col("row.text").cast("string"), F.lit(""))))
    at = at.select("row", F.col("row.source").alias("source"), n_words(F.col("row.text")).alias("size"), doc_hash(mark).alias("h"))
    sizes = cut(at.select("source", "size", "h"))
    targets = cut(source_targets(sizes, weights, share, most))
    found = thresholds(sizes, targets).select(F.col("source").alias("s"), "whole", "cut_at")
    found = found.join(targets.withColumnRenamed("source", "s2"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    out = at.join(found, F.col("source").eqNullSafe(F.col("s")), "left")
    out = out.withColumn("repeats", F.col("whole") + (F.col("h") <= F.col("cut_at")).cast("bigint")).withColumn("repeats", F.least("repeats", F.lit(int(-(-most // 1)))))
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of ``docs``."""
    m = mix(docs, **how)
    return m.where("repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select(*docs.columns)


#: DuckDB: the same mix of all documents, with weights 3, 1, 2, share 1.5 and at most 2 repeats.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    substr(md5(coalesce(doc_id::VARCHAR, 'null ' || coalesce(text, ''))), 1, 15) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
    - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM r),
f AS (SELECT *, (SELECT lvl FROM l WHERE lvl <= ratio ORDER BY ratio, lvl LIMIT 1) AS last FROM l),
t AS (SELECT source, source_size, coalesce(least(source_size * 2.0::DOUBLE, last * weight), source_size * 2.0::DOUBLE) AS target FROM f),
x AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
c AS (SELECT d.*, x.source_size, x.target, x.whole, sum(d.size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target, (size * (whole + (upto <= target - whole * source_size)::INT))::BIGINT AS taken FROM c"""
