"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is cut into words (runs of other than ASCII white space, at most 32 characters each, so that scripts
without spaces are cut too). Of the k-mers of K words those are chosen whose least inner substring of two
words, by hash, stands at an edge. The choice depends on the k-mer alone, so an edit changes only the anchors
that it touches. Likeness is the Jaccard index of all distinct anchors of two texts, found by positional
matching. The fingerprint in the result keeps the M least distinct anchor hashes; nothing is computed from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import cut

K, M, HEX = 5, 48, 12
WORD = r"[^\x20\x09-\x0D]{1,32}"
NO_ID = -(2**63)


def _words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def _inner(words: Column) -> Column:
    """Hashes of the inner substrings: word i with word i + 1."""
    last = F.size(words) - 2
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))).otherwise(
        F.lit(None).cast("array<bigint>")
    )


def _chosen(inner: Column) -> Column:
    last = F.size(inner) - (K - 1)
    least = lambda i: F.least(F.get(inner, i), F.get(inner, i + 3)) <= F.least(F.get(inner, i + 1), F.get(inner, i + 2))
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), least)).otherwise(F.array().cast("array<int>"))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: an array of (pos, hash), the closed syncmers by word position.

    A text of fewer than K words, or with no anchor, has one anchor: its words' hash at position 0. An empty
    or null text counts as a text without words.
    """
    d = df.withColumn("_w", _words(F.coalesce(F.col(text), F.lit("")))).withColumn("_s", _inner(F.col("_w"))).withColumn("_c", _chosen(F.col("_s")))
    s = F.col("_s")
    cut48 = lambda h: F.shiftrightunsigned(h, 64 - 4 * HEX)
    found = F.transform("_c", lambda i: F.struct(i.alias("pos"), cut48(F.xxhash64(F.get(s, i), F.get(s, i + 2), F.get(s, i + 3))).alias("hash")))
    only = F.array(F.struct(F.lit(0).alias("pos"), cut48(F.xxhash64(F.concat_ws(" ", F.transform("_w", lambda x: x.cast("string"))))).alias("hash")))
    return d.withColumn(out, F.when(F.size("_c") > 0, found).otherwise(only)).drop("_w", "_s", "_c")


def sketch(anchors: Column) -> Column:
    """The M least distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(anchors["hash"])), 1, M)


def as_text(found: Column) -> Column:
    return F.concat_ws("", F.transform(found, lambda h: F.lpad(F.lower(F.hex(h)), HEX, "0")))


def with_matches(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds ``out``: positional matches of two anchor columns, an array of (pos_a, pos_b).

    One for each distinct hash that both have, at its first place in each. Both are sorted together by hash, so
    the work is n log n; a lookup in a map or array for each anchor would be quadratic.
    """
    side = lambda c, k: F.transform(c, lambda x: F.struct(x["hash"].alias("hash"), F.lit(k).alias("side"), x["pos"].alias("pos")))
    d = df.withColumn("_s", F.sort_array(F.concat(side(F.col(a), 0), side(F.col(b), 1))))
    before, after = (lambda i: F.get("_s", i - 1)), (lambda i: F.get("_f", i + 1))
    d = d.withColumn("_f", F.filter("_s", lambda x, i: (i == 0) | (before(i)["hash"] != x["hash"]) | (before(i)["side"] != x["side"])))
    both = lambda x, i: (x["side"] == 0) & (after(i)["hash"] == x["hash"])
    found = F.transform("_f", lambda x, i: F.struct(x["pos"].alias("pos_a"), F.when(both(x, i), after(i)["pos"]).alias("pos_b")))
    return d.withColumn(out, F.filter(found, lambda m: m["pos_b"].isNotNull())).drop("_s", "_f")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds ``out``: the Jaccard index of all distinct hashes of two anchor columns, by their positional matches."""
    d = with_matches(df, a, b, "_m").withColumn("_m", F.size("_m"))
    n = F.size(F.array_distinct(F.col(a)["hash"])) + F.size(F.array_distinct(F.col(b)["hash"]))
    return d.withColumn(out, F.col("_m") / (n - F.col("_m")).cast("double")).drop("_m")


def following(docs: DataFrame) -> DataFrame:
    """For each document (k, h): prev_k, prev_h, prev_chars, of the one before it by ascending k, then h.

    The first follows the last. The order is found on narrow rows: they are dealt by range, each range finds
    its own neighbours, and one row a range links the ranges.
    """
    spark = docs.sparkSession
    ids = docs.groupBy("k", "h").agg(F.max("n").alias("n"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    r = cut(ids.repartitionByRange(n, "k", "h").withColumn("range", F.spark_partition_id()))
    by = Window.partitionBy("range").orderBy("k", "h")
    ends = r.groupBy("range").agg(F.max(F.struct("k", "h", "n")).alias("end"))
    every = Window.orderBy("range")
    last = F.last("end").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select("range", F.coalesce(F.lag("end").over(every), last).alias("end"))
    prev = F.coalesce(F.lag(F.struct("k", "h", "n")).over(by), F.col("end"))
    return r.join(ends, "range").withColumn("prev", prev).select("k", "h", F.col("prev.k").alias("prev_k"), F.col("prev.h").alias("prev_h"), F.col("prev.n").alias("prev_chars"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_anchors.

    ``docs`` has doc_id and text; other columns are ignored. A null text is empty. The edited text has its
    last floor(n_chars / 4) code points replaced by the first as many (or all) of the following document by
    ascending doc_id, null first, then by text hash; after the last comes the first; a single document
    follows itself. Repeated rows count once in that order and get equal results. An empty table gives none.
    """
    t = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("k"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = following(t.select("k", "h", F.length("text").alias("n")))
    # the following text goes to its document whole: its anchors would be no smaller
    heads = t.join(order, ["k", "h"]).select("prev_k", "prev_h", "prev_chars", F.col("text").alias("next")).dropDuplicates(["prev_k", "prev_h"])
    d = t.join(heads.withColumnsRenamed({"prev_k": "k", "prev_h": "h"}), ["k", "h"])
    head = F.left("next", F.floor(F.col("prev_chars") / 4).cast("int"))
    d = d.withColumn("n_chars", F.length("text")).withColumn("edited", F.concat(F.left("text", (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")), head))
    d = with_anchors(with_anchors(with_anchors(d, "text", "own"), "edited", "new"), "next", "following")
    d = with_likeness(with_likeness(d, "own", "new", "near_edited"), "own", "following", "near_next")
    return d.select(
        F.nullif("k", F.lit(NO_ID)).alias("doc_id"), F.col("n_chars").cast("bigint"), F.sha2("edited", 256).alias("edited_sha256"), as_text(sketch(F.col("own"))).alias("fingerprint"),
        as_text(sketch(F.col("new"))).alias("edited_fingerprint"), "near_edited", "near_next", F.size("own").alias("n_anchors"),
    )
