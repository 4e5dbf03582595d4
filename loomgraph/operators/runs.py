"""Played runs: leaderboards, histograms, streaks, stopwatch and budgets, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T


def leaderboard(rows: DataFrame, most: int = 100) -> DataFrame:
    """board, rank, player, clicks, ms, seq: each player's best row, boards by (clicks, ms), first arrival first.

    Rows (board, player, clicks, ms, seq) of an empty player are never merged. A board only improves, so the
    batch equals a replay with truncation.
    """
    who = F.when(F.coalesce("player", F.lit("")) == "", F.concat(F.lit("#"), F.col("seq").cast("string"))).otherwise(F.concat(F.lit("="), "player"))
    best = rows.withColumn("_who", who).groupBy("board", "_who").agg(F.min(F.struct("clicks", "ms", "seq", "player")).alias("b")).select("board", "b.*")
    rank = F.row_number().over(Window.partitionBy("board").orderBy("clicks", "ms", "seq"))
    return best.withColumn("rank", rank).where(F.col("rank") <= most).select("board", "rank", "player", "clicks", "ms", "seq")


def histogram(board: DataFrame) -> DataFrame:
    """board, clicks, n over the kept rows."""
    return board.groupBy("board", "clicks").agg(F.count("*").alias("n"))


def at_par(hist: DataFrame, par: int) -> DataFrame:
    """board, pct of the kept rows that took ``par`` clicks."""
    return hist.groupBy("board").agg(F.round(100.0 * F.sum(F.when(F.col("clicks") == par, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("pct"))


def streaks(days: DataFrame) -> DataFrame:
    """player, best: the longest run of consecutive numbers of (player, number)."""
    d = days.distinct().withColumn("_g", F.col("number") - F.row_number().over(Window.partitionBy("player").orderBy("number")))
    return d.groupBy("player", "_g").agg(F.count("*").alias("n")).groupBy("player").agg(F.max("n").alias("best"))


def scorecard(holes: DataFrame) -> DataFrame:
    """card, par, score, verdict of holes (card, par, clicks); a hole without clicks counts par + 3."""
    score = F.coalesce("clicks", F.col("par") + 3)
    g = holes.groupBy("card").agg(F.sum("par").alias("par"), F.sum(score).alias("score"))
    return g.withColumn("verdict", T.verdict(F.col("score"), F.col("par")))


def active_time(actions: DataFrame) -> DataFrame:
    """run, active_ms, state of clock actions (run, ts_ms, seq, action: start, resume, pause, finish).

    Time counts from start or resume to the next pause or finish. Actions that do not fit the state (a second
    start, a resume while running, anything after the finish) are ignored. Which actions fit depends on the
    state before, so the states are folded over each run's ordered actions; a run has few.
    """
    ordered = actions.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("ts_ms", "seq", "action"))).alias("a"))
    first = F.struct(F.lit("ready").alias("state"), F.lit(0).cast("bigint").alias("since"), F.lit(0).cast("bigint").alias("ms"))

    def step(s, a):
        begins = ((a["action"] == "start") & (s["state"] == "ready")) | ((a["action"] == "resume") & (s["state"] == "paused"))
        ends = a["action"].isin("pause", "finish") & (s["state"] == "running")
        state = F.when(begins, "running").when(ends, F.when(a["action"] == "finish", "finished").otherwise("paused")).otherwise(s["state"])
        since = F.when(begins, a["ts_ms"]).otherwise(s["since"])
        ms = s["ms"] + F.when(ends, a["ts_ms"] - s["since"]).otherwise(0)
        return F.struct(state.alias("state"), since.alias("since"), ms.alias("ms"))

    return ordered.select("run", F.aggregate("a", first, step).alias("s")).select("run", F.col("s.ms").alias("active_ms"), F.col("s.state").alias("state"))


def spend(requests: DataFrame) -> DataFrame:
    """run, seq, granted of useful and useless requests (run, seq, useful, charges): useful ones cost a charge while
    there are any, useless ones are free."""
    cost = F.when(F.col("useful"), 1).otherwise(0)
    used = F.sum(cost).over(Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return requests.select("run", "seq", (~F.col("useful") | (used <= F.col("charges"))).alias("granted"))


def submissions(runs: DataFrame) -> DataFrame:
    """Adds verdict ok or too_fast to rows with clicks and ms."""
    return runs.withColumn("verdict", F.when(F.col("ms") < T.least_ms(F.col("clicks")), "too_fast").otherwise("ok"))


def traffic_class(path: Column) -> Column:
    """Counter of a request path."""
    return (
        F.when(path == "/", "pages").when(path == "/api/search", "searches").when(F.startswith(path, F.lit("/api/article/")), "articles")
        .when(path.isin("/api/puzzle", "/api/daily"), "puzzles").when(path == "/api/submit", "submits").when(path == "/api/compass", "compass").otherwise("other")
    )


def hourly(hits: DataFrame, kinds: list[str]) -> DataFrame:
    """hour, one count for each kind, and the running number of distinct clients of the day at the hour's end.

    hits: ts, kind, client. Hours without hits are absent. A client counts in the hour of its first hit of a day.
    """
    h = hits.withColumn("hour", F.date_trunc("hour", "ts")).withColumn("day", F.to_date("ts"))
    counts = h.groupBy("hour", "day").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])
    new = h.groupBy("day", "client").agg(F.min("hour").alias("hour")).groupBy("day", "hour").agg(F.count("*").alias("new"))
    running = F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy("day").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0))
    return counts.join(new, ["day", "hour"], "left").withColumn("uniques_today", running).drop("new", "day")
