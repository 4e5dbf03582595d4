"""Stateful operators over event streams, and their batch forms.

Each stream form gives, over a bounded input, what its batch form gives; tests hold them against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def refill(tokens: float, last: float, now: float, burst: float, per_s: float) -> tuple[float, bool]:
    """The tokens after a request at ``now``, and whether it is allowed."""
    tokens = min(burst, tokens + max(0.0, now - last) * per_s)
    return (tokens - 1.0, True) if tokens >= 1.0 else (tokens, False)


def token_bucket(requests: DataFrame, burst: float, per_s: float) -> DataFrame:
    """client, seq, allowed of requests (client, ts in seconds, seq): a bucket for each client, folded in time order.

    A client's bucket starts full. The fold is sequential for a client, so its requests meet in one row.
    """
    g = requests.groupBy("client").agg(F.sort_array(F.collect_list(F.struct(F.col("ts").cast("double").alias("ts"), "seq"))).alias("r"))
    first = F.struct(F.lit(float(burst)).alias("tokens"), F.get("r", F.lit(0))["ts"].alias("last"), F.array().cast("array<boolean>").alias("out"))

    def step(s, r):
        have = F.least(F.lit(float(burst)), s["tokens"] + F.greatest(F.lit(0.0), r["ts"] - s["last"]) * per_s)
        ok = have >= 1.0
        return F.struct(F.when(ok, have - 1.0).otherwise(have).alias("tokens"), r["ts"].alias("last"), F.concat(s["out"], F.array(ok)).alias("out"))

    out = g.select("client", "r", F.aggregate("r", first, step, lambda s: s["out"]).alias("ok"))
    return out.select("client", F.explode(F.arrays_zip(F.col("r.seq").alias("seq"), F.col("ok").alias("allowed"))).alias("x")).select("client", "x.seq", "x.allowed")


def token_bucket_stream(requests: DataFrame, burst: float, per_s: float) -> DataFrame:
    """The same over a stream; a client's state is two numbers and goes when its bucket must be full again.

    That is told by the clock, so a replay whose event time runs slower than the clock must not use it.
    """
    idle_ms = 1000 + int(1000 * burst / per_s) if per_s > 0 else 365 * 86_400_000

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        tokens, last = state.get if state.exists else (float(burst), float(rows.ts.iloc[0]))
        ok = []
        for now in rows.ts:
            tokens, allowed = refill(tokens, last, float(now), burst, per_s)
            last = float(now)
            ok.append(allowed)
        state.update((tokens, last))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"client": key[0], "seq": rows.seq, "allowed": ok})

    kind = dict(requests.dtypes)
    return requests.groupBy("client").applyInPandasWithState(work, f"client {kind['client']}, seq {kind['seq']}, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """hour, kind, n over event time, for streams (ts, kind) with a watermark and for batches."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "kind", "n")


def sliding_counts(events: DataFrame, length: str = "2 hours", step: str = "1 hour") -> DataFrame:
    """start, kind, n over overlapping windows."""
    return events.groupBy(F.window("ts", length, step).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """client, start, n: visits of a client that pauses of ``gap`` divide."""
    return events.groupBy("client", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("client", F.col("w.start").alias("start"), "n")


def run_clock_stream(actions: DataFrame, ttl_ms: int = 22_200_000) -> DataFrame:
    """run, seq, active_ms, state after each clock action (run, ts_ms, seq, action) of a stream.

    The state machine is that of runs.active_time; a run's state goes after its time to live.
    """

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        name, since, ms = state.get if state.exists else ("ready", 0, 0)
        rows = pd.concat(list(parts)).sort_values(["ts_ms", "seq"])
        out = []
        for now, act in zip(rows.ts_ms, rows.action, strict=True):
            now = int(now)
            if (act == "start" and name == "ready") or (act == "resume" and name == "paused"):
                name, since = "running", now
            elif act in ("pause", "finish") and name == "running":
                name, ms = ("finished" if act == "finish" else "paused"), ms + now - since
            out.append((ms, name))
        state.update((name, since, ms))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"run": key[0], "seq": rows.seq, "active_ms": [a for a, _ in out], "state": [b for _, b in out]})

    kind = dict(actions.dtypes)
    return actions.groupBy("run").applyInPandasWithState(work, f"run {kind['run']}, seq {kind['seq']}, active_ms bigint, state string", "name string, since bigint, ms bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def gathered(stream: DataFrame, mode: str = "append", once: bool = False) -> DataFrame:
    """Run a stream over what is there now, into a table in the shared folder, and read that table.

    ``once`` takes all in one batch: a stream whose state times out by the clock never runs out of batches.
    """
    import uuid

    from loomgraph.plans.lineage import shared_dir

    spark = stream.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, batch: int) -> None:
        # a batch that is run again replaces what it wrote
        df.write.mode("overwrite").parquet(f"{at}/out/{0 if mode == 'complete' else batch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(**({"once": True} if once else {"availableNow": True})).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{at}/out")
