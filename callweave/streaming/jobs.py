"""Structured Streaming forms of the stateful jobs. Late rows beyond a job's watermark are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from callweave.sources.stored import stored

CONTEXT_SECONDS, CONTEXT_TURNS, COOLDOWN_SECONDS = 180, 3, 12.0


def timed(rows: DataFrame, column: str = "ts") -> DataFrame:
    """Event times with a zone, as windows and watermarks want them."""
    return rows.withColumn(column, F.col(column).cast("timestamp"))


def suspicious_downloads(log: DataFrame, least: int = 10, window: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """log: downloaded_by, consultation_id, ts."""
    out = log.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "downloaded_by").agg(F.count(F.lit(1)).alias("downloads"), F.array_sort(F.collect_set("consultation_id")).alias("consultations"))
    return out.filter(F.col("downloads") >= least).select(F.col("window.start").cast("timestamp_ntz").alias("begin"), "downloaded_by", "downloads", "consultations")


def daily_downloads(log: DataFrame, late: str = "1 day") -> DataFrame:
    """Downloads a day, users by a sketch (exact distinct counts are not for streams)."""
    out = log.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("downloads"), F.approx_count_distinct("downloaded_by").alias("users"))
    return out.select(F.to_date("window.start").alias("day"), "downloads", "users")


def call_sessions(turns: DataFrame, gap: str = "3 minutes", late: str = "10 minutes") -> DataFrame:
    """Turns, seconds and history (values in order, '' for none) of sessions that a pause of `gap` ends. turns: session_id,
    id, ts, value. A session's history is one row, so its size is that of the session."""
    said = F.array_sort(F.collect_list(F.struct("ts", "id", F.coalesce("value", F.lit("")).alias("value"))))
    out = turns.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("turns"), F.min("ts").alias("first"), F.max("ts").alias("last"), said.alias("said"))
    return out.select("session_id", F.col("first").cast("timestamp_ntz").alias("begin"), "turns", F.transform("said", lambda x: x["value"]).alias("history"), F.round(F.col("last").cast("double") - F.col("first").cast("double"), 3).alias("seconds"))


def suppress_repeats(queries: DataFrame, within: str = "60 seconds") -> DataFrame:
    """The first query of a key within the watermark. queries: key, ts."""
    return queries.withWatermark("ts", within).dropDuplicatesWithinWatermark(["key"])


def session_context(turns: DataFrame) -> DataFrame:
    """turns with carried: the last explicit value if at most 180 s and 3 turns old; an own value wins. Batch form.
    turns: session_id, id, ts, value."""
    order = Window.partitionBy("session_id").orderBy("ts", "id")
    rows = turns.withColumn("turn", F.row_number().over(order).cast("long"))
    last = F.last(F.when(F.col("value").isNotNull(), F.struct("value", "ts", "turn")), ignorenulls=True).over(order)
    rows = rows.withColumn("last", last)
    fresh = (F.col("ts").cast("timestamp").cast("double") - F.col("last.ts").cast("timestamp").cast("double") <= CONTEXT_SECONDS) & (F.col("turn") - F.col("last.turn") <= CONTEXT_TURNS)
    return rows.select("id", "session_id", "turn", "value", F.when(fresh, F.col("last.value")).alias("carried"))


def session_context_stream(turns: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The same on a stream of turns in order that carry their number in the session (turn, beside session_context's columns).

    State is a session's last value, its turn and time. It goes as soon as a turn finds it too old, and in a session that is
    idle once the watermark has passed its age: later turns can't use it."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value, at, when = state.get if state.exists else (None, 0, 0.0)
        out = []
        for r in pd.concat(list(frames)).sort_values(["ts", "id"]).itertuples(index=False):
            now = r.ts.timestamp()
            if r.value is not None:
                value, at, when = r.value, int(r.turn), now
            elif value is not None and (now - when > CONTEXT_SECONDS or r.turn - at > CONTEXT_TURNS):
                value = None
            out.append((r.id, key[0], r.turn, r.value, value))
        if value is not None:
            state.update((value, at, when))
            state.setTimeoutTimestamp(max(int((when + CONTEXT_SECONDS) * 1000), state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["id", "session_id", "turn", "value", "carried"])

    return turns.withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(step, "id long, session_id long, turn long, value string, carried string", "value string, at long, `when` double", "append", GroupStateTimeout.EventTimeTimeout)


def asks(turns: DataFrame) -> Column:
    """Whether a turn asks for a case search: by its flag, keyword hits, confidence, place in the session or sentences. Columns
    that are missing or null ask for nothing."""
    least = {"hits": 2, "confidence": 0.6, "turn": 2, "sentences": 2}  # fixed values: results depend on them
    out = F.coalesce(F.col("flag"), F.lit(False)) if "flag" in turns.columns else F.lit(False)
    for name, n in least.items():
        if name in turns.columns:
            out = out | F.coalesce(F.col(name) >= n, F.lit(False))
    return out


def cooldown(turns: DataFrame, seconds: float = COOLDOWN_SECONDS) -> DataFrame:
    """id, session_id, allowed: a turn that asks is allowed if the last allowed one is `seconds` or more ago. turns:
    session_id, id (each pair once), ts, and what asks() reads.

    A turn so long after the asking turn before it is allowed whatever came earlier, and a chain begins there. Each turn's next
    allowed one, should it be allowed itself, is known beforehand; chains are followed by doubling the jumps, so rounds grow
    with the logarithm of the longest chain and no session is folded in order."""
    key = ["session_id", "id"]
    rows = turns.select(*key, F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), asks(turns).alias("asks"))
    asking = rows.filter("asks").drop("asks")
    wait = int(seconds * 1_000_000)
    in_order = Window.partitionBy("session_id").orderBy("at", "id")
    before = F.lag("at").over(in_order)
    asking = asking.withColumn("first", before.isNull() | (F.col("at") - before >= wait))
    asking = asking.withColumn("chain", F.sum(F.col("first").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    later = Window.partitionBy("session_id", "chain").orderBy("at").rangeBetween(wait, Window.unboundedFollowing)
    asking = stored(asking.withColumn("next", F.min(F.struct("at", "id")).over(later)["id"]), "asking")
    jumps = asking.filter(F.col("next").isNotNull()).select(*key, "next")
    allowed = asking.filter("first").select(*key)
    while True:
        more = stored(allowed.join(jumps, key).select("session_id", F.col("next").alias("id")), "allowed")
        if more.isEmpty():
            break
        allowed = stored(allowed.unionByName(more), "allowed")
        twice = jumps.select("session_id", F.col("id").alias("next"), F.col("next").alias("after"))
        jumps = stored(jumps.join(twice, ["session_id", "next"]).select(*key, F.col("after").alias("next")), "jumps")
    return rows.select(*key).join(allowed.withColumn("allowed", F.lit(True)), key, "left").select("id", "session_id", F.coalesce("allowed", F.lit(False)).alias("allowed"))


def drained(spark: SparkSession, source: DataFrame, job, name: str, folder: str, mode: str = "append", close: str | None = None) -> DataFrame:
    """source written once, streamed through job() until all of it is used, the result as a table. For replays and tests.

    close: the time column. Two more rows follow then, each a run of its own, with times beyond every window and nulls
    otherwise: the first moves the watermark, and the second brings out what was open before it. What they make themselves
    is for the caller to leave out."""
    source.write.parquet(f"{folder}/in")
    last = source.agg(F.max(close).alias(close)).filter(F.col(close).isNotNull()) if close else None
    for days in (0, 3650, 7300) if close else (0,):
        if days:
            fields = [(F.col(close) + F.make_interval(days=F.lit(days))).cast(f.dataType).alias(f.name) if f.name == close else F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema]
            last.select(*fields).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(source.schema).parquet(f"{folder}/in")
        query = job(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")
