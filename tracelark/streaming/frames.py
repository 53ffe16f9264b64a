"""Frames from a stream of lines or of frame rows: decoding, windows with late data, duplicates, and running clocks and order as state that expires."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import decode
from ..plans.model import Message, Signal
from ..sources.text_lines import decimal_to_ns, token


def asc_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, t of the lines that arrive in a folder of ASC files."""
    raw = spark.readStream.option("lineSep", "\n").text(path)
    return raw.select(F.btrim(F.make_valid_utf8("value"), F.lit(" \t\r")).alias("line")).where("line <> ''").withColumn("t", F.split("line", r"[ \t\r]+"))


def stamped(lines: DataFrame) -> DataFrame:
    """The lines with a stamp: channel and stamp in ns."""
    ns, timed = decimal_to_ns(token(0), 9)
    return lines.where(timed).select(F.coalesce(token(1), F.lit("")).alias("channel"), ns.alias("stamp")).where("stamp is not null")


def samples(frames: DataFrame, message: Message, signal: Signal) -> DataFrame:
    """The batch decoder on a stream of frames: the same expressions, without an order."""
    own = frames.where((F.col("kind") == "data") & (F.col("can_id") == message.can_id) & (F.col("is_extended") == message.is_extended))
    return decode.samples(own, message, signal)


def traffic(frames: DataFrame, at: str, size: str, late: str) -> DataFrame:
    """Frames per identifier and window of time ``at``; rows later than ``late`` no longer count."""
    return frames.withWatermark(at, late).groupBy(F.window(at, size), "can_id", "is_extended").agg(F.count("*").alias("n_frames"), F.max("timestamp_ns").alias("last_ns"))


def distinct(frames: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Frames that arrive twice within ``late`` count once."""
    return frames.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def running_clock(rows: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """channel, n, clock: for each channel the rows so far and the sum of their relative stamps, kept as state between batches.

    With ``idle_ms``, a channel from which nothing has come for so long is forgotten, and its clock starts anew with its next row; such a stream looks
    at its state in every batch, also where no rows have come.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, clock = state.get if state.exists else (0, 0)
        for f in frames:
            n, clock = n + len(f), clock + int(f["stamp"].sum())
        state.update((n, clock))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"channel": [key[0]], "n": [n], "clock": [clock]})

    return rows.groupBy("channel").applyInPandasWithState(step, "channel string, n long, clock long", "n long, clock long", "update", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def in_order(frames: DataFrame, at: str, late: str) -> DataFrame:
    """channel, seq, at, timestamp_ns, can_id, payload of the frames of each channel in the order of time ``at``, then of seq, with the time to the frame before (step_ns).

    Frames wait as state until the watermark, ``late`` behind the latest time, has passed them, so what comes late, but not later, is put in
    its place; what comes later still is left out. A channel whose frames have all gone out keeps its last stamp for another ``late`` and is then forgotten:
    state is bounded by the frames and the channels of that span.
    """
    wait = F.expr(f"INTERVAL {late}")
    rows = frames.select(F.coalesce(F.col("channel"), F.lit(-1)).alias("channel"), "seq", F.col(at).alias("at"), "timestamp_ns", "can_id", "payload", F.unix_millis(F.col(at)).alias("ms"), (F.unix_millis(F.col(at) + wait) - F.unix_millis(F.col(at))).alias("late_ms"))
    rows = rows.withWatermark("at", late)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, late_ms, waiting = (state.get[0], state.get[1], pickle.loads(state.get[2])) if state.exists else (None, 0, [])
        for f in batches:
            if not len(f):  # a timeout brings an empty one
                continue
            late_ms = max(late_ms, int(f["late_ms"].max()))
            waiting += list(zip(f["ms"].tolist(), f["seq"].tolist(), f["timestamp_ns"].tolist(), f["can_id"].tolist(), f["payload"].tolist(), strict=True))
        now = state.getCurrentWatermarkMs()
        waiting.sort(key=lambda r: r[:2])
        n = sum(r[0] <= now for r in waiting)
        out, waiting = waiting[:n], waiting[n:]
        steps = []
        for r in out:
            steps.append(None if last is None else r[2] - last)
            last = r[2]
        if state.hasTimedOut and not out and not waiting:
            state.remove()
        else:
            state.update((last, late_ms, pickle.dumps(waiting)))
            state.setTimeoutTimestamp(max(now + 1, waiting[0][0] if waiting else now + late_ms))
        if out:
            yield pd.DataFrame({"channel": key[0], "seq": [r[1] for r in out], "at_ms": [r[0] for r in out], "timestamp_ns": [r[2] for r in out], "can_id": [r[3] for r in out], "payload": [r[4] for r in out], "step_ns": pd.array(steps, "Int64")})

    kind = "channel int, seq long, at_ms long, timestamp_ns long, can_id int, payload binary, step_ns long"
    own = rows.groupBy("channel").applyInPandasWithState(step, kind, "last long, late_ms long, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)
    return own.select(F.when(F.col("channel") >= 0, F.col("channel")).alias("channel"), "seq", F.timestamp_millis("at_ms").alias("at"), "timestamp_ns", "can_id", "payload", "step_ns")
