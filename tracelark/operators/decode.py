"""Signals from frames: carry and multiplex filters, bit slices and scaling.

A few messages are decoded by one projection that Catalyst generates code for; many by a table of plans, a message at a time, as columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import layouts
from ..plans.model import MOST_BYTES, Database, Message, Signal
from .frames import data_frames, of_message, of_source

#: Messages that one projection has branches for at most.
MOST_BRANCHES = 24


def time_ms() -> Column:
    return F.col("timestamp_ns") / F.lit(1_000_000.0)


def samples(frames: DataFrame, message: Message, signal: Signal) -> DataFrame:
    """seq, timestamp_ns, time_ms, value of the frames that carry the signal, whatever their identity; unordered."""
    message.check(signal)
    carried = frames.where(message.carries(F.col("is_fd"), F.col("payload_len")))
    if signal.multiplex is not None:
        carried = carried.where(message.active(signal, F.col("payload")))
    return carried.select("seq", "timestamp_ns", time_ms().alias("time_ms"), signal.value(F.col("payload")).alias("value"))


def decode(frames: DataFrame, database: Database, can_id: int, is_extended: bool, size_bytes: int, name: str, source: tuple[int | None, str] | None = None) -> DataFrame:
    """time_ms, value of one signal in time order, ties in source order.

    Errors come in this order: unknown signal, a message that needs several frames, an invalid layout, an ambiguous source.
    An identifier or source without traffic gives no rows.
    """
    message, signal = database.find(can_id, is_extended, size_bytes, name)
    message.check(signal)
    own = of_source(of_message(frames, can_id, is_extended), source)
    return samples(own, message, signal).orderBy("timestamp_ns", "seq").select("time_ms", "value")


def decode_many(frames: DataFrame, wanted: Iterable[tuple[str, Message, Signal]], by_source: bool = True) -> DataFrame:
    """signal_key, channel, direction, seq, timestamp_ns, time_ms, value of many signals in one scan, by a projection or, for many
    messages, by the table of plans; the rows are the same."""
    wanted = list(wanted)
    if len({m.identity for _, m, _ in wanted}) > MOST_BRANCHES:
        return decode_by_table(frames, wanted, by_source)
    return decode_by_projection(frames, wanted, by_source)


def decode_by_table(frames: DataFrame, wanted: Iterable[tuple[str, Message, Signal]], by_source: bool = True) -> DataFrame:
    """The same by a table of plans: frames meet the messages of their identity in a join, and a task takes the payloads of one message
    after the other as a matrix of bytes. Plans and time grow with the signals, not with the frames times the messages."""
    plans: dict[tuple[int, bool], list[tuple[Message, list[tuple[int, Signal]]]]] = {}
    keys, at = [], {}
    for key, message, signal in wanted:
        message.check(signal)
        own = plans.setdefault((message.can_id, message.is_extended), [])
        place = at.setdefault((message.can_id, message.is_extended, id(message)), len(own))
        if place == len(own):
            own.append((message, []))
        own[place][1].append((len(keys), signal))
        keys.append(key)
    identities = list(plans)
    spark = frames.sparkSession
    ids = spark.createDataFrame([(i, *x) for i, x in enumerate(identities)], "plan int, can_id int, is_extended boolean")
    tables = spark.sparkContext.broadcast((keys, [plans[x] for x in identities]))  # the size of the databases, which their limit bounds
    source = ["channel", "direction"] if by_source else []
    found = data_frames(frames).join(ids, ["can_id", "is_extended"]).select("plan", "is_fd", "payload_len", "payload", *source, "seq", "timestamp_ns")
    kinds = {"channel": "int", "direction": "string"}
    schema = ", ".join(["signal_key string", *[f"{c} {kinds[c]}" for c in source], "seq long, timestamp_ns long, time_ms double, value double"])
    return found.mapInArrow(_by_plans(tables, len(source)), schema)


def _by_plans(tables, n_source: int) -> Callable:
    def decoded(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names, plans = tables.value
        names = pa.array(names, pa.string())
        for batch in batches:
            if not batch.num_rows:
                continue
            plan, is_fd, length = (np.asarray(batch.column(j)) for j in range(3))
            payload = batch.column(3).cast(pa.large_binary())
            offsets = np.frombuffer(payload.buffers()[1], np.int64)[payload.offset : payload.offset + len(payload) + 1]
            data = np.frombuffer(payload.buffers()[2] or b"", np.uint8)
            order = np.argsort(plan, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], plan[order][1:] != plan[order][:-1]]))
            places, signals, values = [], [], []
            for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
                own = order[a:b]
                for message, wanted in plans[plan[own[0]]]:
                    here = own[layouts.carried(message, is_fd[own], length[own]) & (np.diff(offsets)[own] >= message.size_bytes)]
                    if not len(here):
                        continue
                    cells = data[offsets[here][:, None] + np.arange(message.size_bytes)]
                    for k, signal in wanted:
                        on = layouts.active(cells, message, signal) if signal.multiplex is not None else slice(None)
                        found = here[on]
                        places.append(found)
                        signals.append(np.full(len(found), k))
                        values.append(layouts.value(cells[on], signal))
            if not places:
                continue
            at = pa.array(np.concatenate(places))
            rest = [batch.column(4 + j).take(at) for j in range(n_source + 2)]
            ms = np.asarray(rest[-1]) / 1_000_000.0
            columns = [names.take(pa.array(np.concatenate(signals))), *rest, pa.array(ms), pa.array(np.concatenate(values))]
            yield pa.RecordBatch.from_arrays(columns, names=["signal_key", *(["channel", "direction"] if n_source else []), "seq", "timestamp_ns", "time_ms", "value"])

    return decoded


def decode_by_projection(frames: DataFrame, wanted: Iterable[tuple[str, Message, Signal]], by_source: bool = True) -> DataFrame:
    """The same by one projection: each frame yields an array with the values of its message's signals that it carries; nulls are dropped before
    the array is unfolded."""
    by_message: dict[tuple[int, bool], list[tuple[str, Message, Signal]]] = {}
    for key, message, signal in wanted:
        message.check(signal)
        by_message.setdefault((message.can_id, message.is_extended), []).append((key, message, signal))
    entry = "array<struct<signal_key: string, value: double>>"
    cells, ids = F.lit(None).cast(entry), []
    for (can_id, extended), signals in by_message.items():
        own = []
        for key, message, signal in signals:
            fits = message.carries(F.col("is_fd"), F.col("payload_len")) & message.active(signal, F.col("payload"))
            own.append(F.when(fits, F.struct(F.lit(key).alias("signal_key"), signal.value(F.col("payload")).alias("value"))))
        here = (F.col("can_id") == can_id) & (F.col("is_extended") == extended)
        cells = F.when(here, F.filter(F.array(*own), lambda x: x.isNotNull()).cast(entry)).otherwise(cells)
        ids.append(here)
    some = F.lit(False)
    for here in ids:
        some = some | here
    source = ["channel", "direction"] if by_source else []
    rows = data_frames(frames).where(some).select(*source, "seq", "timestamp_ns", F.explode(cells).alias("x"))
    return rows.select("x.signal_key", *source, "seq", "timestamp_ns", time_ms().alias("time_ms"), "x.value")


def all_signals(database: Database) -> list[tuple[str, Message, Signal]]:
    """Every signal of a database that raw frames can carry, by ``message.signal``."""
    out = []
    for m in database.messages:
        if m.raw_frame_decodable and m.size_bytes <= MOST_BYTES:
            out += [(f"{m.name}.{s.name}", m, s) for s in m.signals if s.name not in m.absent]
    return out
