"""An analysis session: a recording, databases, selected signals, a time window, markers and axes, and questions about them."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formats
from .operators import catalog as catalogs
from .operators import decode, frames, series
from .plans.model import Database, Message, Signal
from .plans.view import Heights, Span, View, first_free, shown
from .sources import frame_index, mf4
from .sources.dbc import message_table, warning_table
from .sources.traces import MOST_DBC, Trace, open_dbc, open_trace, trace_warning

#: Selected signals at most, axes, markers (fixed values).
MOST_SELECTED, AXES, MARKERS = 50, ("y1", "y2", "y3", "y4", "y5"), ("c1", "c2")
#: Beginning of the names of what an MF4 recording brings along: its databases, and the file its native signals stand in.
BROUGHT = "mf4:"


@dataclass
class Selected:
    key: str
    label: str
    signal: Signal
    message: Message | None
    channel: int | None
    direction: str | None
    axis: str = AXES[0]
    #: Recording and number of a native signal.
    native: tuple[str, int] | None = None
    file_id: str = ""
    #: Place in the palette: the first that no other selected signal has.
    colour: int = 0


@dataclass
class Session:
    spark: SparkSession
    databases: dict[str, Database] = field(default_factory=dict)
    trace: Trace | None = None
    selected: dict[str, Selected] = field(default_factory=dict)
    window: tuple[float, float] | None = None
    markers: dict[str, float] = field(default_factory=dict)
    heights: Heights = Heights()
    open_axes: list[str] = field(default_factory=lambda: [AXES[0]])
    #: Why the databases that the recording brings along cannot be used.
    database_fault: str | None = None

    def open_trace(self, path: str, **options) -> Trace:
        """Opens a recording; selection, window, markers and embedded databases of the one before are dropped.

        With ``index``, a new folder, the frames are written there, clustered for questions about one message; else they are cached.
        """
        self.close()
        index = options.pop("index", None)
        self.trace = open_trace(self.spark, path, **options)
        self.trace.frames = frame_index.write(self.trace.frames, index).frames if index else self.trace.frames.cache()
        if self.trace.kind == "mf4":
            self._take_databases()
        return self.trace

    def _take_databases(self) -> None:
        """Adds the databases embedded in the recording: all of them or, if one cannot be read, none."""
        size = F.length("bytes")
        rows = mf4.read_databases(self.spark, self.trace.path).groupBy("name", F.sha2("bytes", 256).alias("hash"))
        rows = rows.agg(F.min("trace_id").alias("trace_id"), F.first(F.when(size <= MOST_DBC, F.col("bytes"))).alias("bytes")).orderBy("trace_id", "name", "hash").collect()
        try:
            if any(r["bytes"] is None for r in rows):
                raise ValueError(f"an embedded database has more than {MOST_DBC} bytes")
            own = {f"{BROUGHT}{i}:{r['name']}": open_dbc(bytes(r["bytes"])) for i, r in enumerate(rows)}
        except ValueError as e:
            self.database_fault = str(e)
        else:
            self.databases |= own

    def close(self) -> None:
        if self.trace is not None:
            self.trace.frames.unpersist()
            self.trace.closed = True
        self.trace, self.window, self.database_fault = None, None, None
        self.databases = {k: v for k, v in self.databases.items() if not k.startswith(BROUGHT)}
        self.heights = Heights()
        self.clear()
        self.markers.clear()

    def add_database(self, file_id: str, database: Database) -> None:
        self.databases[file_id] = database

    def catalog(self) -> DataFrame:
        """All signals of all databases with the sources that send them, and the native signals of an MF4 recording."""
        raw = frames.raw_messages(self.trace.frames) if self.trace else self.spark.createDataFrame([], "can_id int, is_extended boolean, channel int, direction string")
        parts = [catalogs.signals(message_table(self.spark, d), i) for i, d in self.databases.items()]
        own = [self._native()] if self.trace is not None and self.trace.kind == "mf4" else []
        if not parts and not own:
            raise ValueError("no database is open")
        if parts:
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            rows = catalogs.with_sources(rows, raw, self.trace is not None)
            own.insert(0, rows.withColumn("native", F.lit(None).cast("struct<trace_id: string, id: int, unit: string>")))
        return own[0] if len(own) == 1 else own[0].unionByName(own[1], allowMissingColumns=True)

    def _native(self) -> DataFrame:
        """Catalogue rows of the native signals; what only bus signals have is null."""
        nulls = {"can_id": "int", "is_extended": "boolean", "size_bytes": "int", "channel": "int", "direction": "string", "unavailable_reason": "string"}
        name = F.to_json(F.array("trace_id"))
        key = F.concat(F.lit('["mf4",'), F.substring(name, F.lit(2), F.length(name) - 2), F.lit(","), F.concat_ws(",", "data_group", "group", "id"), F.lit("]"))
        return mf4.read_catalog(self.spark, self.trace.path).select(
            F.lit(f"{BROUGHT}native").alias("file_id"), F.col("group_name").alias("message_name"), F.col("id").alias("place"), F.col("name").alias("signal_name"), key.alias("key"),
            F.concat_ws(".", "group_name", "name").alias("label"), F.struct("trace_id", "id", "unit").alias("native"), *[F.lit(None).cast(t).alias(c) for c, t in nulls.items()],
        )

    def warnings(self) -> DataFrame:
        """What the open databases' texts are reported for, by file; no rows where none is open."""
        out = warning_table(self.spark, Database(())).withColumn("file_id", F.lit(""))
        for i, d in self.databases.items():
            out = out.unionByName(warning_table(self.spark, d).withColumn("file_id", F.lit(i)))
        return out

    def search(self, query: str, limit: int = catalogs.DEFAULT_HITS) -> dict:
        rows, most = catalogs.search(catalogs.ordered(self.catalog()), query, limit)
        hits = rows.select("key", "label", "unavailable_reason").collect()
        return {"query": query, "limit": most, "truncated": len(hits) > most, "results": [r.asDict() for r in hits[:most]]}

    def select(self, refs: list[str], chosen: bool = True) -> dict:
        """Selects or drops signals by key or label; says what changed and what could not."""
        if len(refs) > MOST_SELECTED:
            raise ValueError(f"at most {MOST_SELECTED} signals")
        rows = self.catalog()
        asked = self.spark.createDataFrame(list(enumerate(refs)), "place int, ref string")
        found = catalogs.resolve(rows, asked).join(rows.select("key", "label", "file_id", "can_id", "is_extended", "size_bytes", "signal_name", "channel", "direction", "unavailable_reason", "native"), "key", "left").orderBy("place").collect()
        out: dict[str, list[str]] = {"changed": [], "unchanged": [], "unavailable": [], "missing": [], "ambiguous": []}
        for r in found:
            if r["state"] in ("missing", "ambiguous"):
                out[r["state"]].append(r["ref"])
            elif r["state"] == "repeated":
                continue
            elif chosen and r["unavailable_reason"]:
                out["unavailable"].append(r["key"])
            elif (r["key"] in self.selected) == chosen:
                out["unchanged"].append(r["key"])
            elif chosen and r["native"]:
                signal = Signal(r["signal_name"], 0, 64, True, False, 1.0, 0.0, 0.0, 0.0, r["native"]["unit"] or "", value_type="float64")
                self.selected[r["key"]] = Selected(r["key"], r["label"], signal, None, None, None, native=(r["native"]["trace_id"], r["native"]["id"]), file_id=r["file_id"], colour=self._colour())
                out["changed"].append(r["key"])
            elif chosen:
                message, signal = self.databases[r["file_id"]].find(r["can_id"], r["is_extended"], r["size_bytes"], r["signal_name"])
                self.selected[r["key"]] = Selected(r["key"], r["label"], signal, message, r["channel"], r["direction"], file_id=r["file_id"], colour=self._colour())
                out["changed"].append(r["key"])
            else:
                del self.selected[r["key"]]
                out["changed"].append(r["key"])
        return out

    def _colour(self) -> int:
        return first_free(s.colour for s in self.selected.values())

    def toggle(self, ref: str) -> dict:
        """Selects a signal, or drops it if it is selected."""
        return self.select([ref], not any(ref == s.key or ref.lower() == s.label.lower() for s in self.selected.values()))

    def drop_file(self, file_id: str) -> list[str]:
        """Drops the selected signals of a database; returns their keys."""
        gone = [k for k, s in self.selected.items() if s.file_id == file_id]
        for k in gone:
            del self.selected[k]
        return gone

    def clear(self) -> None:
        self.selected.clear()

    def tree(self, query: str = "", active_only: bool = False, hide_unavailable: bool = False, closed: list[str] = ()) -> DataFrame:
        """The rows of the selector: files, messages and signals."""
        files = self.spark.createDataFrame([(i,) for i in self.databases], "file_id string")
        return catalogs.tree(self.catalog(), query, list(self.selected) if active_only else None, hide_unavailable, closed, files)

    def only(self, message: str, signal: str, unit: str) -> str:
        """The key of the one native signal of that group, name and unit; an error unless there is exactly one."""
        own = F.col("native.unit").eqNullSafe(unit) & (F.col("message_name") == message) & (F.col("signal_name") == signal)
        found = self.catalog().where(F.col("native").isNotNull() & own).select("key").limit(2).collect()
        if len(found) != 1:
            raise ValueError(f"{signal} is unavailable")
        return found[0]["key"]

    def plottable(self) -> list[str]:
        """Keys of the selected signals that have samples to draw."""
        have = {r[0] for r in self.series().where(series.finite(F.col("value"))).select("signal_key").distinct().collect()}
        return [k for k in self.selected if k in have]

    def series(self, keys: list[str] | None = None) -> DataFrame:
        """signal_key, seq, timestamp_ns, time_ms, value of the selected signals: bus signals from one scan, native ones from another."""
        own = [self.selected[k] for k in (keys if keys is not None else self.selected)]
        names, parts = ["signal_key", "seq", "timestamp_ns", "time_ms", "value"], []
        if self.trace is not None and (bus := [s for s in own if s.native is None]):
            rows = decode.decode_many(self.trace.frames, [(s.key, s.message, s.signal) for s in bus])
            of = self.spark.createDataFrame([(s.key, s.channel, s.direction or "unknown") for s in bus], "signal_key string, c int, d string")
            rows = rows.join(F.broadcast(of), "signal_key").where(F.col("channel").eqNullSafe(F.col("c")) & (F.col("direction") == F.col("d")))
            parts.append(rows.select(*names))
        if self.trace is not None and (native := [s for s in own if s.native is not None]):
            of = self.spark.createDataFrame([(s.key, *s.native) for s in native], "signal_key string, trace_id string, id int")
            rows = mf4.read_channels(self.spark, sorted({s.native[0] for s in native}), sorted({s.native[1] for s in native}))
            parts.append(rows.join(F.broadcast(of), ["trace_id", "id"]).withColumn("timestamp_ns", F.round(F.col("time_ms") * 1e6).cast("long")).select(*names))
        if not parts:
            return self.spark.createDataFrame([], "signal_key string, seq long, timestamp_ns long, time_ms double, value double")
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def mf4_signal(self, signal_id: int) -> DataFrame:
        if self.trace is None or self.trace.kind != "mf4":
            raise ValueError("no MF4 recording is open")
        return mf4.read_channel(self.spark, self.trace.path, signal_id)

    def domain(self) -> tuple[float, float] | None:
        """Extent of the selected samples' times, or else of the recording."""
        r = self.series().where(series.finite(F.col("value"))).agg(F.min("time_ms"), F.max("time_ms")).first()
        if r[0] is not None:
            return r[0], r[1]
        meta = self.trace.meta.agg(F.max("duration_ns")).first()[0] if self.trace else None
        return None if meta is None else (0.0, meta / 1e6)

    def set_window(self, start_ms: float | None = None, end_ms: float | None = None) -> dict:
        """The visible times, within the domain; without times all of it."""
        whole = self.domain()
        if whole is None:
            return {"error": "there is nothing to show"}
        if start_ms is None and end_ms is None:
            self.window = None
            return {"window": whole}
        a, b = whole[0] if start_ms is None else start_ms, whole[1] if end_ms is None else end_ms
        if not (math.isfinite(a) and math.isfinite(b)) or a >= b:
            return {"error": "the window has no extent"}
        a, b = max(a, whole[0]), min(b, whole[1])
        if a >= b:
            return {"error": "the window does not overlap the recording"}
        self.window = (a, b)
        return {"window": self.window}

    def inspect(self, times_ms: list[float], keys: list[str] | None = None) -> list[dict]:
        """The nearest sample of each signal at each time, with texts and the change since the time before."""
        keys = list(self.selected) if keys is None else keys
        if not 1 <= len(times_ms) <= series.MOST_TIMES or len(keys) > series.MOST_SIGNALS or not all(map(math.isfinite, times_ms)):
            raise ValueError(f"1 to {series.MOST_TIMES} finite times and at most {series.MOST_SIGNALS} signals")
        asked = self.spark.createDataFrame([(k, float(t)) for k in keys for t in dict.fromkeys(times_ms)], "signal_key string, at_ms double")
        rows = self.series(keys)
        extent = {r["signal_key"]: (r["a"], r["b"]) for r in rows.groupBy("signal_key").agg(F.min("time_ms").alias("a"), F.max("time_ms").alias("b")).collect()}
        got = {(r["signal_key"], r["at_ms"]): r for r in series.nearest(rows, asked).collect()}
        out = []
        for k in keys:
            s, last = self.selected[k], None
            for t in map(float, times_ms):
                r = got.get((k, t))
                value = r["value"] if r else None
                text = formats.number(value, s.signal.factor if s.signal.value_type == "integer" else None, s.signal.offset)
                if value is not None:
                    raw = (value - s.signal.offset) / s.signal.factor if s.signal.factor else math.nan
                    known = next((n for v, n in s.signal.value_descriptions if abs(raw - v) < 1e-6), None)
                    text = known if known is not None else f"{text} {s.signal.unit}" if s.signal.unit else text
                row = {"key": k, "at_ms": t, "sample_ms": r["sample_ms"] if r else None, "value": value, "text": text}
                row["outside"] = k not in extent or not extent[k][0] <= t <= extent[k][1]
                if last is not None:
                    row["delta_ms"] = t - last["at_ms"]
                    whole = value is not None and last["value"] is not None and not s.signal.value_descriptions
                    row["delta_value"] = value - last["value"] if whole else None
                out.append(row)
                last = row
        return out

    def set_markers(self, **at_ms: float | None) -> dict[str, float]:
        """Moves or removes the two markers."""
        for name, t in at_ms.items():
            if name not in MARKERS:
                raise ValueError(f"markers are {', '.join(MARKERS)}")
            if t is None:
                self.markers.pop(name, None)
            else:
                self.markers[name] = float(t)
        return dict(self.markers)

    def readout(self) -> list[dict]:
        """Values at the markers and their difference."""
        if set(self.markers) != set(MARKERS):
            return []
        rows = self.inspect([self.markers[m] for m in MARKERS])
        return [{"key": a["key"], "c1": a["text"], "c2": b["text"], "delta": b["delta_value"], "delta_time": formats.duration(b["delta_ms"])} for a, b in zip(rows[::2], rows[1::2], strict=True)]

    def set_axes(self, axes: dict[str, str]) -> None:
        """Puts selected signals on axes; nothing changes unless all of it is valid."""
        for key, axis in axes.items():
            if key not in self.selected or axis not in AXES:
                raise ValueError(f"{key} cannot be put on {axis}")
        for key, axis in axes.items():
            self.selected[key].axis = axis
            if axis not in self.open_axes:
                self.open_axes.append(axis)

    def add_axis(self) -> str | None:
        """Opens the next free axis; None if all are open."""
        axis = next((a for a in AXES if a not in self.open_axes), None)
        if axis is not None:
            self.open_axes.append(axis)
        return axis

    def remove_axis(self, axis: str) -> None:
        """Closes an axis; its signals go to the first one, which always stays."""
        if axis == AXES[0] or axis not in self.open_axes:
            return
        self.open_axes.remove(axis)
        for s in self.selected.values():
            s.axis = AXES[0] if s.axis == axis else s.axis

    def reset_axes(self) -> None:
        for axis in self.open_axes[1:]:
            self.remove_axis(axis)

    def view(self) -> dict:
        """What is shown: the times with the first axis' values (None if there is nothing), whether it is all, and each axis' range."""
        x = self.domain()
        if x is None or x[0] == x[1] == 0.0:
            return {"view": None, "whole": None, "fit": self.window is None, "ranges": {}}
        found = {r["axis"]: Span(r["y_low"], r["y_high"]) for r in self.axes().where("y_low is not null").collect()} if self.selected else {}
        whole = View(Span(*x), found.get(AXES[0], Span(0.0, 1.0)))
        now = shown(whole, Span(*self.window) if self.window else None, self.heights)
        ranges = {a: now.y if a == AXES[0] else self.heights.of(found.get(a, Span(0.0, 1.0))) for a in self.open_axes}
        return {"view": now, "whole": whole, "fit": self.window is None, "ranges": ranges}

    def show(self, view: View | None) -> None:
        """Shows another view, as one before that was panned, zoomed or boxed; without one everything."""
        if view is None:
            self.window, self.heights = None, Heights()
            return
        now = self.view()["view"]
        if now is not None:
            self.window, self.heights = (view.x.low, view.x.high), self.heights.followed(now.y, view.y)

    def plot(self, budget: int | None = None) -> DataFrame:
        """The samples to draw: those of the window and a span on either side, reduced to each signal's share of the budget."""
        rows = self.series()
        if self.window is not None:
            a, b = self.window
            rows = series.window(rows, a - (b - a), b + (b - a))
        return series.lttb(rows, budget or series.points_per_signal(len(self.selected), self.window is not None))

    def axes(self) -> DataFrame:
        """For each axis its unit and the padded range of its signals."""
        own = self.spark.createDataFrame([(s.key, s.axis, s.signal.unit) for s in self.selected.values()], "signal_key string, axis string, unit string")
        ranges = series.domains(self.series().join(own, "signal_key"), ["axis"])
        return catalogs.axis_units(own, list(AXES)).join(ranges, "axis", "left")

    def to_json(self) -> str:
        """The session's description and the catalogue's messages as plain JSON."""
        messages = {i: [json.loads(x) for x in message_table(self.spark, d).toJSON().collect()] for i, d in self.databases.items()}
        return json.dumps({**self.describe(), "catalogs": messages})

    def describe(self) -> dict:
        meta = [r.asDict() for r in self.trace.meta.withColumn("warning", trace_warning(F.col("skipped_line_count"))).collect()] if self.trace else []
        return {
            "trace": meta, "databases": {i: {"messages": len(d.messages), "signals": sum(len(m.signals) - len(m.absent) for m in d.messages), "warnings": len(d.warnings)} for i, d in self.databases.items()},
            "selected": [{"key": s.key, "label": s.label, "axis": s.axis} for s in self.selected.values()], "window": self.window, "markers": dict(self.markers),
        }
