"""Decoded series: nearest samples, deltas, domains, windows, labels, ranges and downsampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import formats
from ..plans.model import Signal

#: Points of a plot, spans a cached slice has, least points of a signal (fixed values).
POINT_BUDGET, SPANS, LEAST_POINTS = 50_000, 3, 2
#: Milliseconds of a signal that are searched together for the nearest samples.
SLICE_MS = 60_000
#: Samples that are sorted, summed and searched for their hull together.
CHUNK = 65_536
#: Signals and times of one inspection at most.
MOST_SIGNALS, MOST_TIMES = 20, 20


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def nearest(series: DataFrame, lookups: DataFrame) -> DataFrame:
    """For each lookup (signal_key, at_ms) the nearest sample of its signal: sample_ms, value; null without samples.

    Ties go to the earlier sample; past the end, of two last samples at one time the earlier one is taken. Samples and lookups meet in
    slices of SLICE_MS of a signal, so that a long signal is sorted by many tasks, and every window only looks back, once in rising and once
    in falling order of time. What a lookup does not find in its own slice comes from the first and last samples of the others.
    """
    slot = lambda t: F.floor(t / F.lit(float(SLICE_MS))).cast("long")
    own, keys = F.struct("time_ms", "value"), ["signal_key", "slot"]
    order = Window.partitionBy(*keys).orderBy("time_ms", "seq")
    kind = "struct<s: struct<time_ms: double, value: double>, before_s: struct<time_ms: double, value: double>>"
    points = series.select("signal_key", slot(F.col("time_ms")).alias("slot"), "time_ms", "seq", "value")
    points = points.select(*keys, "time_ms", "seq", F.struct(own.alias("s"), F.lag(own).over(order).alias("before_s")).alias("sample"), F.lit(1).alias("is_sample"))
    # a lookup stands before the samples of its time
    asked = lookups.select("signal_key", slot(F.col("at_ms")).alias("slot"), F.col("at_ms").alias("time_ms"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast(kind).alias("sample"), F.lit(0).alias("is_sample"))
    back = lambda *by: Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = F.last("sample", True).over(back("time_ms", "is_sample", "seq"))
    after = F.last("sample", True).over(back(F.desc("time_ms"), F.desc("is_sample"), F.desc("seq")))
    rows = points.unionByName(asked).select(*keys, "time_ms", "is_sample", past.alias("p"), after.alias("a")).where("is_sample = 0").select(*keys, F.col("time_ms").alias("at_ms"), "p", "a")
    # the last sample of the slices before and the first one of those behind: a row for each slice that has samples or lookups
    place = F.struct("time_ms", "seq")
    ends = points.groupBy(*keys).agg(F.max_by("sample", place).alias("last"), F.min_by("sample", place).alias("first"))
    ends = ends.unionByName(asked.select(*keys).distinct(), allowMissingColumns=True).groupBy(*keys).agg(F.max("last").alias("last"), F.max("first").alias("first"))
    beside = lambda *by: Window.partitionBy("signal_key").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, F.last("last", True).over(beside("slot")).alias("p_far"), F.last("first", True).over(beside(F.desc("slot"))).alias("a_far"))
    rows = rows.join(ends.withColumnsRenamed({"signal_key": "k", "slot": "o"}), F.col("signal_key").eqNullSafe(F.col("k")) & F.col("slot").eqNullSafe(F.col("o")), "left")
    rows = rows.select("signal_key", "at_ms", F.coalesce("p", "p_far").alias("p"), F.coalesce("a", "a_far").alias("a"))
    low = F.when(F.col("a").isNotNull(), F.col("a.s")).otherwise(F.col("p.s"))
    previous = F.when(F.col("a").isNull(), F.coalesce(F.col("p.before_s"), F.col("p.s"))).when(F.col("p").isNotNull(), F.col("p.s")).otherwise(F.col("a.s"))
    at = F.col("at_ms")
    best = F.when(F.abs(F.col("previous.time_ms") - at) <= F.abs(F.col("low.time_ms") - at), F.col("previous")).otherwise(F.col("low"))
    rows = rows.select("signal_key", "at_ms", low.alias("low"), previous.alias("previous")).select("signal_key", "at_ms", F.when(finite(at), best).alias("b"))
    return rows.select("signal_key", "at_ms", F.col("b.time_ms").alias("sample_ms"), F.col("b.value").alias("value"))


def deltas(inspected: DataFrame, enumerated: Column | None = None) -> DataFrame:
    """delta_ms and delta_value to the previous lookup of the signal; enumerated signals have no difference of values."""
    order = Window.partitionBy("signal_key").orderBy("at_ms")
    change = F.col("value") - F.lag("value").over(order)
    return inspected.withColumns({"delta_ms": F.col("at_ms") - F.lag("at_ms").over(order), "delta_value": change if enumerated is None else F.when(~enumerated, change)})


def padded(low: Column, high: Column, share: float) -> tuple[Column, Column]:
    """A range with a margin on either side; a range of one value gets at least one on either side."""
    alone = F.greatest(F.lit(1.0), F.abs(low) * 0.05)
    margin = F.when(low == high, alone).otherwise((high - low) * F.lit(share))
    return low - margin, high + margin


def domains(series: DataFrame, keys: list[str]) -> DataFrame:
    """Extent of times and values over finite samples, and the value axis with its margin of 5 %."""
    out = series.where(finite(F.col("value")) & finite(F.col("time_ms"))).groupBy(*keys).agg(F.min("time_ms").alias("x_min"), F.max("time_ms").alias("x_max"), F.min("value").alias("y_min"), F.max("value").alias("y_max"))
    low, high = padded(F.col("y_min"), F.col("y_max"), 0.05)
    return out.withColumns({"y_low": low, "y_high": high})


def window(series: DataFrame, start_ms: float, end_ms: float) -> DataFrame:
    """The samples within a window and one neighbour on either side; with none inside, the pair around it.

    The filter on time reaches the scan; the neighbours are one aggregate for each signal, summed up before anything is shuffled.
    """
    a, b = min(start_ms, end_ms), max(start_ms, end_ms)
    t, row = F.col("time_ms"), F.struct(*series.columns)
    inside = t.between(a, b)
    place = F.struct("time_ms", "seq")
    before, behind = F.max_by(row, F.when(t < a, place)), F.min_by(row, F.when(t > b, place))
    ends = series.groupBy("signal_key").agg(F.count_if(inside).alias("n"), before.alias("before"), behind.alias("behind"))
    # a sample before the window is a neighbour if one lies in the window or behind it, and the other way round
    around = F.array_compact(F.array(F.when((F.col("n") > 0) | F.col("behind").isNotNull(), F.col("before")), F.when((F.col("n") > 0) | F.col("before").isNotNull(), F.col("behind"))))
    return series.where(inside).unionByName(ends.select(F.explode(around).alias("r")).select("r.*"))


def raw_of(value: Column, factor: Column, offset: Column) -> Column:
    """The whole raw number a physical value stands for, or null."""
    raw = (value - offset) / F.nullif(factor, F.lit(0.0))
    whole = F.floor(raw + 0.5)
    return F.when(F.abs(raw - whole.cast("double")) < 1e-6, whole.cast("long"))


def label(raw: Column, descriptions: Column) -> Column:
    """The first label of a raw number in an array of (raw_value, label)."""
    return F.get(F.filter(descriptions, lambda x: x["raw_value"] == raw), F.lit(0))["label"]


def label_of(signal: Signal, value: Column) -> Column:
    table = F.array(*[F.struct(F.lit(r).cast("long").alias("raw_value"), F.lit(t).alias("label")) for r, t in signal.value_descriptions]) if signal.value_descriptions else F.lit(None).cast("array<struct<raw_value: bigint, label: string>>")
    return label(raw_of(value, F.lit(float(signal.factor)), F.lit(float(signal.offset))), table)


def out_of_range(signal: Signal, value: Column) -> Column:
    """Whether a value lies outside the stated range; 0 to 0 states none. Integers are compared at their resolution, floats at seven digits."""
    low, high = signal.minimum, signal.maximum
    if low == 0 and high == 0:
        return F.lit(False)
    if signal.value_type == "integer":
        decimals = max(formats.decimal_places(signal.factor), formats.decimal_places(signal.offset))
        shown = F.round(value, decimals) if decimals <= 15 else value
    else:
        low, high = formats.to_precision(low), formats.to_precision(high)
        shown = _to_precision(value)
    return F.when(finite(value), (shown < F.lit(low)) | (shown > F.lit(high))).otherwise(False)


@F.pandas_udf(T.DoubleType())
def _to_precision(value: pd.Series) -> pd.Series:
    return value.map(formats.to_precision, na_action="ignore")


def display(signal: Signal, value: Column) -> Column:
    """The text of a value: its label, or the number with its unit."""
    factor = signal.factor if signal.value_type == "integer" else None
    offset, unit = signal.offset, signal.unit

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        shown = values.map(lambda v: formats.number(None if v is None or pd.isna(v) else float(v), factor, offset))
        return shown.where(shown == "-", shown + f" {unit}") if unit else shown

    return F.coalesce(label_of(signal, value), text(value))


def _total(v: np.ndarray) -> float:
    """The sum from the left, of runs of CHUNK."""
    total = 0.0
    for at in range(0, len(v), CHUNK):
        total += float(np.cumsum(v[at : at + CHUNK])[-1])
    return total


def _area(anchor: tuple[float, float], mean: tuple[float, float], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Twice the triangles' areas; below all others where they are no numbers."""
    with np.errstate(invalid="ignore", over="ignore"):
        area = np.abs((anchor[0] - mean[0]) * (y - anchor[1]) - (anchor[0] - x) * (mean[1] - anchor[1]))
    return np.where(np.isnan(area), -1.0, area)


def lttb_indices(x: np.ndarray, y: np.ndarray, target: float) -> np.ndarray:
    """Places of the samples that keep a line's shape: the ends, and of each bucket the sample that spans the largest triangle
    with the one kept before and the mean of the next bucket; the first of equals."""
    n, keep = len(x), max(2, math.floor(target))
    if n <= keep:
        return np.arange(n)
    if keep == 2:
        return np.array([0, n - 1])
    width, out, last = (n - 2) / (keep - 2), [0], 0
    edge = lambda k: min(math.floor(k * width) + 1, n - 1)
    for k in range(keep - 2):
        a, b = edge(k), edge(k + 1)
        c, d = b, max(b + 1, edge(k + 2))
        mean = _total(x[c:d]) / (d - c), _total(y[c:d]) / (d - c)
        last = a + int(np.argmax(_area((x[last], y[last]), mean, x[a:b], y[a:b])))
        out.append(last)
    return np.array([*out, n - 1])


def numbered(series: DataFrame) -> DataFrame:
    """The samples with their place i in time order, and of their signal n (how many), x_most, y_most (largest sizes), odd (whether one is no finite number).

    Places are counted within slots of time, as many as give CHUNK samples each of an even signal, and over a signal's slots, so no task
    sorts more than a slot.
    """
    low, high = F.min("time_ms"), F.max("time_ms")
    odd = F.bool_or(~(finite(F.col("time_ms")) & finite(F.col("value"))))
    signals = series.groupBy("signal_key").agg(F.count("*").alias("n"), low.alias("low"), high.alias("high"), F.max(F.abs("time_ms")).alias("x_most"), F.max(F.abs("value")).alias("y_most"), odd.alias("odd"))
    share = (F.col("time_ms") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    slots = F.ceil(F.col("n") / CHUNK)
    slot = F.when(F.col("odd"), F.lit(0)).otherwise(F.least(F.coalesce(F.floor(share * slots), F.lit(0)), slots - 1))
    rows = series.select("signal_key", "seq", "time_ms", "value").join(signals, "signal_key")
    rows = rows.withColumn("slot", slot.cast("long")).drop("low", "high")
    before = Window.partitionBy("signal_key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("signal_key", "slot").agg(F.count("*").alias("own")).select("signal_key", "slot", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("signal_key", "slot").orderBy("time_ms", "seq"))
    return rows.withColumn("nth", within).join(starts, ["signal_key", "slot"]).select("signal_key", "seq", "time_ms", "value", "n", "x_most", "y_most", "odd", (F.col("start") + F.col("nth") - 1).alias("i"))


def _hull(x: np.ndarray, y: np.ndarray, up: bool) -> tuple[list[float], list[float]]:
    """The upper or the lower chain of the convex hull of points in the order of x."""
    xs, ys, sign = [], [], 1.0 if up else -1.0
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        if xs and xs[-1] == a:
            if sign * ys[-1] >= sign * b:
                continue
            xs.pop()
            ys.pop()
        while len(xs) > 1 and sign * ((xs[-1] - xs[-2]) * (b - ys[-2]) - (ys[-1] - ys[-2]) * (a - xs[-2])) >= 0:
            xs.pop()
            ys.pop()
        xs.append(a)
        ys.append(b)
    return xs, ys


def outer(x: np.ndarray, y: np.ndarray, x_most: float, y_most: float) -> np.ndarray:
    """Places of the samples of a bucket (in time order) that any anchor and mean could choose.

    For a given anchor and mean the triangle's area is the absolute value of a linear function, which is largest at a corner of the convex
    hull. A sample is left out only if it lies deeper within the hull than all rounding of the areas reaches, so ties and nearly equal samples stay.
    """
    at = np.arange(len(x))
    deep_x, deep_y = x_most * 2.0**-47, y_most * 2.0**-47  # 64 units of rounding; the areas' own are 16 at most

    def left(own: np.ndarray, corners: np.ndarray) -> np.ndarray:
        (ux, uy), (lx, ly) = (_hull(x[corners], y[corners], up) for up in (True, False))
        px, py = x[own], y[own]
        inside = (px - deep_x >= ux[0]) & (px + deep_x <= ux[-1])
        for d in (-deep_x, deep_x):
            inside &= (np.interp(px + d, ux, uy) >= py + deep_y) & (np.interp(px + d, lx, ly) <= py - deep_y)
        return own[~inside]

    if len(x) > 256:  # most samples lie within the hull of the highest and lowest of every 32
        n = len(x) // 32 * 32
        blocks, first = y[:n].reshape(-1, 32), np.arange(0, n, 32)
        some = np.unique(np.concatenate([[0, len(x) - 1], first + blocks.argmax(1), first + blocks.argmin(1)]))
        at = left(at, some)
    if len(at) > 2:
        at = left(at, at)
    return np.union1d(at, [0])


#: What the second task gets: sums of a chunk for the bucket before (kind 0; i is how many), and samples that may be chosen (kind 1).
_KEPT = "signal_key string, bucket long, kind int, chunk long, i long, seq long, time_ms double, value double"


def _chunks(batches: Iterator) -> Iterator:
    """Rows sorted by signal, bucket, chunk and place -> for each chunk a row with its sums for the bucket before, and the samples that may be chosen."""
    import pyarrow as pa

    names = [c.split()[0] for c in _KEPT.split(", ")]

    def reduced(rows: pd.DataFrame) -> pa.RecordBatch:
        edges = np.flatnonzero(np.concatenate([[True], (rows[["signal_key", "bucket", "chunk"]].to_numpy()[1:] != rows[["signal_key", "bucket", "chunk"]].to_numpy()[:-1]).any(1)]))
        parts = []
        columns = {c: rows[c].to_numpy() for c in rows}
        for a, b in zip(edges, [*edges[1:], len(rows)], strict=True):
            x, y, bucket = columns["time_ms"][a:b], columns["value"][a:b], int(columns["bucket"][a])
            key, chunk = columns["signal_key"][a], int(columns["chunk"][a])
            if columns["adds"][a]:
                parts.append(([key], [bucket - 1], [0], [chunk], [b - a], [0], [float(np.cumsum(x)[-1])], [float(np.cumsum(y)[-1])]))
            if columns["chosen"][a]:
                own = np.arange(b - a) if b - a < 3 or columns["odd"][a] else outer(x, y, columns["x_most"][a], columns["y_most"][a])
                m = len(own)
                parts.append(([key] * m, [bucket] * m, [1] * m, [chunk] * m, columns["i"][a:b][own].tolist(), columns["seq"][a:b][own].tolist(), x[own].tolist(), y[own].tolist()))
        flat = [[v for p in parts for v in p[j]] for j in range(len(names))]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(flat, kinds, strict=True)], names=names)

    held: list[pd.DataFrame] = []
    for batch in batches:
        rows = batch.to_pandas()
        if not len(rows):
            continue
        last = rows[["signal_key", "bucket", "chunk"]].iloc[-1]
        open_ = (rows[["signal_key", "bucket", "chunk"]] == last).all(axis=1).to_numpy()
        cut = int(np.flatnonzero(~open_)[-1]) + 1 if not open_.all() else 0
        if cut or held and (held[-1][["signal_key", "bucket", "chunk"]].iloc[-1] != last).any():
            yield reduced(pd.concat([*held, rows.iloc[:cut]], ignore_index=True))
            held = []
        held.append(rows.iloc[cut:])
    if held:
        yield reduced(pd.concat(held, ignore_index=True))


def _pick(batches: Iterator) -> Iterator:
    """Rows of _KEPT sorted by signal, bucket, kind, chunk and place -> the samples of the line; what is held is a batch, an anchor and a best sample."""
    import pyarrow as pa

    signal, anchor, total, best, bucket = None, None, [0.0, 0.0, 0], None, None
    for batch in batches:
        out: list[tuple] = []
        rows = batch.to_pandas()
        columns = {c: rows[c].to_numpy() for c in rows}
        marks = np.stack([rows["signal_key"].factorize()[0], columns["bucket"], columns["kind"]])
        edges = np.flatnonzero(np.concatenate([[True], (marks[:, 1:] != marks[:, :-1]).any(0)])) if len(rows) else []
        for a, b in zip(edges, [*edges[1:], len(rows)], strict=True):
            key, own, kind = columns["signal_key"][a], int(columns["bucket"][a]), int(columns["kind"][a])
            if key != signal or own != bucket:
                if best is not None:
                    out.append(best[1])
                    anchor = best[1][2:]
                if key != signal:
                    anchor = None
                signal, bucket, best, total = key, own, None, [0.0, 0.0, 0]
            x, y = columns["time_ms"][a:b], columns["value"][a:b]
            if kind == 0:
                for j in range(b - a):
                    total = [total[0] + x[j], total[1] + y[j], total[2] + int(columns["i"][a + j])]
                continue
            if anchor is None or total[2] == 0:  # the ends
                areas = np.zeros(b - a)
            else:
                areas = _area(anchor, (total[0] / total[2], total[1] / total[2]), x, y)
            j = int(np.argmax(areas))
            if best is None or areas[j] > best[0]:
                best = areas[j], (key, int(columns["seq"][a + j]), float(x[j]), float(y[j]))
        yield _lines(out, pa)
    yield _lines([best[1]] if best is not None else [], pa)


def _lines(rows: list[tuple], pa):
    kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=["signal_key", "seq", "time_ms", "value"])


def lttb(series: DataFrame, target: float) -> DataFrame:
    """Each signal's series reduced to ``target`` points, as ``lttb_indices`` does it.

    The hulls of the buckets (in chunks of CHUNK samples) are built in parallel, also those of one signal; one task then follows a signal from
    anchor to anchor over the hulls only, with the sums of the next bucket before the samples of each. Samples on one line all stay on the
    hull, so such a signal passes through that task whole, though never at once. A signal with a value that is no finite number is not thinned.
    """
    keep = max(2, math.floor(target))
    rows, last = numbered(series), F.col("n") - 1
    ends = (F.col("n") <= keep) | (F.col("i") == 0) | (F.col("i") == last)
    plain = rows.where(ends if keep == 2 else F.col("n") <= keep).select("signal_key", "seq", "time_ms", "value")
    if keep == 2:
        return plain
    width = (F.col("n") - 2).cast("double") / F.lit(float(keep - 2))
    edge = lambda k: F.least(F.floor(k * width) + 1, last)
    near = F.greatest(F.floor((F.col("i") - 1) / width), F.lit(0))
    bucket = F.when(edge(near) > F.col("i"), near - 1).when(edge(near + 1) <= F.col("i"), near + 1).otherwise(near)
    tail = F.lit(keep - 2)  # what lies behind the last bucket: the end, or by rounding a sample before it
    bucket = F.when(F.col("i") == 0, F.lit(-1)).when(F.col("i") == last, F.lit(keep - 1)).otherwise(F.least(bucket, tail)).cast("long")
    own = rows.where(F.col("n") > keep).withColumn("bucket", bucket)
    at_end = (F.col("bucket") == keep - 1) & (edge(tail) == last)
    end_sum = own.where(at_end).withColumn("bucket", tail.cast("long"))  # the end stands for the bucket after the last
    own = own.withColumns({"adds": F.col("bucket").between(1, keep - 2), "chosen": F.col("bucket") != keep - 2})
    own = own.unionByName(end_sum.withColumns({"adds": F.lit(True), "chosen": F.lit(False)}))
    start = F.when(F.col("bucket").between(0, keep - 3), edge(F.col("bucket"))).otherwise(F.col("i"))
    own = own.withColumn("chunk", F.floor((F.col("i") - start) / CHUNK).cast("long"))
    keys = ["signal_key", "bucket", "chunk"]
    chunks = own.repartition(*keys).sortWithinPartitions(*keys, "i").mapInArrow(_chunks, _KEPT)
    line = chunks.repartition("signal_key").sortWithinPartitions("signal_key", "bucket", "kind", "chunk", "i").mapInArrow(_pick, "signal_key string, seq long, time_ms double, value double")
    return plain.unionByName(line)


def points_per_signal(active: int, buffered: bool) -> int:
    """The share of the point budget of each active signal."""
    return max(LEAST_POINTS, math.floor(POINT_BUDGET * (SPANS if buffered else 1) / max(1, active)))

