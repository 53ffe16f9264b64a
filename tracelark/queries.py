"""The registered queries of the trace operators, over the bus derived from ``events``, and the same results as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import recordings, sql
from . import virtual_bus as bus
from .functions.bits import j1939
from .operators import catalog, decode, frames, series
from .plans import layouts
from .plans.model import Database, Message
from .sources import blf, dbc, frame_index, mf4
from .sources.traces import open_trace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, bare: bool = False) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL behind the bus's tables."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql if bare else bus.BUS_SQL + sql
        return f

    return register


def _decoded(signal, message=bus.MESSAGE, table=bus.frames):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return decode.samples(frames.data_frames(table(spark, sf_dir)), message, signal).select("seq", "time_ms", "value")

    return run


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value signal of every identifier, as one series each."""
    own = frames.data_frames(bus.frames(spark, sf_dir))
    own = own.where(bus.MESSAGE.carries(F.col("is_fd"), F.col("payload_len")))
    return own.select(F.col("can_id").cast("string").alias("signal_key"), "seq", "timestamp_ns", decode.time_ms().alias("time_ms"), bus.VALUE.value(F.col("payload")).alias("value"))


SERIES_SQL = "CAST(can_id AS VARCHAR) AS signal_key, seq, time_ms, w * 0.5::DOUBLE + -100.0::DOUBLE AS value"


@query("SELECT seq, timestamp_ns, channel, direction, can_id, is_fd, payload_len FROM data")
def frame_scan_data_only(spark, sf_dir):
    return frames.data_frames(bus.frames(spark, sf_dir)).select("seq", "timestamp_ns", "channel", "direction", "can_id", "is_fd", "payload_len")


@query("SELECT DISTINCT can_id, false AS is_extended, channel, direction FROM data")
def raw_messages_distinct(spark, sf_dir):
    return frames.raw_messages(bus.frames(spark, sf_dir))


@query("SELECT count(*) AS valid_message_count, max(timestamp_ns) AS duration_ns FROM data")
def trace_metadata(spark, sf_dir):
    return frames.metadata(bus.frames(spark, sf_dir))


@query("""SELECT can_id, false AS is_extended, channel, direction, count(*) AS n_frames, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns,
  min(payload_len) = max(payload_len) AND min(is_fd) = max(is_fd) AS is_uniform FROM data GROUP BY can_id, channel, direction""")
def bucket_uniformity(spark, sf_dir):
    return frames.buckets(bus.frames(spark, sf_dir))


@query("SELECT seq, time_ms, w * 0.5::DOUBLE + -100.0::DOUBLE AS value FROM carried")
def decode_unsigned16_le(spark, sf_dir):
    return _decoded(bus.VALUE)(spark, sf_dir)


@query("SELECT seq, time_ms, (CASE WHEN w >= 32768 THEN w - 65536 ELSE w END) * 0.25::DOUBLE + 10.0::DOUBLE AS value FROM carried")
def decode_signed16_le(spark, sf_dir):
    return _decoded(bus.SIGNED)(spark, sf_dir)


@query("SELECT seq, time_ms, (CASE WHEN wb >= 32768 THEN wb - 65536 ELSE wb END) * 0.1::DOUBLE + -3.0::DOUBLE AS value FROM carried")
def decode_signed16_be(spark, sf_dir):
    return _decoded(bus.SIGNED_BE)(spark, sf_dir)


@query("SELECT seq, time_ms, (w >> 4) * 2.0::DOUBLE + 1.0::DOUBLE AS value FROM carried")
def decode_bitfield_unaligned(spark, sf_dir):
    return _decoded(bus.NIBBLES)(spark, sf_dir)


@query("""SELECT seq, time_ms, (CASE WHEN event_id % 2 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) *
  ((((raw * 771 + event_id) & 8388607) + 8388608)::DOUBLE * pow(2.0::DOUBLE, (120 + event_id % 16 - 150)::DOUBLE)) AS value FROM data""")
def decode_float32(spark, sf_dir):
    return _decoded(bus.F32, bus.FLOATS, bus.float_frames)(spark, sf_dir)


@query("""SELECT seq, time_ms, (CASE WHEN event_id % 2 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) *
  ((((raw * 12345 + event_id) & 4503599627370495) + 4503599627370496)::DOUBLE * pow(2.0::DOUBLE, (1000 + event_id % 50 - 1075)::DOUBLE)) AS value FROM data""")
def decode_float64(spark, sf_dir):
    return _decoded(bus.F64, bus.FLOATS, bus.float_frames)(spark, sf_dir)


@query("SELECT seq, is_fd, payload_len, payload_len = 8 AS carries FROM data")
def decode_carry_filter(spark, sf_dir):
    own = frames.data_frames(bus.frames(spark, sf_dir))
    return own.select("seq", "is_fd", "payload_len", bus.MESSAGE.carries(F.col("is_fd"), F.col("payload_len")).alias("carries"))


@query("SELECT seq, time_ms, counter * 1.0::DOUBLE AS value FROM carried WHERE sel = 2")
def decode_mux_simple(spark, sf_dir):
    return _decoded(bus.SIMPLE)(spark, sf_dir)


@query("""SELECT seq, time_ms, (CASE WHEN x >= 32768 THEN x - 65536 ELSE x END) * 0.5::DOUBLE + -10.0::DOUBLE AS value
  FROM (SELECT *, (((w >> 8) & 1) * 32768 + sel * 128 + (counter >> 1)) AS x FROM carried WHERE sel BETWEEN 1 AND 3 AND (sel = 1 OR sel BETWEEN 3 AND 9))""")
def decode_mux_nested(spark, sf_dir):
    return _decoded(bus.NESTED)(spark, sf_dir)


@query("SELECT seq, time_ms, w * 0.5::DOUBLE + -100.0::DOUBLE AS value FROM carried WHERE can_id = 7 AND channel = 1 AND direction = 'rx'")
def decode_source_filtered(spark, sf_dir):
    own = frames.of_source(frames.of_message(bus.frames(spark, sf_dir), 7, False), (1, "rx"))
    return decode.samples(own, bus.MESSAGE, bus.VALUE).select("seq", "time_ms", "value")


@query("""SELECT CASE can_id WHEN 3 THEN 'three' WHEN 4 THEN 'four' ELSE 'five' END || '.' || s AS signal_key, channel, direction, seq, time_ms, value FROM (
  SELECT can_id, channel, direction, seq, time_ms, 'Value' AS s, w * 0.5::DOUBLE + -100.0::DOUBLE AS value FROM carried UNION ALL
  SELECT can_id, channel, direction, seq, time_ms, 'Nibbles', (w >> 4) * 2.0::DOUBLE + 1.0::DOUBLE FROM carried UNION ALL
  SELECT can_id, channel, direction, seq, time_ms, 'Simple', counter * 1.0::DOUBLE FROM carried WHERE sel = 2) WHERE can_id IN (3, 4, 5)""")
def decode_multi_signal_long(spark, sf_dir):
    from dataclasses import replace

    own = [(f"{name}.{s.name}", replace(bus.MESSAGE, can_id=k, name=name), s) for k, name in ((3, "three"), (4, "four"), (5, "five")) for s in (bus.VALUE, bus.NIBBLES, bus.SIMPLE)]
    return decode.decode_many(bus.frames(spark, sf_dir), own).drop("timestamp_ns")


@query("""SELECT 'M' || can_id || '.' || s AS signal_key, channel, direction, seq, time_ms, value FROM (SELECT *, 'Value' AS s, w * 0.5::DOUBLE + -100.0::DOUBLE AS value FROM carried
  UNION ALL SELECT *, 'SignedBe', (CASE WHEN wb >= 32768 THEN wb - 65536 ELSE wb END) * 0.1::DOUBLE + -3.0::DOUBLE FROM carried UNION ALL SELECT *, 'Simple', counter::DOUBLE FROM carried WHERE sel = 2)""")
def decode_plan_table(spark, sf_dir):
    """A message for each of all 2,048 identifiers, three signals each, in one scan."""
    messages = [Message(i, i, False, f"M{i}", 8, bus.MESSAGE.signals) for i in range(2048)]
    wanted = [(f"{m.name}.{s.name}", m, s) for m in messages for s in (bus.VALUE, bus.SIGNED_BE, bus.SIMPLE)]
    return decode.decode_many(bus.frames(spark, sf_dir), wanted).drop("timestamp_ns")


@query("SELECT channel, direction, seq, time_ms, sel::DOUBLE AS value, CASE sel WHEN 0 THEN 'off' WHEN 1 THEN 'idle' WHEN 3 THEN 'run' END AS label FROM carried WHERE can_id % 8 = 7 AND channel = 1")
def sql_signal_labels(spark, sf_dir):
    """Samples and labels asked from SQL text, through functions that are registered in the session."""
    own = bus.frames(spark, sf_dir).where("can_id % 8 = 7").withColumn("can_id", F.lit(7))
    sql.register(spark, own, layouts.rows(spark, [("Bus.Mode", Message(7, 7, False, "Bus", 8, bus.MESSAGE.signals), bus.MODE)]))
    return spark.sql("SELECT channel, direction, seq, time_ms, value, label FROM signal_labels('Bus.Mode') WHERE channel = 1")


def _catalog(spark: SparkSession) -> DataFrame:
    """A catalogue of 64 messages with two signals each; every eighth message is sent over several frames."""
    unit = F.when(F.col("id") % 3 == 0, "V").otherwise("A")
    ids = spark.range(0, 64).select((F.col("id") * 5).cast("int").alias("can_id"), F.lit(False).alias("is_extended"), F.lit(8).alias("size_bytes"), (F.col("id") % 8 != 7).alias("raw_frame_decodable"), F.concat(F.lit("Msg"), "id").alias("message_name"), F.explode(F.array(F.lit(0), F.lit(1))).alias("place"), unit.alias("unit"))
    return ids.select(F.lit("file").alias("file_id"), "*", F.when(F.col("place") == 0, "Speed").otherwise("Torque").alias("signal_name")).drop("unit")


CATALOG_SQL = """, cat AS (SELECT CAST(id * 5 AS INTEGER) AS can_id, id % 8 <> 7 AS decodable, 'Msg' || id || '.' || s AS name FROM range(64) t(id), (VALUES ('Speed'), ('Torque')) v(s)),
seen AS (SELECT DISTINCT can_id, channel, direction FROM data),
joined AS (SELECT cat.*, channel, direction, count(*) OVER (PARTITION BY name) AS n, seen.can_id IS NULL AS absent FROM cat LEFT JOIN seen USING (can_id)),
labelled AS (SELECT *, name || CASE WHEN n > 1 AND channel IS NOT NULL THEN ' [Channel ' || channel || CASE direction WHEN 'rx' THEN ' · Rx' WHEN 'tx' THEN ' · Tx' ELSE '' END || ']' ELSE '' END AS label FROM joined)
"""


@query(CATALOG_SQL + "SELECT can_id, channel, direction, label, CASE WHEN NOT decodable THEN 'Plotting not yet supported' WHEN absent THEN 'Not present in this trace' END AS unavailable_reason FROM labelled")
def catalog_left_join_sources(spark, sf_dir):
    out = catalog.with_sources(_catalog(spark), frames.raw_messages(bus.frames(spark, sf_dir)))
    return out.select("can_id", "channel", "direction", "label", "unavailable_reason")


@query(CATALOG_SQL + "SELECT can_id, channel, direction, label FROM labelled WHERE contains(lower(label), 'speed') AND contains(lower(label), 'channel') AND (contains(lower(label), '1e') OR can_id = 30)")
def search_signals_terms(spark, sf_dir):
    rows = catalog.with_sources(_catalog(spark), frames.raw_messages(bus.frames(spark, sf_dir)))
    hay, ident = catalog.text.folded(F.col("label")), F.lower(F.conv("can_id", 10, 16))
    for term in catalog.text.terms("  SPÉED, 0x1E channel "):
        rows = rows.where(catalog.text.matches_term(hay, ident, term))
    return rows.select("can_id", "channel", "direction", "label")


@query(CATALOG_SQL + """, kept AS (SELECT * FROM labelled WHERE contains(lower(label), 'speed') AND decodable AND NOT absent)
SELECT 'dbc' AS kind, 'file' AS label, true AS expanded WHERE EXISTS (SELECT 1 FROM kept) UNION ALL
SELECT DISTINCT 'message', split_part(name, '.', 1), true FROM kept UNION ALL SELECT 'signal', label, NULL FROM kept""")
def selector_tree(spark, sf_dir):
    """Rows of a selector: files, messages and signals that match a search and can be plotted."""
    rows = catalog.with_sources(_catalog(spark), frames.raw_messages(bus.frames(spark, sf_dir)))
    return catalog.tree(rows, "speed", hide_unavailable=True).drop("key")


@query("SELECT seq, CASE sel WHEN 0 THEN 'off' WHEN 1 THEN 'idle' WHEN 3 THEN 'run' END AS label FROM carried")
def value_label_lookup(spark, sf_dir):
    own = decode.samples(frames.data_frames(bus.frames(spark, sf_dir)), bus.MESSAGE, bus.MODE)
    return own.select("seq", series.label_of(bus.MODE, F.col("value")).alias("label"))


@query("""SELECT seq, w * 0.5::DOUBLE + -100.0::DOUBLE < 0 OR w * 0.5::DOUBLE + -100.0::DOUBLE > 20000 AS value_out, false AS unspecified_out,
  (CASE WHEN w >= 32768 THEN w - 65536 ELSE w END) * 0.25::DOUBLE + 10.0::DOUBLE NOT BETWEEN -5000 AND 5000 AS signed_out FROM carried""")
def out_of_range_flag(spark, sf_dir):
    own = frames.data_frames(bus.frames(spark, sf_dir)).where(bus.MESSAGE.carries(F.col("is_fd"), F.col("payload_len")))
    flag = lambda s: series.out_of_range(s, s.value(F.col("payload")))
    return own.select("seq", flag(bus.VALUE).alias("value_out"), flag(bus.SIGNED_BE).alias("unspecified_out"), flag(bus.SIGNED).alias("signed_out"))


@query("""SELECT seq, id29, CAST(CASE WHEN ((id29 >> 16) & 255) < 240 THEN (id29 >> 8) & 261888 ELSE (id29 >> 8) & 262143 END AS INTEGER) AS pgn,
  CAST(id29 & 255 AS INTEGER) AS source_address, CAST((id29 >> 26) & 7 AS INTEGER) AS priority FROM (SELECT seq, (raw * 2654435 + event_id * 65537) & 536870911 AS id29 FROM bus)""")
def j1939_split(spark, sf_dir):
    e = bus._base(spark, sf_dir)
    id29 = (F.col("raw") * 2654435 + F.col("event_id") * 65537).bitwiseAND(F.lit(0x1FFFFFFF).cast("bigint"))
    return e.select("seq", id29.alias("id29")).select("seq", "id29", *[c.alias(k) for k, c in j1939(F.col("id29")).items()])


NEAREST_SQL = f""", s AS (SELECT {SERIES_SQL} FROM carried),
lookups AS (SELECT DISTINCT CAST(can_id AS VARCHAR) AS signal_key, CAST(x AS DOUBLE) AS at_ms FROM data, (VALUES (-5), (1000000), (500000000), (1e15)) v(x)),
ranked AS (SELECT l.signal_key, l.at_ms, s.time_ms, s.value, row_number() OVER (PARTITION BY l.signal_key, l.at_ms ORDER BY abs(s.time_ms - l.at_ms), s.time_ms, s.seq) AS r FROM lookups l JOIN s USING (signal_key))
SELECT signal_key, at_ms, time_ms AS sample_ms, value FROM ranked WHERE r = 1"""


def _lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = frames.data_frames(bus.frames(spark, sf_dir)).select(F.col("can_id").cast("string").alias("signal_key")).distinct()
    return keys.withColumn("at_ms", F.explode(F.array(*[F.lit(x) for x in (-5.0, 1e6, 5e8, 1e15)])))


@query(NEAREST_SQL)
def nearest_sample_asof(spark, sf_dir):
    return series.nearest(_series(spark, sf_dir), _lookups(spark, sf_dir)).where("sample_ms is not null")


@query(NEAREST_SQL.replace("SELECT signal_key, at_ms, time_ms AS sample_ms, value FROM ranked WHERE r = 1", """, hit AS (SELECT * FROM ranked WHERE r = 1)
SELECT signal_key, at_ms, value, at_ms - lag(at_ms) OVER w AS delta_ms, value - lag(value) OVER w AS delta_value FROM hit WINDOW w AS (PARTITION BY signal_key ORDER BY at_ms)"""))
def inspect_deltas(spark, sf_dir):
    got = series.nearest(_series(spark, sf_dir), _lookups(spark, sf_dir)).where("sample_ms is not null")
    return series.deltas(got).select("signal_key", "at_ms", "value", "delta_ms", "delta_value")


@query(NEAREST_SQL.replace("SELECT signal_key, at_ms, time_ms AS sample_ms, value FROM ranked WHERE r = 1", """SELECT a.signal_key, b.value - a.value AS delta FROM ranked a JOIN ranked b USING (signal_key) WHERE a.r = 1 AND b.r = 1 AND a.at_ms = 1e6 AND b.at_ms = 5e8"""))
def crosshair_delta(spark, sf_dir):
    got = series.nearest(_series(spark, sf_dir), _lookups(spark, sf_dir).where("at_ms in (1e6, 5e8)")).where("sample_ms is not null")
    at = lambda x: F.max(F.when(F.col("at_ms") == x, F.col("value")))
    return got.groupBy("signal_key").agg((at(5e8) - at(1e6)).alias("delta"))


@query(f"""SELECT signal_key, x_min, x_max, y_min, y_max, y_min - pad AS y_low, y_max + pad AS y_high FROM (
  SELECT *, CASE WHEN y_min = y_max THEN greatest(1.0::DOUBLE, abs(y_min) * 0.05::DOUBLE) ELSE (y_max - y_min) * 0.05::DOUBLE END AS pad FROM (
  SELECT signal_key, min(time_ms) AS x_min, max(time_ms) AS x_max, min(value) AS y_min, max(value) AS y_max FROM (SELECT {SERIES_SQL} FROM carried) GROUP BY signal_key))""")
def series_domain_padded(spark, sf_dir):
    return series.domains(_series(spark, sf_dir), ["signal_key"])


@query(f"""SELECT signal_key, seq, time_ms, value FROM (SELECT *, lead(time_ms) OVER w AS nx, lag(time_ms) OVER w AS pv FROM (SELECT {SERIES_SQL} FROM carried)
  WINDOW w AS (PARTITION BY signal_key ORDER BY time_ms, seq)) WHERE time_ms BETWEEN 1e8 AND 6e8 OR (time_ms < 1e8 AND nx >= 1e8) OR (time_ms > 6e8 AND pv <= 6e8)""")
def time_window_with_neighbours(spark, sf_dir):
    return series.window(_series(spark, sf_dir), 6e8, 1e8).select("signal_key", "seq", "time_ms", "value")


def _lttb_sql(key: str, keep: int) -> str:
    """The line of ``keep`` points of each series: from anchor to anchor, one bucket a step."""
    edge = "least(floor(({0}) * ((n - 2) / {1}::DOUBLE))::BIGINT + 1, n - 1)"
    at = lambda k: edge.format(k, keep - 2)
    mean = lambda c: f"list_reduce(list_prepend(0.0::DOUBLE, list({c} ORDER BY i)), lambda a, b: a + b) / count(*)"
    return f""", s AS (SELECT {key}),
p AS (SELECT *, row_number() OVER (PARTITION BY signal_key ORDER BY time_ms, seq) - 1 AS i, count(*) OVER (PARTITION BY signal_key) AS n FROM s),
b AS (SELECT *, greatest(floor((i - 1) / ((n - 2) / {keep - 2}::DOUBLE))::BIGINT, 0) AS near FROM p WHERE n > {keep}),
c AS (SELECT *, CASE WHEN i = 0 THEN -1 WHEN i = n - 1 THEN {keep - 1} WHEN {at("near")} > i THEN near - 1 WHEN {at("near + 1")} <= i THEN near + 1 ELSE near END AS k FROM b),
d AS (SELECT * FROM c UNION ALL SELECT * REPLACE ({keep - 2} AS k) FROM c WHERE i = n - 1 AND {at(keep - 2)} = n - 1),
m AS (SELECT signal_key, k - 1 AS k, {mean("time_ms")} AS mx, {mean("value")} AS my FROM d WHERE k BETWEEN 1 AND {keep - 2} GROUP BY signal_key, k),
w AS (SELECT signal_key, -1::BIGINT AS k, seq, time_ms, value FROM c WHERE i = 0
  UNION ALL SELECT signal_key, k, seq, time_ms, value FROM (
    SELECT c.signal_key, c.k, c.seq, c.time_ms, c.value, c.i, abs((w.time_ms - mx) * (c.value - w.value) - (w.time_ms - c.time_ms) * (my - w.value)) AS area
    FROM w JOIN c ON c.signal_key = w.signal_key AND c.k = w.k + 1 JOIN m ON m.signal_key = c.signal_key AND m.k = c.k WHERE w.k < {keep - 3})
  QUALIFY row_number() OVER (PARTITION BY signal_key ORDER BY area DESC, i) = 1)
SELECT signal_key, seq, time_ms, value FROM p WHERE n <= {keep} OR i = n - 1 UNION ALL SELECT signal_key, seq, time_ms, value FROM w"""


@query(_lttb_sql(f"{SERIES_SQL} FROM carried", 20))
def lttb_downsample(spark, sf_dir):
    """Many signals of a few samples each."""
    return series.lttb(_series(spark, sf_dir), 20)


@query(_lttb_sql(SERIES_SQL.replace("CAST(can_id AS VARCHAR)", "'all'") + " FROM carried", 60))
def lttb_one_long_signal(spark, sf_dir):
    """All samples as one signal, whose buckets are thinned by many tasks."""
    return series.lttb(_series(spark, sf_dir).withColumn("signal_key", F.lit("all")), 60)


@query("SELECT seq, channel, sum(raw) OVER (PARTITION BY channel ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS clock FROM bus")
def relative_clock_running_sum(spark, sf_dir):
    """Running sums per channel, within ranges of lines and the ranges' offsets, as for files with relative stamps."""
    rows = bus._base(spark, sf_dir).withColumn("part", F.expr("seq div 4096"))
    before = Window.partitionBy("channel").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("channel", "part").agg(F.sum("raw").alias("total")).select("channel", "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("channel", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("upto", F.sum("raw").over(within)).join(parts, ["channel", "part"]).select("seq", "channel", (F.col("offset") + F.col("upto")).alias("clock"))


@query("""SELECT row_number() OVER (ORDER BY (labels = 0)::INT, CASE WHEN labels > 0 THEN '[{"raw":' || labels || ',"label":"x"}]' ELSE unit END, factor, name) AS place, name, unit, factor FROM (
  SELECT DISTINCT 's' || can_id AS name, CASE WHEN can_id % 3 = 0 THEN 'V' WHEN can_id % 3 = 1 THEN 'A' ELSE '' END AS unit, (can_id % 5)::DOUBLE AS factor, can_id % 4 AS labels FROM data)""")
def legend_order_grouped(spark, sf_dir):
    c = F.col("can_id")
    rows = frames.data_frames(bus.frames(spark, sf_dir)).select("can_id").distinct().select(
        F.concat(F.lit("s"), c).alias("signal_name"), F.lit("").alias("message_name"), F.lit("").alias("label"), F.lit("").alias("key"), F.lit(0).alias("selected_at"),
        F.when(c % 3 == 0, "V").when(c % 3 == 1, "A").otherwise("").alias("unit"), (c % 5).cast("double").alias("factor"), F.lit(0.0).alias("offset"),
        F.when(c % 4 > 0, F.array(F.struct((c % 4).cast("bigint").alias("raw_value"), F.lit("x").alias("label")))).otherwise(F.expr("cast(array() as array<struct<raw_value: bigint, label: string>>)")).alias("value_descriptions"),
    )
    placed = catalog.legend_order(rows, "grouped")
    return placed.select(F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long").alias("place"), F.col("signal_name").alias("name"), "unit", "factor")


@query("SELECT seq, time_ms, w * 0.5::DOUBLE + -100.0::DOUBLE AS value FROM carried WHERE can_id = 7 AND channel = 1 AND direction = 'rx' AND timestamp_ns BETWEEN 0 AND 900000000000000")
def decode_from_index(spark, sf_dir):
    """One signal from frames that were written as an index: only files that may hold its message, source and time are opened."""
    index = frame_index.write(bus.frames(spark, sf_dir), recordings.scratch(spark, "bus.index"), 64)
    own = index.of_message(7, False, (1, "rx"), (0, 900_000_000_000_000))
    return decode.samples(own, bus.MESSAGE, bus.VALUE).select("seq", "time_ms", "value")


STEMS = ("Öl", "ol", "Zug", "zug", "a_b", "ét", "Et", "öl", "a-b", "Ab")


@query(f"""SELECT row_number() OVER (ORDER BY name COLLATE en) AS place, name FROM (
  SELECT DISTINCT list_extract({list(STEMS)}, 1 + can_id % {len(STEMS)}) || '.' || (can_id // {len(STEMS)}) AS name FROM data)""")
def legend_order_locale(spark, sf_dir):
    """Names in mixed case, with accents and signs, as people order them."""
    c = F.col("can_id")
    stem = F.get(F.array(*[F.lit(s) for s in STEMS]), c % len(STEMS))
    rows = frames.data_frames(bus.frames(spark, sf_dir)).select("can_id").distinct().select(F.concat(stem, F.lit("."), F.expr(f"can_id div {len(STEMS)}")).alias("signal_name"), *[F.lit("").alias(x) for x in ("message_name", "label", "key")])
    placed = catalog.legend_order(rows, "alphabetical")
    return placed.select(F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long").alias("place"), F.col("signal_name").alias("name"))


@query("""SELECT axis, count(*) AS n_signals, CASE WHEN count(DISTINCT nullif(unit, '')) = 1 THEN max(nullif(unit, '')) END AS unit FROM (
  SELECT DISTINCT can_id, CASE WHEN can_id % 4 < 3 THEN 'y' || (can_id % 4 + 1) ELSE 'y1' END AS axis, CASE WHEN can_id % 4 IN (0, 3) THEN 'V' WHEN can_id % 4 = 1 THEN CASE WHEN can_id % 3 = 0 THEN '' ELSE 'A' END ELSE 'u' || (can_id % 7) END AS unit FROM data) GROUP BY axis""")
def axis_common_unit(spark, sf_dir):
    c = F.col("can_id")
    unit = F.when((c % 4).isin(0, 3), "V").when(c % 4 == 1, F.when(c % 3 == 0, "").otherwise("A")).otherwise(F.concat(F.lit("u"), c % 7))
    rows = frames.data_frames(bus.frames(spark, sf_dir)).select("can_id").distinct().select(F.concat(F.lit("y"), c % 4 + 1).alias("axis"), unit.alias("unit"))
    return catalog.axis_units(rows, ["y1", "y2", "y3"])


HEX_SQL = "CASE WHEN payload_len = 1 THEN printf('%02X', w & 255) ELSE printf('%02X%02X%02X%02X00000000', w & 255, w >> 8, sel, counter) END"


def _read_sql(error_direction: str = "direction", is_fd: str = "kind = 'data' AND is_fd", where: str = "true") -> str:
    return f"""SELECT timestamp_ns, channel, CASE WHEN kind = 'error' THEN {error_direction} ELSE direction END AS direction, kind, CASE WHEN kind <> 'error' THEN can_id END AS can_id,
  CASE WHEN kind <> 'error' THEN false END AS is_extended, {is_fd} AS is_fd, CAST(CASE WHEN kind = 'error' THEN 0 ELSE payload_len END AS INTEGER) AS dlc,
  CASE WHEN kind = 'data' THEN {HEX_SQL} END AS payload_hex FROM bus WHERE {where}"""


def _read(table: DataFrame) -> DataFrame:
    return table.select("timestamp_ns", "channel", "direction", "kind", "can_id", "is_extended", "is_fd", "dlc", F.hex("payload").alias("payload_hex"))


@query(_read_sql("'unknown'"))
def read_asc(spark, sf_dir):
    """ASC recordings of the bus: classic, CAN FD, remote and error frames."""
    return _read(open_trace(spark, recordings.asc(spark, sf_dir)).frames)


@query(_read_sql(is_fd="false", where="kind = 'data'").replace("ELSE direction END", "ELSE 'rx' END"))
def read_asc_relative_decimal(spark, sf_dir):
    """ASC recordings with decimal numbers and stamps that count from the line before."""
    return _read(open_trace(spark, recordings.asc_relative(spark, sf_dir)).frames)


@query("SELECT sum(CASE WHEN kind = 'data' THEN 1 ELSE 0 END)::BIGINT AS valid_message_count, max(CASE WHEN kind = 'data' THEN timestamp_ns END) AS duration_ns, 0::BIGINT AS skipped_line_count, 1777550400000::BIGINT AS measurement_start_ms FROM bus")
def read_asc_metadata(spark, sf_dir):
    meta = open_trace(spark, recordings.asc(spark, sf_dir)).meta
    return meta.agg(F.sum("valid_message_count").alias("valid_message_count"), F.max("duration_ns").alias("duration_ns"), F.sum("skipped_line_count").alias("skipped_line_count"), F.min("measurement_start_ms").alias("measurement_start_ms"))


@query(_read_sql(is_fd="false"))
def read_trc_1(spark, sf_dir):
    """TRC recordings of version 1.1, which knows classic frames only."""
    return _read(open_trace(spark, recordings.trc(spark, sf_dir, False)).frames)


@query(_read_sql())
def read_trc_2(spark, sf_dir):
    """TRC recordings of version 2.1, by their column list."""
    return _read(open_trace(spark, recordings.trc(spark, sf_dir, True)).frames)


@query(f"""SELECT timestamp_ns, channel, CASE WHEN kind = 'error' THEN 'unknown' WHEN direction = 'tx' THEN 'tx' ELSE 'rx' END AS direction, kind, can_id, false AS is_extended, kind = 'data' AND is_fd AS is_fd,
  CAST(payload_len AS INTEGER) AS dlc, CASE WHEN kind <> 'remote' THEN {HEX_SQL} END AS payload_hex FROM bus""")
def read_blf(spark, sf_dir):
    """BLF recordings: objects that run over the borders of compressed containers."""
    return _read(blf.read_files(recordings.blf(spark, sf_dir))[0])


@query(f"""SELECT timestamp_ns, channel, CASE WHEN kind = 'error' THEN 'unknown' WHEN direction = 'tx' THEN 'tx' ELSE 'rx' END AS direction, kind, can_id, kind = 'data' AND is_fd AS is_fd,
  CASE WHEN kind <> 'remote' THEN {HEX_SQL} END AS payload_hex FROM bus""")
def read_blf_newer(spark, sf_dir):
    """BLF recordings with the later kinds of objects for classic and FD frames."""
    return _read(blf.read_files(recordings.blf(spark, sf_dir, True))[0]).drop("is_extended", "dlc")


@query("""SELECT sum((kind = 'data' AND seq % 50 <> 0)::INT)::BIGINT AS valid_message_count, max(CASE WHEN kind = 'data' AND seq % 50 <> 0 THEN timestamp_ns END) AS duration_ns,
  sum((seq % 150 IN (0, 50))::INT)::BIGINT AS skipped_line_count FROM bus""")
def read_asc_malformed(spark, sf_dir):
    """ASC recordings with lines that are skipped (too long, too precise) and remarks that do not count."""
    meta = open_trace(spark, recordings.asc(spark, sf_dir, True)).meta
    return meta.agg(F.sum("valid_message_count").alias("valid_message_count"), F.max("duration_ns").alias("duration_ns"), F.sum("skipped_line_count").alias("skipped_line_count"))


@query("""SELECT what, us - min(us) OVER (PARTITION BY file) AS at_us, value FROM (
  SELECT 'frame' AS what, timestamp_ns // 1000 AS us, seq // 4096 AS file, can_id::DOUBLE AS value FROM data WHERE seq % 2 = 1
  UNION ALL SELECT 'Scaled', timestamp_ns // 1000, seq // 4096, w * 0.5::DOUBLE + -100.0::DOUBLE FROM carried)""")
def read_mf4_unsorted(spark, sf_dir):
    """MF4 recordings with record ids, whose frames and native signals have absolute clocks with one origin."""
    files = recordings.mf4_unsorted(spark, sf_dir)
    bus_rows = mf4.read(spark, files)[0].select(F.lit("frame").alias("what"), F.round(F.col("timestamp_ns") / 1000).cast("long").alias("at_us"), F.col("can_id").cast("double").alias("value"))
    native = mf4.read_channels(spark, files, [0]).select(F.lit("Scaled").alias("what"), F.round(F.col("time_ms") * 1000).cast("long").alias("at_us"), "value")
    return bus_rows.unionByName(native)


@query(f"SELECT timestamp_ns // 1000 AS timestamp_us, channel, can_id, CAST(payload_len AS INTEGER) AS dlc, {HEX_SQL} AS payload_hex FROM data")
def read_mf4_frames(spark, sf_dir):
    """MF4 recordings of bus frames, in transposed and compressed blocks."""
    own = mf4.read(spark, recordings.mf4_frames(spark, sf_dir))[0]
    return own.select(F.round(F.col("timestamp_ns") / 1000).cast("long").alias("timestamp_us"), "channel", "can_id", "dlc", F.hex("payload").alias("payload_hex"))


@query("""SELECT s AS name, unit, timestamp_ns::DOUBLE / 1e9::DOUBLE * 1000.0::DOUBLE AS time_ms,
  CASE s WHEN 'Scaled' THEN w * 0.5::DOUBLE + -100.0::DOUBLE WHEN 'Signed' THEN (CASE WHEN w >= 32768 THEN w - 65536 ELSE w END)::DOUBLE ELSE timestamp_ns::DOUBLE / 1e6::DOUBLE END AS value
  FROM carried, (VALUES ('Scaled', 'km/h'), ('Signed', ''), ('Elapsed', 'ms')) v(s, unit)""")
def read_mf4_native(spark, sf_dir):
    """Native signals of MF4 recordings: unsigned with a scale, signed, and floating."""
    files = recordings.mf4_native(spark, sf_dir)
    return mf4.read_channels(spark, files, [0, 1, 2]).join(mf4.read_catalog(spark, files), ["trace_id", "id"]).select("name", "unit", "time_ms", "value")


@query("""SELECT can_id, can_id % 5 = 0 AS is_extended, 'M' || can_id AS message_name, s AS signal_name,
  CAST(CASE s WHEN 'A' THEN can_id % 40 WHEN 'B' THEN 7 + 8 * (can_id % 4) WHEN 'F' THEN 32 WHEN 'Page' THEN 0 ELSE 8 END AS INTEGER) AS start_bit,
  CAST(CASE s WHEN 'A' THEN 1 + can_id % 16 WHEN 'B' THEN 16 WHEN 'F' THEN 32 WHEN 'Page' THEN 4 ELSE 8 END AS INTEGER) AS bit_length,
  CASE s WHEN 'B' THEN 'motorola' ELSE 'intel' END AS endianness, CASE WHEN s IN ('B', 'F') THEN 'signed' ELSE 'unsigned' END AS signedness,
  (CASE s WHEN 'A' THEN 0.5 WHEN 'B' THEN 0.25 WHEN 'Paged' THEN 2 ELSE 1 END)::DOUBLE AS factor, (CASE s WHEN 'A' THEN can_id WHEN 'B' THEN -3 ELSE 0 END)::DOUBLE AS "offset",
  (CASE s WHEN 'B' THEN -5 ELSE 0 END)::DOUBLE AS minimum, (CASE s WHEN 'A' THEN can_id * 2 WHEN 'B' THEN 5 ELSE 0 END)::DOUBLE AS maximum,
  CASE WHEN s = 'B' THEN 'A' WHEN s = 'A' AND can_id % 2 = 0 THEN 'V' ELSE '' END AS unit, CASE s WHEN 'F' THEN 'float32' ELSE 'integer' END AS value_type,
  CASE s WHEN 'Paged' THEN 'Page' END AS selector, CASE s WHEN 'Paged' THEN '[[' || can_id % 16 || ',' || can_id % 16 || ']]' END AS ranges,
  CASE WHEN s = 'A' AND can_id % 3 = 0 THEN '[[0,"off"],[' || can_id + 1 || ',"top"]]' ELSE '[]' END AS labels
  FROM (SELECT DISTINCT can_id FROM data), (VALUES ('A'), ('B'), ('F'), ('Page'), ('Paged')) v(s)""")
def read_dbc_signals(spark, sf_dir):
    """Databases that describe the bus: layouts in both byte orders, float types, selectors, value tables."""
    return dbc.read_signals(recordings.databases(spark, sf_dir)).drop("path", "size_bytes")


def database() -> Database:
    return Database((bus.MESSAGE,))
