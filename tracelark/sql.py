"""Traces asked from SQL: functions over payloads and table functions over frames and layouts, registered in a session.

    register(spark, frames, layouts.rows(spark, all_signals(database)))
    spark.sql("SELECT time_ms, value FROM signal_samples('Engine.Speed') WHERE channel = 1")

They are SQL functions, which Spark writes out into the query that calls them, so filters reach the frames' scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Names of the views that the table functions read.
FRAMES, SIGNALS = "tracelark_frames", "tracelark_signals"

_BYTE = "CAST(conv(hex(substring(payload, {0} + 1, 1)), 16, 10) AS BIGINT)"


def _or_bytes(first: str, n: str, up: bool) -> str:
    """Up to eight bytes from ``first`` on, the first one lowest (or highest)."""
    shift = "8 * j" if up else f"8 * ({n} - 1 - j)"
    return f"aggregate(sequence(0, {n} - 1), 0L, (word, j) -> word | shiftleft({_BYTE.format(f'({first} + j)')}, {shift}))"


def _masked(word: str, bits: str) -> str:
    return f"CASE WHEN {bits} >= 64 THEN {word} ELSE {word} & ~shiftleft(-1L, {bits}) END"


def _intel(start: str = "start", bits: str = "bits") -> str:
    low = f"shiftrightunsigned({_or_bytes(f'({start} div 8)', f'least(8, ({start} % 8 + {bits} + 7) div 8)', True)}, {start} % 8)"
    ninth = f"shiftleft({_BYTE.format(f'({start} div 8 + 8)')}, 64 - {start} % 8)"
    return _masked(f"(CASE WHEN {start} % 8 + {bits} > 64 THEN {low} | {ninth} ELSE {low} END)", bits)


def _motorola(start: str = "start", bits: str = "bits") -> str:
    msb = f"({start} div 8 * 8 + 7 - {start} % 8)"
    first, last = f"({msb} div 8)", f"(({msb} + {bits} - 1) div 8)"
    shift, nine = f"(7 - ({msb} + {bits} - 1) % 8)", f"{last} - {first} = 8"
    low = _or_bytes(f"(CASE WHEN {nine} THEN {first} + 1 ELSE {first} END)", f"least(8, {last} - {first} + 1)", False)
    whole = f"shiftrightunsigned({low}, {shift})"
    ninth = f"shiftleft({_BYTE.format(first)}, 64 - {shift})"
    return _masked(f"(CASE WHEN {nine} AND {shift} > 0 THEN {whole} | {ninth} ELSE {whole} END)", bits)


def _float(bits: int) -> str:
    man, bias, top = (23, 127, 255) if bits == 32 else (52, 1023, 2047)
    exponent, mantissa = f"(shiftrightunsigned(raw, {man}) & {top}L)", f"(raw & {(1 << man) - 1}L)"
    return (
        f"(CASE WHEN (shiftrightunsigned(raw, {bits - 1}) & 1L) = 1 THEN -1D ELSE 1D END) * (CASE WHEN {exponent} = {top} THEN (CASE WHEN {mantissa} = 0 THEN double('Infinity') ELSE double('NaN') END) "
        f"WHEN {exponent} = 0 THEN double({mantissa}) * pow(2D, {1 - bias - man}D) ELSE double({mantissa} + {1 << man}L) * pow(2D, double({exponent} - {bias + man})) END)"
    )


FUNCTIONS = {
    "signal_raw_intel(payload BINARY, start INT, bits INT) RETURNS BIGINT": _intel(),
    "signal_raw_motorola(payload BINARY, start INT, bits INT) RETURNS BIGINT": _motorola(),
    "signal_raw(payload BINARY, start INT, bits INT, little_endian BOOLEAN) RETURNS BIGINT": "CASE WHEN little_endian THEN signal_raw_intel(payload, start, bits) ELSE signal_raw_motorola(payload, start, bits) END",
    "signal_number(raw BIGINT, bits INT, signed BOOLEAN, value_type STRING) RETURNS DOUBLE": f"""CASE value_type WHEN 'float32' THEN {_float(32)} WHEN 'float64' THEN {_float(64)}
        ELSE CASE WHEN signed THEN double(CASE WHEN bits >= 64 THEN raw ELSE shiftright(shiftleft(raw, 64 - bits), 64 - bits) END)
          WHEN raw < 0 THEN 2D * double(shiftrightunsigned(raw, 1) | (raw & 1L)) ELSE double(raw) END END""",
    "signal_label(value DOUBLE, factor DOUBLE, `offset` DOUBLE, labels ARRAY<STRUCT<raw_value: BIGINT, label: STRING>>) RETURNS STRING": """CASE
        WHEN factor <> 0 AND abs((value - `offset`) / nullif(factor, 0D) - floor((value - `offset`) / nullif(factor, 0D) + 0.5D)) < 1e-6D
        THEN get(filter(labels, x -> x.raw_value = floor((value - `offset`) / nullif(factor, 0D) + 0.5D)), 0).label END""",
    "frame_carries(frame_fd BOOLEAN, payload_len INT, size_bytes INT, message_fd BOOLEAN, frame_format STRING) RETURNS BOOLEAN": """(frame_format IS NULL OR frame_fd = (frame_format = 'fd'))
        AND CASE WHEN frame_fd THEN payload_len = size_bytes ELSE payload_len >= size_bytes AND (message_fd OR payload_len <= 8) END""",
    "signal_active(payload BINARY, chain ARRAY<STRUCT<start_bit: INT, bit_length: INT, little_endian: BOOLEAN, ranges: ARRAY<STRUCT<first: BIGINT, last: BIGINT>>>>) RETURNS BOOLEAN": """
forall(chain, c -> exists(c.ranges, r -> ((CASE WHEN c.little_endian THEN """
    + f"{_intel('c.start_bit', 'c.bit_length')} ELSE {_motorola('c.start_bit', 'c.bit_length')} END) ^ (-9223372036854775807L - 1L)) BETWEEN r.first AND r.last))",  # a lambda can't call SQL functions
}
_SAMPLES = f"""SELECT s.key, f.channel, f.direction, f.seq, f.timestamp_ns, f.timestamp_ns / 1000000D AS time_ms,
    signal_number(signal_raw(f.payload, s.start_bit, s.bit_length, s.little_endian), s.bit_length, s.signed, s.value_type) * s.factor + s.`offset` AS value
  FROM {SIGNALS} s JOIN {FRAMES} f ON f.can_id = s.can_id AND f.is_extended = s.is_extended
  WHERE f.kind = 'data' AND frame_carries(f.is_fd, f.payload_len, s.size_bytes, s.is_fd, s.frame_format) AND signal_active(f.payload, s.chain)"""
TABLES = {
    "signal_samples(wanted STRING) RETURNS TABLE (channel INT, direction STRING, seq BIGINT, time_ms DOUBLE, value DOUBLE)": f"SELECT channel, direction, seq, time_ms, value FROM ({_SAMPLES}) WHERE key = wanted",
    "signal_labels(wanted STRING) RETURNS TABLE (channel INT, direction STRING, seq BIGINT, time_ms DOUBLE, value DOUBLE, label STRING)": f"""SELECT x.channel, x.direction, x.seq, x.time_ms, x.value, signal_label(x.value, t.factor, t.`offset`, t.labels)
        FROM ({_SAMPLES}) x JOIN {SIGNALS} t ON t.key = x.key WHERE x.key = wanted""",
    "signal_nearest(wanted STRING, at_ms DOUBLE) RETURNS TABLE (sample_ms DOUBLE, value DOUBLE)": f"""SELECT r.time_ms, r.value FROM (SELECT min_by(struct(time_ms, value), struct(abs(time_ms - at), time_ms, seq)) AS r
        FROM (SELECT time_ms, value, seq, at_ms AS at FROM ({_SAMPLES}) WHERE key = wanted)) WHERE r IS NOT NULL""",
}


def register(spark: SparkSession, frames: DataFrame, signals: DataFrame) -> None:
    """Makes the functions and their views known to the session; ``signals`` are rows of ``plans.layouts``."""
    frames.createOrReplaceTempView(FRAMES)
    signals.createOrReplaceTempView(SIGNALS)
    for head, body in (FUNCTIONS | TABLES).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
