"""A bus derived from the ``events`` table, so that the operators run over real binary payloads of any number of rows.

Every event is a frame: its user is the identifier, its value the payload. The same frames, as closed forms over the
columns, are ``BUS_SQL``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.model import Message, Multiplex, Signal


def _bytes(*values: Column) -> Column:
    """A binary of byte values."""
    return F.unhex(F.concat(*[F.lpad(F.hex(v.cast("bigint")), 2, "0") for v in values]))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first = e.agg(F.min(us).alias("first_us"))  # one row
    raw = F.round(F.col("value") * 100).cast("bigint")
    return e.crossJoin(F.broadcast(first)).select(
        F.lit("bus").alias("trace_id"), F.col("event_id").alias("seq"), ((us - F.col("first_us")) * 1000).alias("timestamp_ns"),
        (1 + F.col("event_id") % 2).cast("int").alias("channel"),
        F.when(F.col("event_type").isin("click", "view"), "rx").when(F.col("event_type").isin("purchase", "signup"), "tx").otherwise("unknown").alias("direction"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_id") % 29 == 0, "remote").otherwise("data").alias("kind"),
        (F.col("user_id") % 2048).cast("int").alias("can_id"), F.lit(False).alias("is_extended"), (F.col("event_id") % 11 == 0).alias("is_fd"),
        raw.alias("raw"), F.col("event_id").alias("event_id"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-bit value (low byte first), selector, counter and four zero bytes; every 17th frame is one byte long."""
    b = _base(spark, sf_dir).withColumn("w", (F.col("raw") * 37 + F.col("event_id")).bitwiseAND(F.lit(65535).cast("bigint")))
    low, high = F.col("w").bitwiseAND(F.lit(255).cast("bigint")), F.shiftright("w", 8)
    zero = F.lit(0)
    whole = _bytes(low, high, F.col("event_id") % 4, F.col("event_id").bitwiseAND(F.lit(255).cast("bigint")), zero, zero, zero, zero)
    short = F.col("event_id") % 17 == 0
    payload = F.when(short, F.substring(whole, 1, 1)).otherwise(whole)
    n = F.when(short, 1).otherwise(8)
    return b.select("trace_id", "seq", "timestamp_ns", "channel", "direction", "kind", "can_id", "is_extended", "is_fd", n.alias("dlc"), n.alias("payload_len"), payload.alias("payload"))


def float_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 12 bytes on CAN FD: a float64 pattern and a float32 pattern, both low byte first."""
    b = _base(spark, sf_dir)
    sign = F.col("event_id") % 2
    man = (F.col("raw") * 12345 + F.col("event_id")).bitwiseAND(F.lit((1 << 52) - 1))
    wide = F.shiftleft(sign, 63).bitwiseOR(F.shiftleft((1000 + F.col("event_id") % 50).cast("bigint"), 52)).bitwiseOR(man)
    part = (F.col("raw") * 771 + F.col("event_id")).bitwiseAND(F.lit((1 << 23) - 1).cast("bigint"))
    narrow = F.shiftleft(sign, 31).bitwiseOR(F.shiftleft((120 + F.col("event_id") % 16).cast("bigint"), 23)).bitwiseOR(part)
    cut = lambda x, j: F.shiftrightunsigned(x, 8 * j).bitwiseAND(F.lit(255).cast("bigint"))
    payload = _bytes(*[cut(wide, j) for j in range(8)], *[cut(narrow, j) for j in range(4)])
    return b.select("trace_id", "seq", "timestamp_ns", "channel", "direction", "kind", "can_id", "is_extended", F.lit(True).alias("is_fd"), F.lit(9).alias("dlc"), F.lit(12).alias("payload_len"), payload.alias("payload"))


VALUE = Signal("Value", 0, 16, True, False, 0.5, -100.0, 0.0, 20000.0, "km/h")
SIGNED = Signal("Signed", 0, 16, True, True, 0.25, 10.0, -5000.0, 5000.0, "A")
SIGNED_BE = Signal("SignedBe", 7, 16, False, True, 0.1, -3.0, 0.0, 0.0, "V")
NIBBLES = Signal("Nibbles", 4, 12, True, False, 2.0, 1.0, 0.0, 9000.0, "rpm")
ROOT = Signal("Root", 16, 2, True, False, 10.0, 7.0, is_multiplexer=True)
CHILD = Signal("Child", 16, 8, True, False, 2.0, 100.0, is_multiplexer=True, multiplex=Multiplex("Root", ((1, 3),)))
SIMPLE = Signal("Simple", 24, 8, True, False, 1.0, 0.0, multiplex=Multiplex("Root", ((2, 2),)))
NESTED = Signal("Nested", 8, 16, False, True, 0.5, -10.0, multiplex=Multiplex("Child", ((1, 1), (3, 9))))
MODE = Signal("Mode", 16, 8, True, False, value_descriptions=((0, "off"), (1, "idle"), (1, "late"), (3, "run")))
MESSAGE = Message(0, 0, False, "Bus", 8, (VALUE, SIGNED, SIGNED_BE, NIBBLES, ROOT, CHILD, SIMPLE, NESTED, MODE))
F64 = Signal("F64", 0, 64, True, False, 1.0, 0.0, value_type="float64")
F32 = Signal("F32", 64, 32, True, False, 1.0, 0.0, value_type="float32")
FLOATS = Message(1, 1, False, "Floats", 12, (F64, F32), is_fd=True)

BUS_SQL = """WITH RECURSIVE base AS (
  SELECT event_id AS seq, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * 1000 AS timestamp_ns, CAST(1 + event_id % 2 AS INTEGER) AS channel,
    CASE WHEN event_type IN ('click', 'view') THEN 'rx' WHEN event_type IN ('purchase', 'signup') THEN 'tx' ELSE 'unknown' END AS direction,
    CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 29 = 0 THEN 'remote' ELSE 'data' END AS kind,
    CAST(user_id % 2048 AS INTEGER) AS can_id, event_id % 11 = 0 AS is_fd, CASE WHEN event_id % 17 = 0 THEN 1 ELSE 8 END AS payload_len,
    CAST(round(value * 100) AS BIGINT) AS raw, event_id, event_id % 4 AS sel, event_id & 255 AS counter
  FROM events),
bus AS (SELECT *, (raw * 37 + event_id) & 65535 AS w, (((raw * 37 + event_id) & 255) << 8) | (((raw * 37 + event_id) & 65535) >> 8) AS wb, timestamp_ns / 1000000.0 AS time_ms FROM base),
data AS (SELECT * FROM bus WHERE kind = 'data'),
carried AS (SELECT * FROM data WHERE payload_len = 8)
"""
