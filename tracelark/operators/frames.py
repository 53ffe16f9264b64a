"""Frames as a fact table: filters, sources, buckets and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import PlanError

DIRECTIONS = ("unknown", "rx", "tx")


def direction_order(direction: Column) -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in DIRECTIONS]), direction)


def data_frames(frames: DataFrame) -> DataFrame:
    """Only data frames with an identifier can be decoded."""
    return frames.where((F.col("kind") == "data") & F.col("can_id").isNotNull())


def raw_messages(frames: DataFrame) -> DataFrame:
    """The distinct identities and sources of the traffic: identifier, then channel (none first), then direction."""
    own = data_frames(frames).select("can_id", "is_extended", "channel", "direction").distinct()
    return own.orderBy("can_id", "is_extended", F.col("channel").asc_nulls_first(), direction_order(F.col("direction")))


def metadata(frames: DataFrame) -> DataFrame:
    """One row: data frames, and the time of the last of them."""
    data = (F.col("kind") == "data") & F.col("can_id").isNotNull()
    return frames.agg(F.count(F.when(data, 1)).alias("valid_message_count"), F.max(F.when(data, F.col("timestamp_ns"))).alias("duration_ns"))


def buckets(frames: DataFrame) -> DataFrame:
    """Frames of one identity and source: how many, since when, and whether all have one length and format."""
    own = data_frames(frames).groupBy("can_id", "is_extended", "channel", "direction")
    out = own.agg(
        F.count("*").alias("n_frames"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"), F.min("payload_len").alias("least"), F.max("payload_len").alias("most"),
        F.min(F.col("is_fd").cast("int")).alias("a"), F.max(F.col("is_fd").cast("int")).alias("b"),
    )
    return out.select("can_id", "is_extended", "channel", "direction", "n_frames", "first_ns", "last_ns", ((F.col("least") == F.col("most")) & (F.col("a") == F.col("b"))).alias("is_uniform"))


def of_message(frames: DataFrame, can_id: int, is_extended: bool) -> DataFrame:
    """The data frames of one identity; equality filters that reach a Parquet scan."""
    return data_frames(frames).where((F.col("can_id") == can_id) & (F.col("is_extended") == is_extended))


def of_source(frames: DataFrame, source: tuple[int | None, str] | None, guard: bool = True) -> DataFrame:
    """The frames of a source (channel, direction). Without one the traffic must come from a single source."""
    if source is not None:
        channel, direction = source
        return frames.where(F.col("channel").eqNullSafe(F.lit(channel)) & (F.col("direction") == direction))
    if guard and len(frames.select("channel", "direction").distinct().limit(2).collect()) > 1:
        raise PlanError("Multiple raw sources match this message; select a channel and direction")
    return frames


def bounds_ms(frames: DataFrame) -> DataFrame:
    """The least time of any frame, of whatever kind."""
    return frames.agg(F.min("timestamp_ns").alias("first_ns"))
