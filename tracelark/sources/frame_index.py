"""Frames kept as an index: Parquet clustered by identity, source and time, and a table of what each file holds.

A question for one message or source opens the files whose ranges meet it, and no others; within them Parquet's own ranges leave out row
groups. Identities with many frames reach over several files, so the time ranges of the files help as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text_lines import FRAME_COLUMNS, FRAME_SCHEMA

#: What frames are clustered by.
CLUSTER = ("can_id", "is_extended", "channel", "direction", "timestamp_ns", "seq")


def write(frames: DataFrame, path: str, files: int | None = None) -> FrameIndex:
    """Writes the index of ``frames`` to a new folder, in so many files or as many as the session's shuffles have partitions."""
    dealt = frames.select(*FRAME_COLUMNS)
    dealt = dealt.repartitionByRange(files, *CLUSTER) if files else dealt.repartitionByRange(*CLUSTER)
    dealt.sortWithinPartitions(*CLUSTER).write.parquet(f"{path}/frames")
    own = frames.sparkSession.read.schema(FRAME_SCHEMA).parquet(f"{path}/frames")
    known = F.col("can_id").isNotNull()
    ranges = [f(F.col(c)).alias(f"{n}_{c}") for c in ("can_id", "timestamp_ns") for f, n in ((F.min, "least"), (F.max, "most"))]
    sources = F.collect_set(F.struct(F.col("channel"), F.col("direction")))
    stats = own.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.bool_or(known & (F.col("kind") == "data")).alias("has_data"), F.first("_metadata.file_size").alias("bytes"), sources.alias("sources"), *ranges)
    stats.write.parquet(f"{path}/files")
    return FrameIndex(frames.sparkSession, path)


@dataclass
class FrameIndex:
    """An index that was written; ``frames`` are all frames of it."""

    spark: SparkSession
    path: str

    @property
    def frames(self) -> DataFrame:
        return self.spark.read.schema(FRAME_SCHEMA).parquet(f"{self.path}/frames")

    @property
    def files(self) -> DataFrame:
        """file, n, bytes, has_data, sources, least_ and most_ of can_id and timestamp_ns."""
        return self.spark.read.parquet(f"{self.path}/files")

    def files_of(self, can_id: int, source: tuple[int | None, str] | None = None, window_ns: tuple[int, int] | None = None) -> DataFrame:
        """The files that may hold data frames of an identifier, source and time."""
        own = self.files.where(F.col("has_data") & F.lit(can_id).between(F.col("least_can_id"), F.col("most_can_id")))
        if source is not None:
            own = own.where(F.exists("sources", lambda s: s["channel"].eqNullSafe(F.lit(source[0])) & (s["direction"] == source[1])))
        if window_ns is not None:
            own = own.where((F.col("most_timestamp_ns") >= window_ns[0]) & (F.col("least_timestamp_ns") <= window_ns[1]))
        return own

    def of_message(self, can_id: int, is_extended: bool, source: tuple[int | None, str] | None = None, window_ns: tuple[int, int] | None = None) -> DataFrame:
        """The data frames of one identity, from the files that may hold some: of one identifier these are few, so their names go to the driver."""
        names = [r["file"] for r in self.files_of(can_id, source, window_ns).select("file").toLocalIterator()]
        own = self.spark.read.schema(FRAME_SCHEMA).parquet(*names) if names else self.frames.limit(0)
        fits: Column = (F.col("kind") == "data") & (F.col("can_id") == can_id) & (F.col("is_extended") == is_extended)
        if source is not None:
            fits = fits & F.col("channel").eqNullSafe(F.lit(source[0])) & (F.col("direction") == source[1])
        if window_ns is not None:
            fits = fits & F.col("timestamp_ns").between(*window_ns)
        return own.where(fits)
