"""Recordings and databases written from the derived bus in every format, for the readers to read back.

Text recordings are written by Spark, a file for each range of frames; binary ones are built by range and handed to the readers as a
table of files. Both grow with the bus.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import virtual_bus as bus
from .operators.frames import data_frames
from .sources import writers

#: Frames of one file.
FILE = 4096


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; where all runs in one process, any folder is shared."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-recordings-")
    return f"{root}/{uuid.uuid4().hex}-{name}"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bus.frames(spark, sf_dir).withColumn("file", F.expr(f"seq div {FILE}"))


def _tokens(decimal: bool = False) -> Column:
    """The payload as tokens of two digits, or as decimal numbers."""
    pairs = F.regexp_extract_all(F.hex("payload"), F.lit("(..)"))
    return F.array_join(F.transform(pairs, lambda x: F.conv(x, 16, 10)) if decimal else pairs, " ")


def _decimal(ns: Column, places: int) -> Column:
    """A decimal text of nanoseconds in a unit with so many places."""
    rest = ns % 10**places
    return F.concat(((ns - rest) / 10**places).cast("bigint").cast("string"), F.lit("."), F.lpad(rest.cast("string"), places, "0"))


def _written(rows: DataFrame, header: list[str], path: str) -> str:
    """Writes the lines (file, seq, line), each file with its header in front.

    The header goes with the file's first line, not as lines of its own: a union of two tables that both lie by file already is not dealt
    out anew, and its halves then end up in different parts.
    """
    first = F.row_number().over(Window.partitionBy("file").orderBy("seq")) == 1
    own = rows.select("file", F.when(first, F.concat_ws("\n", *[F.lit(h) for h in header], "line")).otherwise(F.col("line")).alias("line"))
    own.select("line", "file").write.partitionBy("file").text(path)
    return path


def asc(spark: SparkSession, sf_dir: str, broken: bool = False) -> str:
    """Hexadecimal, with absolute stamps. If ``broken``, every fiftieth line is one that is skipped, or a remark."""
    way = F.when(F.col("direction") == "unknown", "-").otherwise(F.initcap("direction"))
    ident, n = F.lower(F.hex("can_id")), F.col("payload_len")
    line = (
        F.when(F.col("kind") == "error", F.concat_ws(" ", "stamp", "channel", F.lit("ErrorFrame")))
        .when(F.col("kind") == "remote", F.concat_ws(" ", "stamp", "channel", ident, way, F.lit("r"), n))
        .when(F.col("is_fd"), F.concat_ws(" ", "stamp", F.lit("CANFD"), "channel", way, ident, F.lit("1 0"), "dlc", n, _tokens()))
        .otherwise(F.concat_ws(" ", "stamp", "channel", ident, way, F.lit("d"), "dlc", _tokens()))
    )
    if broken:
        bad = F.when(F.col("seq") % 150 == 0, "1.5 1 100 Rx d 9 00 01 02 03 04 05 06 07 08").when(F.col("seq") % 150 == 50, "0.1234567891 1 100 Rx d 1 00").otherwise("// a remark")
        line = F.when(F.col("seq") % 50 == 0, bad).otherwise(line)
    rows = _frames(spark, sf_dir).withColumn("stamp", _decimal(F.col("timestamp_ns"), 9)).select("file", "seq", line.alias("line"))
    return _written(rows, ["date Thu Apr 30 12:00:00.000 2026", "base hex timestamps absolute"], scratch(spark, "bus.asc"))


def asc_relative(spark: SparkSession, sf_dir: str) -> str:
    """Data frames in decimal, in order of time, each with the time since the frame before it in the file."""
    own = data_frames(_frames(spark, sf_dir))
    order = Window.partitionBy("file").orderBy("timestamp_ns", "seq")
    step = F.col("timestamp_ns") - F.coalesce(F.lag("timestamp_ns").over(order), F.lit(0))
    line = F.concat_ws(" ", _decimal(step, 9), "channel", "can_id", F.lit("Rx d"), "dlc", _tokens(True))
    return _written(own.select("file", F.row_number().over(order).cast("long").alias("seq"), line.alias("line")), ["base dec timestamps relative"], scratch(spark, "bus.asc"))


def trc(spark: SparkSession, sf_dir: str, two: bool) -> str:
    """Version 1.1 or 2.1."""
    way = F.when(F.col("direction") == "unknown", "-").otherwise(F.initcap("direction"))
    ident, data, error = F.lpad(F.hex("can_id"), 4, "0"), F.col("kind") == "data", F.col("kind") == "error"
    if two:
        kind = F.when(error, "ER").when(~data, "RR").when(F.col("is_fd"), "FD").otherwise("DT")
        line = F.concat_ws(" ", "seq", "stamp", kind, "channel", F.when(error, "-").otherwise(ident), way, F.lit("-"), F.when(error, 0).otherwise(F.col("dlc")), F.when(data, _tokens()))
        header = [";$FILEVERSION=2.1", ";$COLUMNS=N,O,T,B,I,d,R,L,D"]
    else:
        rest = F.when(error, "4 00 00 00 00").when(data, F.concat_ws(" ", "dlc", _tokens())).otherwise(F.concat_ws(" ", "dlc", F.lit("RTR")))
        line = F.concat_ws(" ", F.concat(F.col("seq"), F.lit(")")), "stamp", "channel", way, F.when(error, "FFFFFFFF").otherwise(ident), F.lit("-"), rest)
        header = [";$FILEVERSION=1.1"]
    rows = _frames(spark, sf_dir).withColumn("stamp", _decimal(F.col("timestamp_ns"), 6)).select("file", "seq", line.alias("line"))
    return _written(rows, header, scratch(spark, "bus.trc"))


def _files(rows: DataFrame, end: str, make: Callable[[list], bytes]) -> DataFrame:
    """path, content of the file that ``make`` builds from each range of frames."""

    def build(own):
        import pandas as pd

        own = own.sort_values("seq")
        return pd.DataFrame({"path": [f"{own['file'].iloc[0]}.{end}"], "content": [make(list(own.itertuples(index=False)))]})

    return rows.groupBy("file").applyInPandas(build, "path string, content binary")


def blf(spark: SparkSession, sf_dir: str, newer: bool = False) -> DataFrame:
    """``newer`` takes the later kinds of objects for classic and FD frames."""

    def make(own: list) -> bytes:
        objects = []
        for r in own:
            data, tx = bytes(r.payload), int(r.direction == "tx")
            if r.kind == "error":
                kind, body = 73, writers.error_frame(r.channel, r.can_id, data)
            elif r.kind == "data" and r.is_fd and newer:
                kind, body = 101, writers.can_fd_64(r.channel, r.can_id, data, tx)
            elif r.kind == "data" and r.is_fd:
                kind, body = 100, writers.can_fd(r.channel, r.can_id, data, flags=tx, dlc=r.dlc)
            else:
                kind, body = 86 if newer else 1, writers.can_message(r.channel, r.can_id, data, tx | (0x80 if r.kind == "remote" else 0))
            objects.append(writers.blf_object(kind, r.timestamp_ns, body))
        return writers.blf(objects, 10_000)

    return _files(_frames(spark, sf_dir), "blf", make)


def mf4_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data frames as records of a group of bus frames, in a compressed and transposed block."""

    def make(own: list) -> bytes:
        m, at = writers.Mf4(), 0
        for name, byte, bits, more in (("DataBytes", 16, 64, {"data_type": 10}), ("BusChannel", 15, 8, {}), ("DataLength", 14, 8, {}), ("DLC", 13, 8, {}), ("IDE", 12, 1, {}), ("ID", 8, 29, {})):
            at = m.channel(f"CAN_DataFrame.{name}", byte, bits, after=at, **more)
        at = m.channel("CAN_DataFrame", 8, 128, data_type=10, part=at)
        at = m.channel("Timestamp", 0, 64, kind=2, sync=1, conversion=(1, 0.0, 1e-6), after=at)
        records = b"".join(struct.pack("<QIBBBB", r.timestamp_ns // 1000, r.can_id, 0, r.dlc, r.payload_len, r.channel) + bytes(r.payload).ljust(8, b"\0") for r in own)
        return m.finish(m.data_group(m.group(at, 24, len(own), flags=2), m.packed(records, 24)))

    return _files(data_frames(_frames(spark, sf_dir)), "mf4", make)


def mf4_unsorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames (of odd numbers) and native samples (of whole frames) as records with ids in one stream, cut into blocks; both clocks are absolute."""

    def make(own: list) -> bytes:
        m, at = writers.Mf4(), 0
        clock = {"kind": 2, "sync": 1, "conversion": (1, 2e8, 1e-6)}
        for name, byte, bits, more in (("DataBytes", 14, 64, {"data_type": 10}), ("DataLength", 13, 8, {}), ("DLC", 12, 8, {}), ("ID", 8, 29, {})):
            at = m.channel(f"CAN_DataFrame.{name}", byte, bits, after=at, **more)
        at = m.channel("Timestamp", 0, 64, after=m.channel("CAN_DataFrame", 8, 112, data_type=10, part=at), **clock)
        odd, whole = [r for r in own if r.seq % 2], [r for r in own if r.payload_len == 8]
        bus_group = m.group(at, 22, len(odd), flags=2, record_id=9)
        native = m.group(m.channel("t", 0, 64, after=m.channel("Scaled", 8, 16, conversion=(1, -100.0, 0.5)), **clock), 10, len(whole), "Bus", record_id=7, after=bus_group)
        stream = b""
        for r in own:
            us = r.timestamp_ns // 1000
            stream += b"\x09" + struct.pack("<QIBB", us, r.can_id, r.dlc, r.payload_len) + bytes(r.payload).ljust(8, b"\0") if r.seq % 2 else b""
            stream += b"\x07" + struct.pack("<Q", us) + bytes(r.payload[:2]) if r.payload_len == 8 else b""
        return m.finish(m.data_group(native, m.listed([m.data(stream[k : k + 5000]) if k % 2 else m.packed(stream[k : k + 5000]) for k in range(0, len(stream), 5000)]), 1))

    return _files(data_frames(_frames(spark, sf_dir)), "mf4", make)


def mf4_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole frames' first 16 bits as a scaled and as a signed channel, and the time in milliseconds as a float, by seconds."""

    def make(own: list) -> bytes:
        m = writers.Mf4()
        at = m.channel("Scaled", 8, 16, conversion=(1, -100.0, 0.5), unit="km/h")
        at = m.channel("Signed", 8, 16, data_type=2, after=at)
        at = m.channel("Elapsed", 10, 64, data_type=4, unit="ms", after=at)
        at = m.channel("t", 0, 64, kind=2, sync=1, data_type=4, after=at)
        records = b"".join(struct.pack("<d2sd", r.timestamp_ns / 1e9, bytes(r.payload[:2]), r.timestamp_ns / 1e6) for r in own)
        return m.finish(m.data_group(m.group(at, 18, len(own), "Bus"), m.data(records)))

    return _files(data_frames(_frames(spark, sf_dir)).where("payload_len = 8"), "mf4", make)


def databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content of 16 databases that describe the bus: a message for each identifier, every fifth one extended."""
    c = F.col("can_id")
    own = data_frames(bus.frames(spark, sf_dir)).select("can_id").distinct()
    ident = (c + F.when(c % 5 == 0, F.lit(1 << 31)).otherwise(F.lit(0))).cast("string")
    text = F.concat(
        F.format_string("BO_ %s M%d: 8 E\n", ident, c), F.format_string(' SG_ A : %d|%d@1+ (0.5,%d) [0|%d] "%s" X\n', c % 40, 1 + c % 16, c, c * 2, F.when(c % 2 == 0, "V").otherwise("")),
        F.format_string(' SG_ B : %d|16@0- (0.25,-3) [-5|5] "A" X,Y\n', 7 + 8 * (c % 4)), F.lit(' SG_ F : 32|32@1- (1,0) [0|0] "" X\n SG_ Page M : 0|4@1+ (1,0) [0|0] "" X\n'),
        F.format_string(' SG_ Paged m%d : 8|8@1+ (2,0) [0|0] "" X\n', c % 16),
    )
    rest = F.concat(F.format_string("SIG_VALTYPE_ %s F : 1;\n", ident), F.when(c % 3 == 0, F.format_string('VAL_ %s A 0 "off" %d "top" ;\n', ident, c + 1)).otherwise(""))
    body = lambda x: F.array_join(F.array_sort(F.collect_list(x)), "")
    files = own.groupBy((c % 16).alias("file")).agg(F.encode(F.concat(body(text), body(rest)), "UTF-8").alias("content"))
    return files.select(F.concat(F.col("file").cast("string"), F.lit(".dbc")).alias("path"), "content")
