"""Opening recordings and databases by their file type, and a library of saved databases."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import Database
from . import asc, blf, dbc, mf4, trc

READERS = {"asc": asc.read, "trc": trc.read, "blf": blf.read, "mf4": mf4.read}
#: Bytes of a database and of a recording at most, and the range these limits may be set in (fixed values).
MOST_DBC, MOST_TRACE, LIMIT_RANGE = 1024 * 1024, 500 * 1024 * 1024, (1, (1 << 32) - 1)


@dataclass
class Trace:
    frames: DataFrame
    meta: DataFrame
    kind: str
    path: str
    closed: bool = False

    def opened(self) -> Trace:
        """Itself, while the session that opened it has not closed it."""
        if self.closed:
            raise ValueError("trace handle is closed")
        return self


def trace_type(name: str) -> str | None:
    """The type of a recording by its extension, in any case."""
    end = name.rsplit(".", 1)[-1].lower()
    return end if end in READERS and "." in name else None


def display_name(name: str) -> str:
    return name[: -len(name.rsplit(".", 1)[-1]) - 1] if trace_type(name) or name.lower().endswith(".dbc") else name


def dropped_trace(names: list[str]) -> str | None:
    """The recording among dropped files: only a single file counts."""
    return names[0] if len(names) == 1 and trace_type(names[0]) else None


def dropped_databases(names: list[str]) -> list[str]:
    return [n for n in names if n.lower().endswith(".dbc")]


def trace_warning(skipped: Column) -> Column:
    """What to say about lines that were skipped; null if there are none."""
    return F.when(skipped > 0, F.concat(F.lit("Parsed with "), skipped.cast("string"), F.lit(" malformed "), F.when(skipped == 1, "line").otherwise("lines"), F.lit(" skipped.")))


def check_limit(limit: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not LIMIT_RANGE[0] <= limit <= LIMIT_RANGE[1]:
        raise ValueError("a limit is a whole number of bytes from 1 to 4294967295")
    return limit


def open_trace(spark: SparkSession, path: str, max_data_bytes: int | None = None) -> Trace:
    """Frames and metadata of one recording or of all that a path pattern names. Binary ones may expand to ``max_data_bytes`` each, MOST_TRACE if that
    is not given; text recordings are read in splits and may have any size, unless it is given."""
    kind = trace_type(path)
    if kind is None:
        raise ValueError("Unsupported trace file type. Open .asc, .trc, .blf, or .mf4.")
    limit = check_limit(MOST_TRACE if max_data_bytes is None else max_data_bytes)
    if kind in ("asc", "trc"):
        if max_data_bytes is not None:
            longest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0  # of the file list, no content
            if longest > limit:
                raise ValueError(f"the recording has more than {limit} bytes")
        frames, meta = READERS[kind](spark, path)
    else:
        frames, meta = READERS[kind](spark, path, limit)
    return Trace(frames, meta, kind, path)


def open_dbc(source: str | bytes, max_dbc_bytes: int = MOST_DBC) -> Database:
    """A database from its bytes or text."""
    size = len(source) if isinstance(source, bytes) else len(source.encode())
    if size > check_limit(max_dbc_bytes):
        raise ValueError(f"the database has more than {max_dbc_bytes} bytes")
    return dbc.parse(source)


class Library:
    """Saved databases as Parquet folders, one for each hash of a content; saving one again changes nothing."""

    SCHEMA = "id string, name string, bytes binary"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except Exception as e:  # the folder comes with the first database
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def put(self, files: list[tuple[str, bytes]]) -> list[str]:
        """Saves files (name, bytes); all or none: each must be readable first."""
        for _, data in files:
            open_dbc(data)
        new = {hashlib.sha256(data).hexdigest(): (name, data) for name, data in files}
        known = {r["id"] for r in self.rows().where(F.col("id").isin(list(new))).select("id").collect()}
        rows = [(i, name, data) for i, (name, data) in new.items() if i not in known]
        if rows:
            self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.partitionBy("id").mode("append").parquet(self.path)
        return list(new)

    def reload(self) -> tuple[dict[str, Database], list[str]]:
        """All databases that can be read, by their names' order, and what is wrong with the others."""
        good, faults = {}, []
        for r in self.rows().orderBy("name", "id").toLocalIterator():
            try:
                good[r["id"]] = open_dbc(bytes(r["bytes"]))
            except ValueError as e:
                faults.append(f"{r['name']}: {e}")
        return good, faults

    def _remove(self, path: str) -> bool:
        own = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return own.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)

    def delete(self, file_id: str) -> bool:
        """Removes a database; says whether it was there."""
        if not set(file_id) <= set("0123456789abcdef") or not file_id:
            return False
        return self._remove(f"{self.path}/id={file_id}")

    def reset(self) -> None:
        """Removes all databases."""
        for r in self.rows().select("id").toLocalIterator():
            self.delete(r["id"])

    def get(self, file_id: str) -> Database:
        row = self.rows().where(F.col("id") == file_id).first()
        if row is None:
            raise KeyError(file_id)
        return open_dbc(bytes(row["bytes"]))
