"""BLF recordings, read by container: many tasks share a file.

The headers of containers are not compressed, so a file is read in splits that end at object marks, and one pass over the marks finds which
belong to which container. Containers are expanded and parsed by themselves, each from its first mark on; what lies before it and what is cut off
at the end is carried from container to container in a small table, which also counts the frames. Where a first mark turns out to be no object's
(its bytes stood in another one's data), the containers of that file are parsed one after the other.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Generator, Iterator
from datetime import UTC, datetime
from itertools import groupby, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .asc import TraceError
from .text_lines import FRAME_COLUMNS, FRAME_SCHEMA

#: Object types and flags (fixed values of the format).
CAN_MESSAGE, CONTAINER, CAN_ERROR_EXT, CAN_MESSAGE_2, CAN_FD, CAN_FD_64 = 1, 10, 73, 86, 100, 101
EXTENDED, REMOTE, FD_EDL, FD64_REMOTE, FD64_EDL, TEN_US, ONE_NS = 0x80000000, 0x80, 0x01, 0x10, 0x1000, 1, 2
SMALLEST = {CAN_MESSAGE: 16, CAN_MESSAGE_2: 16, CAN_ERROR_EXT: 32, CAN_FD: 84, CAN_FD_64: 40}
HEADER, BASE = 72, 16
MOST_BYTES = 500 * 1024 * 1024
#: Frames that a task holds as Python values at a time.
FRAMES_AT_ONCE = 5_000
_U32, _U16 = struct.Struct("<I"), struct.Struct("<H")
_OBJECT, _REST, _STAMP = struct.Struct("<4sHHII"), struct.Struct("<HHII"), struct.Struct("<IIQ")
#: Kind of a row that says why a container's frames cannot be read.
FAULT = "fault"
#: What every object begins with.
MARK = b"LOBJ"


def start_ms(header: bytes) -> int | None:
    """Unix milliseconds of a SYSTEMTIME, taken as UTC; None if it is no time. Days run on into the next month."""
    year, month, _, day, hour, minute, second, ms = struct.unpack("<8H", header)
    if not (year and 0 < month <= 12 and 0 < day <= 31 and hour <= 23 and minute <= 59 and second <= 59 and ms <= 999):
        return None
    days = datetime(year, month, 1, tzinfo=UTC).toordinal() - datetime(1970, 1, 1, tzinfo=UTC).toordinal() + day - 1
    return (days * 86400 + hour * 3600 + minute * 60 + second) * 1000 + ms


def bodies(data: bytes) -> Iterator[bytes]:
    """The bodies of the file's containers, as they are stored."""
    if len(data) < HEADER or data[:4] != b"LOGG":
        raise TraceError("no BLF header")
    at = _U32.unpack_from(data, 4)[0]
    if not HEADER <= at <= len(data):
        raise TraceError("the BLF header has an impossible size")
    while at < len(data):
        if at + BASE > len(data):
            raise TraceError("an object's header is cut off")
        mark, _, _, size, kind = _OBJECT.unpack_from(data, at)
        if mark != MARK or size < BASE:
            raise TraceError("an object is invalid")
        if at + size + size % 4 > len(data):
            raise TraceError("an object is cut off")
        if kind == CONTAINER:
            yield data[at + BASE : at + size]
        at += size + size % 4


def expand(body: bytes, most: int) -> bytes:
    """The content of a container."""
    if len(body) < 16:
        raise TraceError("a container is invalid")
    method, expanded = _U16.unpack_from(body)[0], _U32.unpack_from(body, 8)[0]
    if (expanded if method == 2 else len(body) - 16) > most:
        raise TraceError(f"the data exceeds {most} bytes")
    if method == 0:
        return body[16:]
    if method != 2:
        raise TraceError(f"unsupported compression {method}")
    worker = zlib.decompressobj()
    try:
        out = worker.decompress(body[16:], expanded + 1)
    except zlib.error as e:
        raise TraceError("a container's data is invalid") from e
    if len(out) != expanded or not worker.eof or worker.unused_data:
        raise TraceError("a container's data has the wrong size")
    return out


def containers(data: bytes, most: int) -> Iterator[bytes]:
    """The contents of the file's containers, expanded; together at most ``most`` bytes."""
    left = most
    for body in bodies(data):
        out = expand(body, left)
        left -= len(out)
        yield out


def _objects(data: bytes, at: int = 0) -> Generator[tuple[int, int, int, int, bytes], None, int]:
    """type, timestamp_ns, header size, object size, body of the objects from ``at`` on; returns where the first cut off one begins."""
    while at < len(data):
        found = data.find(MARK, at, min(at + 8, len(data)))
        if found < 0 and at + 8 <= len(data):
            raise TraceError("an object is missing")
        if found < 0 or found + BASE > len(data):
            return at
        _, header, version, size, kind = _OBJECT.unpack_from(data, found)
        if min(size, header) < BASE:
            raise TraceError("an object is invalid")
        end = found + size
        after = end + (0 if kind == CAN_FD_64 else size % 4)
        if after > len(data):
            return at
        at = after
        if version not in (1, 2):
            continue
        body = found + BASE + (16 if version == 1 else 24)
        if body > end:
            raise TraceError("an object's header is invalid")
        flags, _, stamp = _STAMP.unpack_from(data, found + BASE)
        yield kind, stamp * 10_000 if flags & TEN_US and not flags & ONE_NS else stamp, header, size, data[body:end]
    return at


def objects(parts: Iterator[bytes]) -> Iterator[tuple[int, int, int, int, bytes]]:
    """type, timestamp_ns, header size, object size, body of the objects in a stream of containers."""
    rest = b""
    for part in parts:
        data = rest + part
        rest = data[(yield from _objects(data)) :]
    if rest:
        raise TraceError("an object is cut off")


def identifier(raw: int) -> tuple[int, bool] | None:
    value, extended = raw & 0x1FFFFFFF, bool(raw & EXTENDED)
    return (value, extended) if extended or value <= 0x7FF else None


def frames(data: bytes, most: int = MOST_BYTES) -> Iterator[tuple]:
    """timestamp_ns, channel, direction, kind, can_id, is_extended, is_fd, dlc, payload_len, payload."""
    return frames_of(objects(containers(data, most)))


def frames_of(found: Iterator[tuple[int, int, int, int, bytes]]) -> Iterator[tuple]:
    """The frames among objects."""
    for kind, stamp, header, size, body in found:
        if kind not in SMALLEST:
            continue
        if len(body) < SMALLEST[kind]:
            raise TraceError("a frame is cut off")
        if kind in (CAN_MESSAGE, CAN_MESSAGE_2, CAN_FD):
            channel, flags, dlc, raw = struct.unpack_from("<HBBI", body)
            n = min(dlc, 8) if kind != CAN_FD else min(body[14], 64)
            payload = body[8 : 8 + n] if kind != CAN_FD else body[20 : 20 + n]
            fd, remote, tx = kind == CAN_FD and bool(body[13] & FD_EDL or n > 8), flags & REMOTE, flags & 1
        elif kind == CAN_FD_64:
            channel, dlc, n, raw, flags = body[0], body[1], min(body[2], 64), _U32.unpack_from(body, 4)[0], _U32.unpack_from(body, 12)[0]
            room = max(0, (body[35] or size) - header - 40)
            payload = body[40 : 40 + min(n, room)].ljust(n, b"\0")
            fd, remote, tx = bool(flags & FD64_EDL), flags & FD64_REMOTE, body[34]
        else:
            channel, dlc, raw = _U16.unpack_from(body)[0], body[10], _U32.unpack_from(body, 16)[0]
            own = identifier(raw) or (None, None)
            yield stamp, channel or None, "unknown", "error", *own, False, dlc, min(dlc, 8), body[24 : 24 + min(dlc, 8)]
            continue
        own = identifier(raw)
        if own is None:
            raise TraceError("an identifier is out of range")
        yield stamp, channel or None, "tx" if tx else "rx", "remote" if remote else "data", *own, fd, dlc, n, None if remote else payload


def to_batch(rows: list[tuple], pa):
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=list(FRAME_COLUMNS))


def _walk(batches: Iterator) -> Iterator:
    """Pieces of files between marks (path, split, place in the scan, size of the piece, its first bytes, size of the file), in order -> path, split,
    place, container, which piece of it that is, and the bytes from its mark to the container's end."""
    import pyarrow as pa

    path, at, total, following, container, inside = None, 0, 0, 0, -1, None  # inside: where the object's data end, if it is a container

    def ended() -> None:
        if path is not None and following < total or at != total + len(MARK):
            raise TraceError("an object's header is cut off" if following + BASE > total else "an object is invalid")

    for batch in batches:
        out: list[tuple] = []
        for own, block, nth, size, head, whole in zip(*[batch.column(j).to_pylist() for j in range(6)], strict=True):
            if own != path:
                if path is not None:
                    ended()
                path, at, total, container, inside, part = own, 0, whole, -1, None, 0
                if whole < HEADER or head[:4] != b"LOGG" or len(head) < 8:
                    raise TraceError("no BLF header")
                following = _U32.unpack_from(head, 4)[0]
                if not HEADER <= following <= whole:
                    raise TraceError("the BLF header has an impossible size")
                at = size + len(MARK)
                continue
            mark = at - len(MARK)
            if mark == following:
                if mark + BASE > total or len(head) < 12:
                    raise TraceError("an object's header is cut off")
                _, _, length, kind = _REST.unpack_from(head)
                if length < BASE:
                    raise TraceError("an object is invalid")
                following = mark + length + length % 4
                if following > total:
                    raise TraceError("an object is cut off")
                inside, part = (mark + length, 0) if kind == CONTAINER else (None, 0)
                container += kind == CONTAINER
            elif mark > following:
                raise TraceError("an object is invalid")
            if inside is not None and mark < inside:
                out.append((path, block, nth, container, part, inside - mark))
                part += 1
            at += size + len(MARK)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], names=["path", "block", "nth", "container", "part", "within"])
    if path is not None:
        ended()


def split_containers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, container (from 0), body of the containers of files, which are read in splits that end at object marks."""
    raw = spark.read.option("lineSep", MARK.decode()).text(path)
    file = lambda x: F.col(f"_metadata.{x}")
    piece = F.col("value").cast("binary")
    pieces = raw.select(file("file_path").alias("path"), file("file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), piece.alias("piece"), file("file_size").alias("file_size"))
    heads = pieces.select("path", "block", "nth", F.octet_length("piece").cast("long").alias("size"), F.substring("piece", 1, 16).alias("head"), "file_size")
    walked = heads.repartition("path").sortWithinPartitions("path", "block", "nth").mapInArrow(_walk, "path string, block long, nth long, container int, part int, within long")
    # a piece of a container: its mark and what follows, up to the container's end
    own = F.substring(F.concat(F.lit(MARK), F.col("piece")), F.lit(1), F.col("within").cast("int"))
    parts = pieces.join(walked, ["path", "block", "nth"]).groupBy("path", "container").agg(F.sort_array(F.collect_list(F.struct("part", own.alias("bytes")))).alias("parts"))
    whole = F.aggregate(F.col("parts.bytes"), F.lit(b""), lambda a, b: F.concat(a, b))
    return parts.withColumn("body", whole).select("path", "container", F.substring("body", BASE + 1, 1 << 30).alias("body"))


def file_containers(files: DataFrame) -> DataFrame:
    """path, container, body of a table of files with path and content, dealt out to all tasks."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for i, body in enumerate(bodies(content.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([i], pa.int32()), pa.array([body], pa.binary())], names=["path", "container", "body"])

    return files.select("path", "content").mapInArrow(cut, "path string, container int, body binary").repartition("path", "container")


def _begin(data: bytes, container: int) -> int:
    """Where parsing starts in a container: at its first mark, but in a file's first container at its beginning."""
    return 0 if container == 0 else len(data) if (at := data.find(MARK)) < 0 else at


def _rows(batch) -> Iterator[tuple[str, int, bytes]]:
    """path, container, body of a batch, one body at a time as a Python value."""
    return ((path.as_py(), i.as_py(), body.as_py()) for path, i, body in zip(*[batch.column(j) for j in range(3)], strict=True))


def _ends(most: int) -> Callable:
    """Containers -> path, container, what precedes the first mark, what is cut off at the end, frames between, size; frames are null if the parse failed."""

    def ends(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for path, i, body in _rows(batch):
                data = expand(body, most)
                at, n = _begin(data, i), 0
                try:
                    walk = _objects(data, at)
                    while True:
                        n += next(walk)[0] in SMALLEST
                except StopIteration as e:
                    out.append((path, i, data[:at], data[e.value :], n, len(data)))
                except TraceError:
                    out.append((path, i, b"", b"", None, len(data)))
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], names=["path", "container", "head", "tail", "n", "size"])

    return ends


_PLACED = "path string, container int, first long, seq long, " + FRAME_SCHEMA.split(", ", 2)[2]


def _stitch(most: int) -> Callable:
    """Ends of containers in order -> for each container the number of its first frame, and the frames that lie across borders. A file whose
    first marks mislead gives one row with container -1."""

    def file(path: str, rows: list[tuple]) -> list[tuple]:
        out, seq, rest, nothing, fault = [], 0, b"", (None,) * 10, None
        for i, head, tail, n, _ in rows:
            if n is None:
                return [(path, -1, None, None, *nothing)]
            try:
                data, found = rest + head, []
                walk = _objects(data)
                while True:
                    found.append(next(walk))
            except StopIteration as e:
                rest = data[e.value :]
            except TraceError:
                return [(path, -1, None, None, *nothing)]
            try:
                for frame in frames_of(iter(found)):
                    out.append((path, i, None, seq, *frame))
                    seq += 1
            except TraceError as e:  # if the first marks do not mislead, as may turn out yet
                fault = fault or e
            if n or tail:  # parsed from its first mark on: the object before must end there
                if len(rest) > 4:
                    return [(path, -1, None, None, *nothing)]
                rest = tail
            out.append((path, i, seq, None, *nothing))
            seq += n
        if fault is not None or rest:
            raise fault or TraceError("an object is cut off")
        return out

    def stitch(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def given(path: str, rows: list[tuple]):
            if sum(r[4] for r in rows) > most:
                raise TraceError(f"the data exceeds {most} bytes")
            found = file(path, rows)
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in found], k) for j, k in enumerate(kinds)], names=[c.split()[0] for c in _PLACED.split(", ")])

        path, held = None, []
        for batch in batches:
            for own, *row in zip(*[batch.column(j).to_pylist() for j in range(6)], strict=True):
                if own != path:
                    if held:
                        yield given(path, held)
                    path, held = own, []
                held.append(tuple(row))
        if held:
            yield given(path, held)

    return stitch


def _frames(most: int, whole: bool) -> Callable:
    """Containers -> their frames from the first mark on, numbered within the container; or, with containers in order, of whole files."""

    def parsed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows() -> Iterator[tuple]:
            if not whole:
                for batch in batches:
                    for path, i, body in _rows(batch):
                        data = expand(body, most)
                        try:
                            for k, f in enumerate(frames_of(_objects(data, _begin(data, i)))):
                                yield path, i, k, f
                        except TraceError as e:  # a fault of the file, unless its first marks mislead
                            yield path, i, 0, (0, None, "unknown", FAULT, None, None, False, 0, 0, str(e).encode())
                return
            flat = ((path, expand(body, most)) for batch in batches for path, _, body in _rows(batch))
            for path, parts in groupby(flat, key=lambda x: x[0]):
                for k, f in enumerate(frames_of(objects(data for _, data in parts))):
                    yield path, 0, k, f

        found = rows()
        while own := list(islice(found, FRAMES_AT_ONCE)):
            frames = to_batch([(path, k, *f) for path, _, k, f in own], pa)
            yield pa.RecordBatch.from_arrays([*frames.columns, pa.array([i for _, i, _, _ in own], pa.int32())], names=[*FRAME_COLUMNS, "container"])

    return parsed


def frames_table(containers: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """The frames of all files of (path, container, body)."""
    bounds = containers.mapInArrow(_ends(most), "path string, container int, head binary, tail binary, n long, size long")
    placed = bounds.repartition("path").sortWithinPartitions("path", "container").mapInArrow(_stitch(most), _PLACED)
    across = placed.where("seq is not null").select(F.col("path").alias("trace_id"), *FRAME_COLUMNS[1:])
    firsts = placed.where("first is not null").select(F.col("path").alias("trace_id"), "container", "first")
    within = containers.mapInArrow(_frames(most, False), f"{FRAME_SCHEMA}, container int").join(firsts, ["trace_id", "container"])
    fault = F.raise_error(F.col("payload").cast("string")).cast("boolean")
    within = within.where(F.when(F.col("kind") == FAULT, fault).otherwise(True))
    within = within.withColumn("seq", F.col("first") + F.col("seq")).select(*FRAME_COLUMNS)
    misled = placed.where("container = -1").select("path").distinct()
    rest = containers.join(misled, "path", "left_semi").repartition("path").sortWithinPartitions("path", "container")
    return within.unionByName(across).unionByName(rest.mapInArrow(_frames(most, True), f"{FRAME_SCHEMA}, container int").select(*FRAME_COLUMNS))


def read(spark: SparkSession, path: str | list[str], max_data_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(frames, meta) of BLF files."""
    heads = spark.read.option("lineSep", MARK.decode()).text(path).where("_metadata.file_block_start = 0 and startswith(value, 'LOGG')")
    heads = heads.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("content"))
    return _tables(heads, frames_table(split_containers(spark, path), max_data_bytes))


def read_files(files: DataFrame, max_data_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(frames, meta) of a table of files with path and content, wherever they come from."""
    return _tables(files.select("path", "content"), frames_table(file_containers(files), max_data_bytes))


def _tables(files: DataFrame, out: DataFrame) -> tuple[DataFrame, DataFrame]:
    def starts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ms = [start_ms(x.as_py()[40:56]) if len(x.as_py()) >= 56 else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ms, pa.int64())], names=["trace_id", "measurement_start_ms"])

    head = files.select("path", F.substring("content", 1, HEADER).alias("content")).mapInArrow(starts, "trace_id string, measurement_start_ms long")
    data = F.col("kind") == "data"
    counts = out.groupBy("trace_id").agg(F.count(F.when(data, 1)).alias("valid_message_count"), F.max(F.when(data, F.col("timestamp_ns"))).alias("duration_ns"))
    meta = head.join(counts, "trace_id", "left").select("trace_id", F.lit("blf").alias("trace_type"), "measurement_start_ms", F.coalesce("valid_message_count", F.lit(0)).alias("valid_message_count"), F.lit(0).cast("long").alias("skipped_line_count"), "duration_ns")
    return out, meta
