"""MF4 recordings: bus frames and native channels of finalised version 4 files.

One task reads the index of a file and hands its data blocks out, packed as they are, with the plan of the channels that are wanted; other tasks expand
the blocks and decode the records that lie within as columns of a matrix of bytes. Where a record begins in each block follows from the sizes
in the index; records across the borders of blocks are put together from their pieces, which only such blocks are opened for. Data groups whose
records carry ids are cut up by id, in the order of the file, while they are handed out.
"""

from __future__ import annotations

import pickle
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import FD_LENGTHS
from ..operators.series import finite, numbered
from .asc import TraceError
from .blf import MOST_BYTES
from .text_lines import FRAME_COLUMNS, FRAME_SCHEMA

#: Clocks from this second on are absolute: the recording starts at its first time (fixed value).
ABSOLUTE = 100_000_000
COMPOSITES = {"CAN_DataFrame": "data", "CAN_RemoteFrame": "remote", "CAN_ErrorFrame": "error"}


@dataclass
class Channel:
    name: str
    kind: int
    sync: int
    data_type: int
    bit_offset: int
    byte_offset: int
    bits: int
    flags: int
    invalid_bit: int
    conversion: tuple[int, np.ndarray]
    unit: str

    @property
    def numeric(self) -> bool:
        return self.data_type <= 5 and 0 < self.bits <= 64 and (self.data_type < 4 or self.bits in (32, 64))


@dataclass
class Group:
    name: str
    record_id: int
    cycles: int
    flags: int
    size: int
    invalid_size: int
    is_can: bool
    channels: list[Channel] = field(default_factory=list)

    def named(self, name: str) -> Channel | None:
        return next((c for c in self.channels if c.name == name), None)

    @property
    def master(self) -> Channel | None:
        return next((c for c in self.channels if c.kind == 2 and c.sync == 1 and c.numeric), None)

    @property
    def frame_kind(self) -> str | None:
        """What frames the group's records are, or None for a group of native channels."""
        if not (self.flags & 2 or self.is_can) or self.master is None:
            return None
        found = next((c.name for c in self.channels if c.name in COMPOSITES), None)
        return COMPOSITES[found] if found and self.named(f"{found}.ID") and self.named(f"{found}.DLC") else None


class File:
    """The index of a file: data groups with their channel groups, and attachments."""

    def __init__(self, data: bytes, most: int = MOST_BYTES):
        self.data, self.most = data, most
        if data[:8] == b"UnFinMF ":
            raise TraceError("the recording was not finalised")
        if len(data) < 88 or data[:8] != b"MDF     ":
            raise TraceError("no MDF header")
        if not data[8:16].decode("latin-1").strip(" \0").startswith("4"):
            raise TraceError("unsupported MDF version")
        kind, links, body = self.block(64)
        if kind != b"##HD" or len(links) < 6:
            raise TraceError("no MDF header block")
        ns = struct.unpack_from("<Q", body)[0]
        self.start_ms = ns // 1_000_000 if ns else None
        self.groups: list[tuple[int, int, list[Group]]] = []  # data address, record id size, groups
        for at in self.chain(links[0], b"##DG"):
            _, own, body = self.block(at)
            self.groups.append((own[2], body[0], [self.group(a, i) for i, a in enumerate(self.chain(own[1], b"##CG"))]))
        self.attachments = [self.attachment(a) for a in self.chain(links[3], b"##AT")]

    def block(self, at: int) -> tuple[bytes, tuple[int, ...], bytes]:
        if at + 24 > len(self.data):
            raise TraceError("a block is cut off")
        kind, _, size, n = struct.unpack_from("<4sIQQ", self.data, at)
        if size < 24 + 8 * n or at + size > len(self.data):
            raise TraceError("a block is cut off")
        return kind, struct.unpack_from(f"<{n}Q", self.data, at + 24), self.data[at + 24 + 8 * n : at + size]

    def chain(self, at: int, kind: bytes) -> Iterator[int]:
        seen = set()
        while at:
            if at in seen:
                raise TraceError("blocks link in a circle")
            seen.add(at)
            own, links, _ = self.block(at)
            if own != kind:
                raise TraceError("a block has the wrong kind")
            yield at
            at = links[0]

    def text(self, at: int) -> str:
        if not at:
            return ""
        kind, _, body = self.block(at)
        return body.split(b"\0", 1)[0].decode("utf-8", "replace") if kind in (b"##TX", b"##MD") else ""

    def group(self, at: int, i: int) -> Group:
        _, links, body = self.block(at)
        if len(body) < 32:
            raise TraceError("a channel group is invalid")
        record, cycles, flags = struct.unpack_from("<QQH", body)
        size, invalid = struct.unpack_from("<II", body, 24)
        can = False
        if links[3]:
            kind, _, source = self.block(links[3])
            can = kind == b"##SI" and source[:2] == b"\x02\x02"
        out = Group(self.text(links[2]) or f"Group {i + 1}", record, cycles, flags, size, invalid, can)
        self.channels(links[1], out.channels, set())
        return out

    def channels(self, at: int, out: list[Channel], seen: set[int]) -> None:
        while at:
            if at in seen:
                raise TraceError("blocks link in a circle")
            seen.add(at)
            kind, links, body = self.block(at)
            if kind != b"##CN" or len(links) < 8 or len(body) < 24:
                raise TraceError("a channel is invalid")
            byte_offset, bits, flags, invalid = struct.unpack_from("<IIII", body, 4)
            conversion, unit = (0, np.zeros(0)), ""
            if links[4]:
                _, cc_links, cc = self.block(links[4])
                n = struct.unpack_from("<H", cc, 6)[0]
                conversion = (cc[0], np.frombuffer(cc, "<f8", n, 24 if len(cc) >= 24 + 8 * n else 8))
                unit = self.text(cc_links[1])
            out.append(Channel(self.text(links[2]), body[0], body[1], body[2], body[3], byte_offset, bits, flags, invalid, conversion, self.text(links[6]) or unit))
            if links[1] and self.data[links[1] : links[1] + 4] == b"##CN":
                self.channels(links[1], out, seen)
            at = links[0]

    def attachment(self, at: int) -> tuple[str, str, bytes | None]:
        """name, type, content; no content if it is not embedded."""
        _, links, body = self.block(at)
        flags, original, embedded = struct.unpack_from("<H", body)[0], *struct.unpack_from("<QQ", body, 24)
        content = body[40 : 40 + embedded] if flags & 1 else None
        if content is not None and flags & 2:
            content = inflate(content, original)
        return self.text(links[1]), self.text(links[2]), content

    def blocks(self, at: int) -> Iterator[tuple[int, int, bytes]]:
        """expanded size, row of a transposed block or -1 if it is packed as it is or -2 if it is plain, and bytes of a data group's blocks in order."""
        todo, seen, total = [at], set(), 0
        while todo:
            at = todo.pop()
            if not at:
                continue
            if at in seen:
                raise TraceError("blocks link in a circle")
            seen.add(at)
            kind, links, body = self.block(at)
            if kind == b"##DL":
                todo += [links[0], *links[:0:-1]]
            elif kind == b"##HL":
                todo.append(next((a for a in links if a), 0))
            elif kind in (b"##DT", b"##DV", b"##DZ"):
                if kind == b"##DZ":
                    method, (row,), (size, packed) = body[2], struct.unpack_from("<I", body, 4), struct.unpack_from("<QQ", body, 8)
                    if method > 1:
                        raise TraceError(f"unsupported compression {method}")
                    if method == 1 and row == 0:
                        raise TraceError("compressed data is invalid")
                    row, body = row if method else PACKED, body[24 : 24 + packed]
                else:
                    size, row = len(body), PLAIN
                total += size
                if total > self.most:
                    raise TraceError(f"the data exceeds {self.most} bytes")
                yield size, row, body
            else:
                raise TraceError("unsupported data block")

    def chunks(self, at: int, id_size: int, groups: list[Group]) -> Iterator[tuple[int, int, int, int, bytes, bytes | None]]:
        """group number, start in the group's stream of records, expanded size, row, bytes, and for records with ids their places in the data group."""
        if id_size == 0:
            start = 0
            for size, row, body in self.blocks(at) if groups else ():
                yield 0, start, size, row, body, None
                start += size
            return
        if id_size not in (1, 2, 4, 8):
            raise TraceError("invalid size of record ids")
        by_id = {g.record_id: k for k, g in enumerate(groups)}
        cut: list[tuple[list[bytes], list[int]]] = [([], []) for _ in groups]
        starts, rest, nth = [0] * len(groups), b"", 0

        def given(k: int):
            parts, places = cut[k]
            body = b"".join(parts)
            out = k, starts[k], len(body), PLAIN, body, np.array(places, np.int64).tobytes()
            starts[k] += len(body)
            cut[k] = [], []
            return out

        for size, row, body in self.blocks(at):
            raw, place = rest + expand(size, row, body), 0
            while place + id_size <= len(raw):
                k = by_id.get(int.from_bytes(raw[place : place + id_size], "little"))
                if k is None:
                    raise TraceError("a record has an unknown id")
                end = place + id_size + groups[k].size + groups[k].invalid_size
                if end > len(raw):
                    break
                cut[k][0].append(raw[place + id_size : end])
                cut[k][1].append(nth)
                place, nth = end, nth + 1
            rest = raw[place:]
            yield from (given(k) for k in range(len(groups)) if cut[k][1])
        if len(rest) >= id_size:
            raise TraceError("a record is cut off")


#: Rows of blocks that are packed as they are, and that are not packed.
PACKED, PLAIN = -1, -2


def expand(size: int, row: int, body: bytes) -> bytes:
    """The content of a data block."""
    if row == PLAIN:
        return body
    data = inflate(body, size)
    if row == PACKED:
        return data
    n = size // row * row
    return np.frombuffer(data[:n], np.uint8).reshape(row, -1).T.tobytes() + data[n:]


def inflate(data: bytes, size: int) -> bytes:
    worker = zlib.decompressobj()
    try:
        out = worker.decompress(data, size + 1)
    except zlib.error as e:
        raise TraceError("compressed data is invalid") from e
    if len(out) != size or not worker.eof:
        raise TraceError("compressed data has the wrong size")
    return out


def raw(rows: np.ndarray, c: Channel) -> np.ndarray:
    """The channel's bits of every record as unsigned numbers."""
    n = (c.bit_offset + c.bits + 7) // 8
    if c.byte_offset + n > rows.shape[1]:
        raise TraceError("a channel reaches over its record")
    own = rows[:, c.byte_offset : c.byte_offset + n].astype(np.uint64)
    if c.data_type % 2:
        own = own[:, ::-1]
    out = np.zeros(len(rows), np.uint64)
    for j in range(min(n, 8)):
        out |= own[:, j] << np.uint64(8 * j)
    out >>= np.uint64(c.bit_offset)
    if n == 9:
        out |= own[:, 8] << np.uint64(64 - c.bit_offset)
    return out if c.bits == 64 else out & np.uint64((1 << c.bits) - 1)


def physical(rows: np.ndarray, c: Channel) -> np.ndarray:
    bits = raw(rows, c)
    if c.data_type in (0, 1):
        x = bits.astype(np.float64)
    elif c.data_type in (2, 3):
        x = ((bits << np.uint64(64 - c.bits)).view(np.int64) >> np.int64(64 - c.bits)).astype(np.float64)
    else:
        x = bits.astype(np.uint32).view(np.float32).astype(np.float64) if c.bits == 32 else bits.view(np.float64)
    kind, v = c.conversion
    if kind == 0:
        return x
    if kind == 1 and len(v) >= 2:
        return v[0] + v[1] * x
    if kind == 2 and len(v) >= 6:
        below = v[3] * x * x + v[4] * x + v[5]
        if (np.abs(below) <= np.finfo(float).eps).any():
            raise TraceError(f"the conversion of {c.name} divides by zero")
        return (v[0] * x * x + v[1] * x + v[2]) / below
    if kind in (4, 5) and len(v) >= 2:
        keys, values = v[: len(v) // 2 * 2 : 2], v[1 : len(v) // 2 * 2 : 2]
        if kind == 4:
            return np.interp(x, keys, values)
        return values[np.argmin(np.abs(keys[None, :] - x[:, None]), axis=1)]
    raise TraceError(f"the conversion of {c.name} is not supported")


def valid(rows: np.ndarray, g: Group, c: Channel) -> np.ndarray:
    if c.flags & 1:
        return np.zeros(len(rows), bool)
    at = g.size + (c.invalid_bit >> 3)
    if not c.flags & 2 or at >= rows.shape[1]:
        return np.ones(len(rows), bool)
    return rows[:, at] & (1 << (c.invalid_bit & 7)) == 0


def _frame_columns(g: Group, places: np.ndarray, rows: np.ndarray) -> dict[str, object]:
    """The columns of the frames that the records are."""
    prefix, kind = next((c.name, COMPOSITES[c.name]) for c in g.channels if c.name in COMPOSITES)
    member = lambda name: g.named(f"{prefix}.{name}")
    good = valid(rows, g, g.master)
    places, rows = places[good], rows[good]
    ns = np.rint(physical(rows, g.master) * 1e9).astype(np.int64)
    ident = (raw(rows, member("ID")) & np.uint64(0x1FFFFFFF)).astype(np.int64)
    extended = raw(rows, member("IDE")) != 0 if member("IDE") else ident > 0x7FF
    known = extended | (ident <= 0x7FF)
    if kind != "error" and not known.all():
        raise TraceError("an identifier is out of range")
    dlc = np.minimum(raw(rows, member("DLC")), np.uint64(255)).astype(np.int64)
    length = np.minimum(raw(rows, member("DataLength")), np.uint64(1 << 32)).astype(np.int64) if member("DataLength") and kind != "remote" else None
    fd = raw(rows, member("EDL")) != 0 if member("EDL") else np.full(len(rows), kind == "data") & ((dlc > 8) | ((length > 8) if length is not None else False))
    n = np.zeros(len(rows), np.int64)
    if kind != "remote":
        n = np.minimum(length, 64) if length is not None else np.where(fd, np.array(FD_LENGTHS)[np.minimum(dlc, 15)], np.minimum(dlc, 8))
        cell = member("DataBytes")
        most = int(n.max(initial=0))
        if most and (cell is None or cell.kind != 0 or cell.data_type != 10 or most * 8 > cell.bits):
            raise TraceError("a record has no payload of its length")
        if most and cell.byte_offset + most > rows.shape[1]:
            raise TraceError("a channel reaches over its record")
        cells = rows[:, cell.byte_offset : cell.byte_offset + most] if most else np.zeros((len(rows), 0), np.uint8)
        payload = cells[np.arange(most) < n[:, None]].tobytes()
    source = lambda name: (raw(rows, member(name)), valid(rows, g, member(name))) if member(name) else (np.zeros(len(rows), np.uint64), np.zeros(len(rows), bool))
    (bus, on_bus), (way, has_way) = source("BusChannel"), source("Dir")
    return {
        "place": places, "timestamp_ns": ns, "channel": (bus.astype(np.int64), on_bus & (bus != 0)), "direction": np.where(has_way, np.where(way != 0, "tx", "rx"), "unknown"),
        "kind": kind, "can_id": (ident, known), "is_extended": (extended, known), "is_fd": fd, "dlc": dlc, "payload_len": n, "payload": None if kind == "remote" else payload,
    }


def _frame_batch(path: str, d: int, g: Group, places: np.ndarray, rows: np.ndarray):
    import pyarrow as pa

    c = _frame_columns(g, places, rows)
    n = len(c["place"])
    masked = lambda x, t: pa.array(x[0], t, mask=~x[1])
    if c["payload"] is None:
        payload = pa.nulls(n, pa.binary())
    else:
        ends = np.concatenate([[0], np.cumsum(c["payload_len"])]).astype(np.int32)
        payload = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(c["payload"])])
    seq = (d << DATA_GROUP_BITS) | c["place"]
    columns = [
        pa.array([path] * n, pa.string()), pa.array(seq, pa.int64()), pa.array(c["timestamp_ns"]), masked(c["channel"], pa.int32()), pa.array(c["direction"].astype(object), pa.string()), pa.array([c["kind"]] * n, pa.string()),
        masked(c["can_id"], pa.int32()), masked(c["is_extended"], pa.bool_()), pa.array(c["is_fd"], pa.bool_()), pa.array(c["dlc"], pa.int32()), pa.array(c["payload_len"], pa.int32()), payload,
    ]
    return pa.RecordBatch.from_arrays(columns, names=list(FRAME_COLUMNS))


def native(f: File) -> list[tuple[int, int, int, Group, Channel]]:
    """id, data group, group and channel of the native signals."""
    out = []
    for d, (_, _, groups) in enumerate(f.groups):
        for k, g in enumerate(groups):
            if g.frame_kind is None and g.master is not None:
                out += [(d, k, g, c) for c in g.channels if c.kind == 0 and c.numeric and c.name]
    return [(i, *x) for i, x in enumerate(out)]


#: Places of a record's number in the order of a file, below that of its data group.
DATA_GROUP_BITS = 40
_CHUNK = "path string, data_group int, number int, start long, size long, row int, width int, bytes binary, places binary, plan binary"


def _per_file(path: str | list[str] | DataFrame, spark: SparkSession, make, schema: str) -> DataFrame:
    """Rows that ``make(path, content)`` gives for each file, one task for a file. Instead of paths it takes a table of files with path and content."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from make(p, content.as_py())

    files = path if isinstance(path, DataFrame) else spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(run, schema)


def _dealt(spark: SparkSession, path: str | list[str] | DataFrame, most: int, wanted: Callable[[File], dict[tuple[int, int], tuple]]) -> DataFrame:
    """The data blocks of the groups that ``wanted`` names, with the plan it has for each, dealt out to all tasks."""

    def rows(p: str, content: bytes) -> Iterator:
        import pyarrow as pa

        f = File(content, most)
        plans = wanted(f)
        packed = {k: pickle.dumps(v) for k, v in plans.items()}
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        for d in sorted({d for d, _ in plans}):
            at, id_size, groups = f.groups[d]
            for k, start, size, row, body, places in f.chunks(at, id_size, groups):
                if (d, k) in plans:
                    own = (p, d, k, start, size, row, groups[k].size + groups[k].invalid_size, body, places, packed[d, k])
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(own, kinds, strict=True)], names=[c.split()[0] for c in _CHUNK.split(", ")])

    return _per_file(path, spark, rows, _CHUNK).repartition("path", "data_group", "number", "start")


def _each(decoded: Callable, across: bool) -> Callable:
    """Blocks -> what ``decoded(path, data group, plan, places, rows)`` gives for the records that lie within each; or, with blocks in order, for the records across them."""

    def within(batches: Iterator) -> Iterator:
        for p, d, _, start, size, row, width, body, places, plan in _chunk_rows(batches):
            plan = pickle.loads(plan)
            first = -start % width if width else size
            n = max(0, (size - first) // width) if width else 0
            if n:
                data = np.frombuffer(expand(size, row, body), np.uint8)
                at = (start + first) // width + np.arange(n)
                nth = np.frombuffer(places, np.int64) if places is not None else at
                keep = at < plan[0].cycles if places is None else np.ones(n, bool)
                yield from decoded(p, d, plan, nth[keep], data[first : first + n * width].reshape(n, width)[keep])

    def over(batches: Iterator) -> Iterator:
        own, rest = None, b""
        for p, d, k, start, size, row, width, body, _, plan in _chunk_rows(batches):
            if (p, d, k) != own:
                own, rest = (p, d, k), b""
            plan = pickle.loads(plan)
            data = expand(size, row, body)
            first = min(-start % width, size)
            rest += data[:first]
            if len(rest) == width:
                at = (start + first) // width - 1
                if at < plan[0].cycles:
                    yield from decoded(p, d, plan, np.array([at]), np.frombuffer(rest, np.uint8).reshape(1, width))
                rest = b""
            if first < size:
                rest = data[first + (size - first) // width * width :]

    return over if across else within


def _chunk_rows(batches: Iterator) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(j)[i].as_py() for j in range(batch.num_columns))


def _decoded(chunks: DataFrame, decoded: Callable, schema: str) -> DataFrame:
    """What is decoded from all records of (path, data_group, number, start, ...)."""
    width = F.col("width")
    apart = chunks.where((width > 0) & F.col("places").isNull() & ((F.col("start") % width != 0) | ((F.col("start") + F.col("size")) % width != 0)))
    keys = ["path", "data_group", "number"]
    over = apart.repartition(*keys).sortWithinPartitions(*keys, "start").mapInArrow(_each(decoded, True), schema)
    return chunks.mapInArrow(_each(decoded, False), schema).unionByName(over)


def _lean(g: Group, channels: list[Channel]) -> Group:
    """A group with some of its channels only."""
    return replace(g, channels=channels)


def clocks(spark: SparkSession, path: str | list[str] | DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """trace_id, shift_ns of raw stamps, offset_s of native times, and low_s and high_s, the extent of native times: absolute clocks share one origin.

    Only the time channels are decoded, block by block.
    """

    def wanted(f: File) -> dict:
        out = {}
        for d, (_, _, groups) in enumerate(f.groups):
            for k, g in enumerate(groups):
                if g.master is not None and (g.frame_kind or any(c.kind == 0 and c.numeric and c.name for c in g.channels)):
                    out[d, k] = (_lean(g, [g.master]), g.frame_kind)
        return out

    def decoded(p: str, d: int, plan: tuple, places: np.ndarray, rows: np.ndarray) -> Iterator:
        import pyarrow as pa

        g, kind = plan
        t = physical(rows[valid(rows, g, g.master)], g.master)
        if kind:
            ns = np.rint(t * 1e9).astype(np.int64)
            own = (p, int(ns.min()), None, None) if len(ns) else None
        else:
            t = t[np.isfinite(t) & (t >= 0)]
            own = (p, None, float(t.min()), float(t.max())) if len(t) else None
        if own:
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(own, kinds, strict=True)], names=["trace_id", "raw_ns", "low_s", "high_s"])

    found = _decoded(_dealt(spark, path, most, wanted), decoded, "trace_id string, raw_ns long, low_s double, high_s double")
    found = found.groupBy("trace_id").agg(F.coalesce(F.min("raw_ns"), F.lit(0)).alias("raw_ns"), F.min("low_s").alias("low_s"), F.max("high_s").alias("high_s"))
    raw_at, own_at = F.col("raw_ns") >= ABSOLUTE * 1_000_000_000, F.coalesce(F.col("low_s") >= ABSOLUTE, F.lit(False))
    shared = F.least(F.col("raw_ns"), F.rint(F.col("low_s") * 1e9).cast("long"))
    return found.select(
        "trace_id", "low_s", "high_s", F.when(raw_at & own_at, shared).when(raw_at, F.col("raw_ns")).otherwise(0).alias("shift_ns"),
        F.when(raw_at & own_at, shared / 1e9).when(own_at, F.col("low_s")).otherwise(0.0).alias("offset_s"),
    )


def _checked(f: File) -> File:
    if not native(f) and not any(g.frame_kind for _, _, groups in f.groups for g in groups):
        raise TraceError("the recording has neither frames nor signals")
    return f


def read(spark: SparkSession, path: str | list[str] | DataFrame, max_data_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(frames, meta) of MF4 files; seq rises in the order of a file."""

    def wanted(f: File) -> dict:
        return {(d, k): (g,) for d, (_, _, groups) in enumerate(_checked(f).groups) for k, g in enumerate(groups) if g.frame_kind}

    def decoded(p: str, d: int, plan: tuple, places: np.ndarray, rows: np.ndarray) -> Iterator:
        yield _frame_batch(p, d, plan[0], places, rows)

    def heads(p: str, content: bytes) -> Iterator:
        import pyarrow as pa

        f = _checked(File(content, max_data_bytes))
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.string()), pa.array([f.start_ms], pa.int64()), pa.array([len(native(f))], pa.int64())], names=["trace_id", "measurement_start_ms", "n_native"])

    shifts = clocks(spark, path, max_data_bytes)
    out = _decoded(_dealt(spark, path, max_data_bytes, wanted), decoded, FRAME_SCHEMA).join(shifts.select("trace_id", "shift_ns"), "trace_id")
    out = out.withColumn("timestamp_ns", F.col("timestamp_ns") - F.col("shift_ns")).select(*FRAME_COLUMNS)
    data = F.col("kind") == "data"
    counts = out.groupBy("trace_id").agg(F.count(F.when(data, 1)).alias("n"), F.max(F.when(data, F.col("timestamp_ns"))).alias("last_ns"))
    meta = _per_file(path, spark, heads, "trace_id string, measurement_start_ms long, n_native long").join(counts, "trace_id", "left").join(shifts, "trace_id", "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    n = F.when((n > 0) | (F.col("n_native") > 0), n).otherwise(F.raise_error(F.lit("the recording has neither frames nor signals")).cast("long"))
    native_ns = F.rint((F.col("high_s") - F.col("offset_s")) * 1e9).cast("long")
    return out, meta.select("trace_id", F.lit("mf4").alias("trace_type"), "measurement_start_ms", n.alias("valid_message_count"), F.lit(0).cast("long").alias("skipped_line_count"), F.greatest("last_ns", native_ns).alias("duration_ns"))


def read_catalog(spark: SparkSession, path: str | list[str] | DataFrame) -> DataFrame:
    """trace_id, data_group, group, group_name, id, name, unit of the native signals."""

    def rows(p: str, content: bytes) -> Iterator:
        import pyarrow as pa

        own = [(p, d, k, g.name, i, c.name, c.unit) for i, d, k, g, c in native(File(content))]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in own], t) for j, t in enumerate(kinds)], names=["trace_id", "data_group", "group", "group_name", "id", "name", "unit"])

    return _per_file(path, spark, rows, "trace_id string, data_group int, group int, group_name string, id int, name string, unit string")


def read_channels(spark: SparkSession, path: str | list[str] | DataFrame, signal_ids: list[int], max_data_bytes: int = MOST_BYTES) -> DataFrame:
    """trace_id, id, seq (rank in time), time_ms, value of native signals; samples that are invalid or not finite are left out.

    Of each block only the time and the wanted channels are decoded, and no frames.
    """

    def wanted(f: File) -> dict:
        out: dict[tuple[int, int], tuple] = {}
        for i, d, k, g, c in native(f):
            if i in signal_ids:
                out.setdefault((d, k), (_lean(g, [g.master]), []))[1].append((i, c))
        if not out:
            raise TraceError("the recording has no such signal")
        return out

    def decoded(p: str, d: int, plan: tuple, places: np.ndarray, rows: np.ndarray) -> Iterator:
        import pyarrow as pa

        g, channels = plan
        good = valid(rows, g, g.master)
        places, rows = places[good], rows[good]
        seconds = physical(rows, g.master)
        for i, c in channels:
            on = valid(rows, g, c)
            t, v, at = seconds[on], physical(rows[on], c), places[on]
            n = len(t)
            yield pa.RecordBatch.from_arrays([pa.array([p] * n, pa.string()), pa.array([i] * n, pa.int32()), pa.array(at), pa.array(t), pa.array(v)], names=["trace_id", "id", "place", "time_s", "value"])

    found = _decoded(_dealt(spark, path, max_data_bytes, wanted), decoded, "trace_id string, id int, place long, time_s double, value double")
    found = found.join(clocks(spark, path, max_data_bytes).select("trace_id", "offset_s"), "trace_id", "left")
    ms = (F.col("time_s") - F.coalesce("offset_s", F.lit(0.0))) * 1000.0
    found = found.select(F.to_json(F.struct("trace_id", "id")).alias("signal_key"), F.col("place").alias("seq"), ms.alias("time_ms"), "value").where(finite(F.col("time_ms")) & finite(F.col("value")))
    key = F.from_json("signal_key", "trace_id string, id int")
    return numbered(found).select(key.alias("k"), F.col("i").alias("seq"), "time_ms", "value").select("k.trace_id", "k.id", "seq", "time_ms", "value")


def read_channel(spark: SparkSession, path: str | list[str], signal_id: int, max_data_bytes: int = MOST_BYTES) -> DataFrame:
    """trace_id, seq, time_ms, value of one native signal in time order."""
    return read_channels(spark, path, [signal_id], max_data_bytes).drop("id")


def read_databases(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, bytes of the DBC files embedded in recordings."""

    def rows(p: str, content: bytes) -> Iterator:
        import pyarrow as pa

        own = [(p, n.replace("\\", "/").rsplit("/", 1)[-1] or "embedded.dbc", b) for n, t, b in File(content).attachments if b is not None and (n.lower().endswith(".dbc") or "dbc" in t.lower())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in own], pa.string()), pa.array([r[1] for r in own], pa.string()), pa.array([r[2] for r in own], pa.binary())], names=["trace_id", "name", "bytes"])

    return _per_file(path, spark, rows, "trace_id string, name string, bytes binary")
