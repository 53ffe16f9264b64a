"""Writers of small binary recordings: one file each, as bytes."""

from __future__ import annotations

import struct
import zlib


def blf(objects: list[bytes], size: int = 120, compress: bool = True, start=(2026, 4, 0, 30, 12, 0, 0, 5)) -> bytes:
    """A file whose stream of objects is cut into containers of ``size`` bytes, wherever that falls."""
    stream = b"".join(objects)
    out = b"LOGG" + struct.pack("<I", 144) + bytes(32) + struct.pack("<8H", *start) + bytes(88)
    for at in range(0, len(stream), size):
        part = stream[at : at + size]
        body = struct.pack("<HHIII", 2 if compress else 0, 0, 0, len(part), 0) + (zlib.compress(part) if compress else part)
        n = 16 + len(body)
        out += b"LOBJ" + struct.pack("<HHII", 16, 1, n, 10) + body + bytes(n % 4)
    return out


def blf_object(kind: int, stamp: int, body: bytes, flags: int = 2) -> bytes:
    n = 32 + len(body)
    return b"LOBJ" + struct.pack("<HHII", 32, 1, n, kind) + struct.pack("<IHHQ", flags, 0, 0, stamp) + body + bytes(0 if kind == 101 else n % 4)


def can_message(channel: int, can_id: int, data: bytes, flags: int = 0) -> bytes:
    return struct.pack("<HBBI", channel, flags, len(data), can_id) + data.ljust(8, b"\0")


def can_fd(channel: int, can_id: int, data: bytes, edl: bool = True, flags: int = 0, dlc: int = 9) -> bytes:
    return struct.pack("<HBBI", channel, flags, dlc, can_id) + bytes(5) + bytes([edl, len(data)]) + bytes(5) + data.ljust(64, b"\0")


def error_frame(channel: int, can_id: int, data: bytes) -> bytes:
    return struct.pack("<H", channel) + bytes(8) + bytes([len(data)]) + bytes(5) + struct.pack("<I", can_id) + bytes(4) + data.ljust(8, b"\0")


def can_fd_64(channel: int, can_id: int, data: bytes, tx: int = 1) -> bytes:
    return bytes([channel, 9, len(data), 0]) + struct.pack("<II", can_id, 0) + struct.pack("<I", 0x1000) + bytes(18) + bytes([tx, 0]) + bytes(4) + data


class Mf4:
    """Blocks are appended and linked by their places."""

    def __init__(self, start_ns: int = 0):
        self.out = bytearray(b"MDF     4.10    " + bytes(48))
        self.head = self.block(b"##HD", [0] * 6, struct.pack("<Q", start_ns) + bytes(24))

    def block(self, kind: bytes, links: list[int], body: bytes) -> int:
        self.out += bytes(-len(self.out) % 8)
        at = len(self.out)
        self.out += kind + bytes(4) + struct.pack("<QQ", 24 + 8 * len(links) + len(body), len(links)) + struct.pack(f"<{len(links)}Q", *links) + body
        return at

    def link(self, at: int, i: int, to: int) -> None:
        struct.pack_into("<Q", self.out, at + 24 + 8 * i, to)

    def text(self, text: str) -> int:
        return self.block(b"##TX", [], text.encode() + b"\0")

    def channel(self, name: str, byte: int, bits: int, kind=0, sync=0, data_type=0, bit=0, flags=0, invalid=0, conversion: tuple | None = None, unit: str = "", after: int = 0, part: int = 0) -> int:
        cc = 0
        if conversion:
            cc = self.block(b"##CC", [0] * 4, bytes([conversion[0]]) + bytes(5) + struct.pack("<H", len(conversion) - 1) + struct.pack(f"<{len(conversion) - 1}d", *conversion[1:]))
        body = bytes([kind, sync, data_type, bit]) + struct.pack("<IIII", byte, bits, flags, invalid) + bytes(4)
        return self.block(b"##CN", [after, part, self.text(name), 0, cc, 0, self.text(unit) if unit else 0, 0], body)

    def group(self, channel: int, size: int, cycles: int, name: str = "", flags: int = 0, record_id: int = 0, invalid: int = 0, after: int = 0) -> int:
        body = struct.pack("<QQH", record_id, cycles, flags) + bytes(6) + struct.pack("<II", size, invalid)
        return self.block(b"##CG", [after, channel, self.text(name) if name else 0, 0, 0, 0], body)

    def data_group(self, group: int, data: int, id_size: int = 0, after: int = 0) -> int:
        return self.block(b"##DG", [after, group, data, 0], bytes([id_size]) + bytes(7))

    def data(self, content: bytes) -> int:
        return self.block(b"##DT", [], content)

    def packed(self, content: bytes, row: int = 0) -> int:
        own = content
        if row:
            n = len(content) // row * row
            own = b"".join(content[k:n:row] for k in range(row)) + content[n:]
        packed = zlib.compress(own)
        return self.block(b"##DZ", [], b"DT" + bytes([1 if row else 0, 0]) + struct.pack("<IQQ", row, len(content), len(packed)) + packed)

    def listed(self, blocks: list[int]) -> int:
        return self.block(b"##DL", [0, *blocks], bytes(8))

    def attach(self, name: str, content: bytes) -> int:
        return self.block(b"##AT", [0, self.text(name), 0, 0], struct.pack("<H", 1) + bytes(22) + struct.pack("<QQ", len(content), len(content)) + content)

    def finish(self, first: int, attachment: int = 0) -> bytes:
        self.link(self.head, 0, first)
        self.link(self.head, 3, attachment)
        return bytes(self.out)
