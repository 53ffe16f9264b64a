"""Messages and signals of a database, as the driver compiles them; they emit Spark expressions and catalogue rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import bits

#: Largest payload of a raw frame.
MOST_BYTES = 64


class PlanError(ValueError):
    """A signal that cannot be decoded from raw frames."""


@dataclass(frozen=True)
class Multiplex:
    """A signal is present while its selector's raw unsigned value is in one of the inclusive ranges."""

    selector: str
    ranges: tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Signal:
    name: str
    start_bit: int
    bit_length: int
    little_endian: bool = True
    signed: bool = False
    factor: float = 1.0
    offset: float = 0.0
    minimum: float = 0.0
    maximum: float = 0.0
    unit: str = ""
    receivers: tuple[str, ...] = ()
    value_type: str = "integer"  # integer, float32, float64
    is_multiplexer: bool = False
    multiplex: Multiplex | None = None
    value_descriptions: tuple[tuple[int, str], ...] = ()

    def fault(self, size_bytes: int) -> str | None:
        """Why the layout cannot be decoded, or None."""
        n = self.bit_length
        if self.value_type == "integer":
            if n > 64:
                return "integers wider than 64 bits are not supported"
        elif n != (32 if self.value_type == "float32" else 64):
            return f"a {self.value_type} signal cannot have {n} bits"
        if n < 1:
            return "a signal needs at least one bit"
        if self.little_endian:
            last = self.start_bit + n - 1
        else:
            last = self.start_bit // 8 * 8 + 7 - self.start_bit % 8 + n - 1
        if self.start_bit >= 8 * size_bytes or last >= 8 * size_bytes:
            return "the signal does not fit its message"
        return None

    def raw(self, payload: Column) -> Column:
        """The unsigned wire value as a 64-bit pattern."""
        return (bits.intel if self.little_endian else bits.motorola)(payload, self.start_bit, self.bit_length)

    def value(self, payload: Column) -> Column:
        """The physical value: raw * factor + offset, rounded after each step."""
        raw = self.raw(payload)
        if self.value_type != "integer":
            number = bits.ieee754(raw, self.bit_length)
        elif self.signed:
            number = bits.sign_extend(raw, self.bit_length).cast("double")
        else:
            number = bits.unsigned_to_double(raw, self.bit_length)
        return number * F.lit(float(self.factor)) + F.lit(float(self.offset))


@dataclass(frozen=True)
class Message:
    dbc_id: int
    can_id: int
    is_extended: bool
    name: str
    size_bytes: int
    signals: tuple[Signal, ...] = ()
    is_fd: bool = False
    frame_format: str | None = None  # None: not stated; else classic or fd
    raw_frame_decodable: bool = True
    transmitter: str = ""
    is_j1939: bool = False
    absent: tuple[str, ...] = field(default=())  # signals left out of the catalogue

    @property
    def identity(self) -> tuple[int, bool, int]:
        return self.can_id, self.is_extended, self.size_bytes

    def j1939(self) -> tuple[int, int, int] | None:
        """pgn, source address, priority."""
        if not self.is_j1939:
            return None
        pdu = self.can_id >> 16 & 0xFF
        pgn = self.can_id >> 8 & 0x3FFFF
        return (pgn & 0x3FF00 if pdu < 240 else pgn), self.can_id & 0xFF, self.can_id >> 26 & 7

    def signal(self, name: str) -> Signal | None:
        return next((s for s in self.signals if s.name == name), None)

    def selectors(self, signal: Signal) -> list[tuple[Signal, tuple[tuple[int, int], ...]]]:
        """The chain of selectors from the root to the signal, each with the ranges it must be in."""
        chain, now, seen = [], signal, set()
        while now.multiplex is not None:
            selector = self.signal(now.multiplex.selector)
            if selector is None or selector.name in seen:
                raise PlanError(f"{signal.name} has no valid chain of selectors")
            seen.add(selector.name)
            chain.append((selector, now.multiplex.ranges))
            now = selector
        return chain[::-1]

    def check(self, signal: Signal) -> None:
        if not self.raw_frame_decodable:
            raise PlanError(f"{self.name} is sent over several frames: plotting is not yet supported")
        if self.size_bytes > MOST_BYTES:
            raise PlanError(f"{self.name} is larger than a frame")
        if fault := signal.fault(self.size_bytes):
            raise PlanError(f"{self.name}.{signal.name}: {fault}")
        for selector, _ in self.selectors(signal):
            if fault := selector.fault(self.size_bytes):
                raise PlanError(f"{self.name}.{selector.name}: {fault}")

    def carries(self, is_fd: Column, payload_len: Column) -> Column:
        """Whether a frame can carry this message: FD frames by exact length, classic ones may be padded."""
        fits = F.when(is_fd, payload_len == self.size_bytes).otherwise((payload_len >= self.size_bytes) & (F.lit(self.is_fd) | (payload_len <= 8)))
        if self.frame_format is not None:
            fits = (is_fd == F.lit(self.frame_format == "fd")) & fits
        return fits

    def active(self, signal: Signal, payload: Column) -> Column:
        """Every selector on the way has a raw value in one of its ranges; scaling plays no part."""
        out = F.lit(True)
        for selector, ranges in self.selectors(signal):
            raw = selector.raw(payload)
            inside = F.lit(False)
            for low, high in ranges:
                inside = inside | (bits.unsigned_between(raw, low, high) if selector.bit_length >= 64 else raw.between(low, min(high, (1 << 63) - 1)))
            out = out & inside
        return out


@dataclass(frozen=True)
class Diagnostic:
    category: str  # unsupported-record, dangling-reference, omitted-feature
    keyword: str
    line: int
    column: int
    message: str


@dataclass(frozen=True)
class Database:
    messages: tuple[Message, ...]
    warnings: tuple[Diagnostic, ...] = ()

    def find(self, can_id: int, is_extended: bool, size_bytes: int, name: str) -> tuple[Message, Signal]:
        """The first message of that identity that has the signal."""
        for m in self.messages:
            if m.identity == (can_id, is_extended, size_bytes) and (s := m.signal(name)) is not None:
                return m, s
        raise PlanError("Signal not found in DBC")
