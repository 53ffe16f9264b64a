"""Layouts of signals as rows: for decoding by a table of plans, and for questions in SQL."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .model import Message, Signal

SCHEMA = (
    "key string, can_id int, is_extended boolean, size_bytes int, is_fd boolean, frame_format string, start_bit int, bit_length int, little_endian boolean, signed boolean, value_type string, "
    "factor double, offset double, minimum double, maximum double, unit string, labels array<struct<raw_value: bigint, label: string>>, "
    "chain array<struct<start_bit: int, bit_length: int, little_endian: boolean, ranges: array<struct<first: bigint, last: bigint>>>>"
)


def _flipped(x: int) -> int:
    """An unsigned 64-bit number as a signed one of the same order."""
    return x - (1 << 63)


def rows(spark: SparkSession, wanted: Iterable[tuple[str, Message, Signal]]) -> DataFrame:
    """One row for each (key, message, signal). Ranges of selectors are unsigned numbers less 2**63, so that they compare as signed ones."""
    out = []
    for key, m, s in wanted:
        m.check(s)
        chain = [(c.start_bit, c.bit_length, c.little_endian, [(_flipped(a), _flipped(b)) for a, b in ranges]) for c, ranges in m.selectors(s)]
        labels = [(r, t) for r, t in s.value_descriptions]
        out.append((key, m.can_id, m.is_extended, m.size_bytes, m.is_fd, m.frame_format, s.start_bit, s.bit_length, s.little_endian, s.signed, s.value_type, float(s.factor), float(s.offset), float(s.minimum), float(s.maximum), s.unit, labels, chain))
    return spark.createDataFrame(out, SCHEMA)


def raw(cells: np.ndarray, s: Signal) -> np.ndarray:
    """The unsigned wire values of a matrix with a payload in each row."""
    if s.little_endian:
        first, shift = divmod(s.start_bit, 8)
        n = (shift + s.bit_length + 7) // 8
        own = cells[:, first : first + n]
    else:
        msb = s.start_bit // 8 * 8 + 7 - s.start_bit % 8
        last = msb + s.bit_length - 1
        first, n, shift = msb // 8, last // 8 - msb // 8 + 1, 7 - last % 8
        own = cells[:, first : first + n][:, ::-1]
    out = np.zeros(len(cells), np.uint64)
    for j in range(min(n, 8)):
        out |= own[:, j].astype(np.uint64) << np.uint64(8 * j)
    out >>= np.uint64(shift)
    if n == 9:
        out |= own[:, 8].astype(np.uint64) << np.uint64(64 - shift)
    return out if s.bit_length == 64 else out & np.uint64((1 << s.bit_length) - 1)


def value(cells: np.ndarray, s: Signal) -> np.ndarray:
    """The physical values, rounded after the product and after the sum."""
    bits = raw(cells, s)
    if s.value_type == "float32":
        x = bits.astype(np.uint32).view(np.float32).astype(np.float64)
    elif s.value_type == "float64":
        x = bits.view(np.float64)
    elif s.signed:
        x = ((bits << np.uint64(64 - s.bit_length)).view(np.int64) >> np.int64(64 - s.bit_length)).astype(np.float64)
    else:
        x = bits.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        return x * float(s.factor) + float(s.offset)


def carried(m: Message, is_fd: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which frames can carry the message."""
    fits = np.where(is_fd, length == m.size_bytes, (length >= m.size_bytes) & (m.is_fd | (length <= 8)))
    return fits if m.frame_format is None else fits & (is_fd == (m.frame_format == "fd"))


def active(cells: np.ndarray, m: Message, s: Signal) -> np.ndarray:
    """Where every selector on the way to the signal is in one of its ranges."""
    out = np.ones(len(cells), bool)
    for selector, ranges in m.selectors(s):
        own = raw(cells, selector)
        inside = np.zeros(len(cells), bool)
        for low, high in ranges:
            inside |= (own >= np.uint64(low)) & (own <= np.uint64(min(high, (1 << 64) - 1)))
        out &= inside
    return out
