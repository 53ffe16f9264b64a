"""Bit slices of binary payloads as Spark expressions, without Python in the row path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Payload length for each DLC of a CAN FD frame (fixed values).
FD_LENGTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 20, 24, 32, 48, 64)


def big_endian(payload: Column, first: int, n: int) -> Column:
    """The bit pattern of up to 8 bytes from byte ``first`` on, most significant byte first."""
    return F.conv(F.hex(F.substring(payload, first + 1, n)), 16, -10).cast("bigint")


def little_endian(payload: Column, first: int, n: int) -> Column:
    """The bit pattern of up to 8 bytes, least significant byte first. The bytes are read once and moved by shifts."""
    word = big_endian(payload, first, n)
    if n == 1:
        return word
    out = None
    for j in range(n):
        byte = F.shiftrightunsigned(word, 8 * (n - 1 - j)).bitwiseAND(F.lit(255)) if j < n - 1 else word.bitwiseAND(F.lit(255))
        part = F.shiftleft(byte.cast("bigint"), 8 * j) if j else byte
        out = part if out is None else out.bitwiseOR(part)
    return out


def _mask(value: Column, bits: int) -> Column:
    return value if bits >= 64 else value.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def intel(payload: Column, start: int, bits: int) -> Column:
    """Unsigned slice whose least significant bit is bit ``start`` of the little-endian payload, as a 64-bit pattern."""
    first, shift = divmod(start, 8)
    n = (shift + bits + 7) // 8
    low = little_endian(payload, first, min(n, 8))
    raw = F.shiftrightunsigned(low, shift) if shift else low
    if n == 9:
        raw = raw.bitwiseOR(F.shiftleft(big_endian(payload, first + 8, 1), 64 - shift))
    return _mask(raw, bits)


def motorola(payload: Column, start: int, bits: int) -> Column:
    """Unsigned slice whose most significant bit is bit ``start`` (byte * 8 + bit), as a 64-bit pattern."""
    msb = start // 8 * 8 + 7 - start % 8
    last = msb + bits - 1
    first, n, shift = msb // 8, last // 8 - msb // 8 + 1, 7 - last % 8
    if n == 9:
        low = big_endian(payload, first + 1, 8)
        raw = F.shiftrightunsigned(low, shift).bitwiseOR(F.shiftleft(big_endian(payload, first, 1), 64 - shift)) if shift else low
    else:
        word = big_endian(payload, first, n)
        raw = F.shiftrightunsigned(word, shift) if shift else word
    return _mask(raw, bits)


def sign_extend(raw: Column, bits: int) -> Column:
    return raw if bits >= 64 else F.shiftright(F.shiftleft(raw, 64 - bits), 64 - bits)


def unsigned_to_double(raw: Column, bits: int) -> Column:
    """The value of an unsigned pattern, rounded once; patterns of 2^63 and more are negative as a bigint."""
    if bits < 64:
        return raw.cast("double")
    half = F.shiftrightunsigned(raw, 1).bitwiseOR(raw.bitwiseAND(F.lit(1).cast("bigint")))
    return F.when(raw < 0, F.lit(2.0) * half.cast("double")).otherwise(raw.cast("double"))


def unsigned_between(raw: Column, low: int, high: int) -> Column:
    """low <= raw <= high for an unsigned 64-bit pattern and bounds up to 2^64 - 1."""
    flipped = raw.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))
    return flipped.between(F.lit(low - (1 << 63)).cast("bigint"), F.lit(high - (1 << 63)).cast("bigint"))


def ieee754(raw: Column, bits: int) -> Column:
    """The IEEE 754 number of 32 or 64 bits, by arithmetic that is exact for every pattern."""
    man_bits, bias, top = (23, 127, 255) if bits == 32 else (52, 1023, 2047)
    exponent = F.shiftrightunsigned(raw, man_bits).bitwiseAND(F.lit(top).cast("bigint"))
    mantissa = raw.bitwiseAND(F.lit((1 << man_bits) - 1).cast("bigint"))
    negative = F.shiftrightunsigned(raw, bits - 1).bitwiseAND(F.lit(1).cast("bigint")) == 1
    whole = (mantissa + F.lit(1 << man_bits).cast("bigint")).cast("double")
    size = (
        F.when(exponent == top, F.when(mantissa == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
        .when(exponent == 0, mantissa.cast("double") * F.pow(F.lit(2.0), F.lit(float(1 - bias - man_bits))))
        .otherwise(whole * F.pow(F.lit(2.0), (exponent - (bias + man_bits)).cast("double")))
    )
    return F.when(negative, -size).otherwise(size)


def fd_length(dlc: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in FD_LENGTHS]), dlc.cast("int"))


def j1939(can_id: Column) -> dict[str, Column]:
    """pgn, source address and priority of a 29-bit identifier; PDU1 formats carry a destination, which is no part of the pgn."""
    at = lambda shift, mask: F.shiftright(can_id, shift).bitwiseAND(F.lit(mask))
    pgn = at(8, 0x3FFFF)
    pgn = F.when(at(16, 0xFF) < 240, pgn.bitwiseAND(F.lit(0x3FF00))).otherwise(pgn)
    return {"pgn": pgn.cast("int"), "source_address": can_id.bitwiseAND(F.lit(0xFF)).cast("int"), "priority": at(26, 7).cast("int")}
