import random
import struct

import pytest
from pyspark.sql import functions as F

from tracelark.functions import bits
from tracelark.plans.model import Message, Multiplex, Signal


def slice_of(data: bytes, start: int, n: int, little: bool) -> int:
    if little:
        return int.from_bytes(data, "little") >> start & (1 << n) - 1
    msb = start // 8 * 8 + 7 - start % 8
    return int.from_bytes(data, "big") >> (8 * len(data) - msb - n) & (1 << n) - 1


def test_slices_of_every_kind_equal_integer_arithmetic(spark):
    rng = random.Random(7)
    payloads = [rng.randbytes(16) for _ in range(6)] + [b"\xff" * 16, bytes(16), b"\x80" + bytes(14) + b"\x01"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, payload binary")
    cases = []
    for _ in range(60):
        n, little = rng.choice([1, 3, 8, 12, 16, 31, 32, 33, 63, 64]), rng.random() < 0.5
        start = rng.randrange(0, 128 - n) if little else None
        if start is None:
            msb = rng.randrange(0, 128 - n)
            start = msb // 8 * 8 + 7 - msb % 8
        cases.append((start, n, little, rng.random() < 0.5))
    columns = []
    for k, (start, n, little, signed) in enumerate(cases):
        s = Signal(f"s{k}", start, n, little, signed, 1.0, 0.0)
        columns += [s.raw(F.col("payload")).alias(f"r{k}"), s.value(F.col("payload")).alias(f"v{k}")]
    for row in df.select("i", *columns).collect():
        for k, (start, n, little, signed) in enumerate(cases):
            raw = slice_of(payloads[row["i"]], start, n, little)
            assert row[f"r{k}"] & (1 << 64) - 1 == raw
            assert row[f"v{k}"] == float(raw - (1 << n) if signed and raw >> (n - 1) else raw)


def test_floats_of_every_kind(spark):
    doubles = [0.0, -0.0, 1.5, -2.25, 5e-324, 1.7976931348623157e308, float("inf"), float("-inf"), 2.2250738585072014e-308, 0.1]
    singles = [0.0, 1.5, -0.1, 1e-45, 3.4028235e38, float("inf"), -1.1754944e-38]
    df = spark.createDataFrame([(struct.pack("<d", d) + struct.pack(">f", singles[i % len(singles)]),) for i, d in enumerate(doubles)], "payload binary")
    wide, narrow = Signal("a", 0, 64, True, value_type="float64"), Signal("b", 71, 32, False, value_type="float32")
    for i, row in enumerate(df.select(wide.value(F.col("payload")).alias("a"), narrow.value(F.col("payload")).alias("b")).collect()):
        assert row["a"] == doubles[i]
        assert row["b"] == struct.unpack(">f", struct.pack(">f", singles[i % len(singles)]))[0]
    nan = spark.createDataFrame([(struct.pack("<d", float("nan")),)], "payload binary").select(wide.value(F.col("payload")).alias("a")).first()
    assert nan["a"] != nan["a"]


def test_unsigned_bounds_reach_two_to_the_64(spark):
    df = spark.createDataFrame([(0,), (5,), (-1,), (-(1 << 63),)], "x long")
    got = df.select(bits.unsigned_between(F.col("x"), 1 << 63, (1 << 64) - 1).alias("b")).collect()
    assert [r["b"] for r in got] == [False, False, True, True]


def test_layouts_are_checked():
    assert Signal("s", 0, 65).fault(16) and Signal("s", 0, 16, value_type="float32").fault(8) and Signal("s", 60, 8).fault(8)
    assert Signal("s", 7, 16, False).fault(2) is None and Signal("s", 0, 16, False).fault(2)


def test_j1939_parts(spark):
    m = Message(2565489024, 2565489024 & 0x1FFFFFFF, True, "M", 8, is_j1939=True)
    assert m.j1939() == (59904, 128, 6)
    row = spark.createDataFrame([(m.can_id,)], "i int").select(*[c.alias(k) for k, c in bits.j1939(F.col("i")).items()]).first()
    assert tuple(row) == (59904, 128, 6)


@pytest.mark.parametrize(("fd", "n", "fits"), [(False, 8, True), (False, 4, True), (False, 3, False), (True, 4, True), (True, 8, False), (False, 12, False)])
def test_carry(spark, fd, n, fits):
    m = Message(1, 1, False, "M", 4)
    assert spark.range(1).select(m.carries(F.lit(fd), F.lit(n)).alias("c")).first()["c"] is fits


def test_selectors_compare_raw_values(spark):
    root = Signal("R", 0, 8, factor=10.0, offset=7.0, signed=True, is_multiplexer=True)
    leaf = Signal("L", 8, 8, multiplex=Multiplex("R", ((200, 255), (3, 3))))
    m = Message(1, 1, False, "M", 2, (root, leaf))
    df = spark.createDataFrame([(bytes([x, 1]),) for x in (2, 3, 199, 200, 255)], "payload binary")
    assert [r[0] for r in df.select(m.active(leaf, F.col("payload"))).collect()] == [False, True, False, True, True]
