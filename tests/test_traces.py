import random
import struct

import pytest

from tracelark.sources import asc, blf, mf4, text_lines, trc
from tracelark.sources.traces import Library, check_limit, open_dbc, open_trace, trace_type

from tracelark.sources import writers as w


def rows(frames, *columns):
    out = frames.orderBy("trace_id", "seq").select(*columns).collect()
    return [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in out]


ASC = """date Tue Apr 28 10:00:00.123 am 2026
base hex  timestamps absolute
Begin Triggerblock Tue Apr 28 10:00:01.5 2026
// comment
 0.000000 1  100             Rx   d 2 0a FF
 0.5 2  18FF0001x Tx d 1 7
 1 0 7ff - d 0
 1.25 1 ErrorFrame
 2.0 1 100 Rx r 4
 2.1 1 zz Rx d 1 00
 2.2 70000 100 Rx d 1 00
 2.3 1 100 Rx d 9 00 00 00 00 00 00 00 00 00
 2.4 1 100 Rx d 2 00
 2.5
 2.1234567891 1 100 Rx d 1 00
 3.0 CANFD 1 Rx 200 1 0 9 12 01 02 03 04 05 06 07 08 09 0a 0b 0c 5 6
 3.1 CANFD 2 Tx 201 Name 1 0 f 64 {data}
 3.2 CANFD 1 Rx 200 1 0 9 13 01
 3.3 1 100 Rx x
End TriggerBlock
""".replace("{data}", " ".join(["11"] * 64))


def test_asc_lines(spark, tmp_path):
    (tmp_path / "a.asc").write_text(ASC)
    frames, meta = asc.read(spark, str(tmp_path / "a.asc"))
    got = rows(frames, "timestamp_ns", "channel", "direction", "kind", "can_id", "is_extended", "is_fd", "dlc", "payload")
    assert got == [
        (0, 1, "rx", "data", 0x100, False, False, 2, b"\x0a\xff"),
        (500_000_000, 2, "tx", "data", 0x18FF0001, True, False, 1, b"\x07"),
        (1_000_000_000, None, "unknown", "data", 0x7FF, False, False, 0, b""),
        (1_250_000_000, 1, "unknown", "error", None, None, False, 0, None),
        (2_000_000_000, 1, "rx", "remote", 0x100, False, False, 4, None),
        (2_100_000_000, None, "unknown", "unknown", None, None, False, 0, None),
        (2_500_000_000, None, "unknown", "unknown", None, None, False, 0, None),
        (3_000_000_000, 1, "rx", "data", 0x200, False, True, 9, bytes(range(1, 13))),
        (3_100_000_000, 2, "tx", "data", 0x201, False, True, 15, b"\x11" * 64),
        (3_300_000_000, None, "unknown", "unknown", None, None, False, 0, None),
    ]
    m = meta.first()
    assert (m["measurement_start_ms"], m["valid_message_count"], m["skipped_line_count"], m["duration_ns"]) == (1777370401500, 5, 5, 3_100_000_000)


def test_asc_clocks_bases_and_dates(spark, tmp_path):
    (tmp_path / "r.asc").write_text("date Tue Apr 28 12:00:00.123 am 2026\nbase dec timestamps relative\n1.0 1 100 Rx d 1 255\nx\n0.5 1 100 Rx d 1 256\n0.25 1 2048 Rx d 1 010\n")
    frames, meta = asc.read(spark, str(tmp_path / "r.asc"))
    assert rows(frames, "timestamp_ns", "can_id", "is_extended", "payload") == [(1_000_000_000, 100, False, b"\xff"), (1_750_000_000, 2048, True, b"\x0a")]
    assert (meta.first()["measurement_start_ms"], meta.first()["skipped_line_count"]) == (1777334400123, 1)
    (tmp_path / "b.asc").write_text("base oct timestamps absolute\n")
    with pytest.raises(asc.TraceError):
        asc.read(spark, str(tmp_path / "b.asc"))


def test_asc_in_many_splits_keeps_order_and_clock(spark, tmp_path):
    n = 3000
    (tmp_path / "s.asc").write_text("base hex timestamps relative\n" + "".join(f"0.001 1 {i % 7:x} Rx d 1 {i % 256:02x}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        frames, _ = asc.read(spark, str(tmp_path / "s.asc"))
        assert text_lines.lines(spark, str(tmp_path / "s.asc")).rdd.getNumPartitions() > 1
        got = rows(frames, "timestamp_ns", "payload")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [((i + 1) * 1_000_000, bytes([i % 256])) for i in range(n)]


TRC2 = """;$FILEVERSION=2.1
;$STARTTIME=46141.6714340249528
;$COLUMNS=N,O,T,B,I,d,R,L,D
 1 10.000 DT 1 0100 Rx - 2 E8 03
 2 10.0 FD 2 18FF0001 Tx - 9 01 02 03 04 05 06 07 08 09 0A 0B 0C
 3 21 ER 1 - Rx - 0
 4 22 RR 1 0100 Rx - 4
 5 bad DT 1 0100 Rx - 1 00
 6 23 DT 1 0100 Rx - 9 00 00 00 00 00 00 00 00 00 00 00 00
 7 24 EV - x Rx - 0
 8 25 DT 1 01000 Rx - 1 00
"""
TRC1 = """;$FILEVERSION=1.1
 1) 0.100 Rx 0123 2 AA bb
 2) 1.5 1 Tx 18FF0001 - 3 01 02 03
 3) 2.0 Rx FFFFFFFF 4 00 00 00 00
 4) 3.0 Rx 0100 2 RTR
 5) 4 1 Rx 0100 12 00
 6) 5 1 Rx 0100 2 00
 7) 6 1 Rx zz
"""


def test_trc_versions(spark, tmp_path):
    (tmp_path / "a.trc").write_text(TRC2)
    frames, meta = trc.read(spark, str(tmp_path / "a.trc"))
    assert rows(frames, "timestamp_ns", "channel", "direction", "kind", "can_id", "is_extended", "is_fd", "dlc", "payload") == [
        (10_000_000, 1, "rx", "data", 0x100, False, False, 2, b"\xe8\x03"),
        (10_000_000, 2, "tx", "data", 0x18FF0001, True, True, 9, bytes(range(1, 13))),
        (21_000_000, 1, "rx", "error", None, None, False, 0, None),
        (22_000_000, 1, "rx", "remote", 0x100, False, False, 4, None),
        (24_000_000, None, "rx", "unknown", None, None, False, 0, None),
        (25_000_000, 1, "rx", "unknown", None, None, False, 0, None),
    ]
    assert (meta.first()["measurement_start_ms"], meta.first()["skipped_line_count"], meta.first()["valid_message_count"]) == (1777478811899, 2, 2)
    (tmp_path / "b.trc").write_text(TRC1)
    frames, meta = trc.read(spark, str(tmp_path / "b.trc"))
    assert rows(frames, "timestamp_ns", "channel", "direction", "kind", "can_id", "payload") == [
        (100_000, None, "rx", "data", 0x123, b"\xaa\xbb"), (1_500_000, 1, "tx", "data", 0x18FF0001, b"\x01\x02\x03"), (2_000_000, None, "rx", "error", None, None),
        (3_000_000, None, "rx", "remote", 0x100, None), (4_000_000, None, "unknown", "unknown", None, None), (6_000_000, None, "unknown", "unknown", None, None),
    ]
    for text in (";$FILEVERSION=3.0\n 1 1 DT\n", ";$FILEVERSION=2.0\n", ";$FILEVERSION=2.0\n;$COLUMNS=N,O,T,I,d,D\n", ";$FILEVERSION=2.0\n;$COLUMNS=N,Z\n"):
        (tmp_path / "c.trc").write_text(text)
        with pytest.raises(asc.TraceError):
            trc.read(spark, str(tmp_path / "c.trc"))


@pytest.mark.parametrize("compress", [True, False])
def test_blf_objects_over_containers(spark, tmp_path, compress):
    objects = [
        w.blf_object(1, 10, w.can_message(1, 0x100, b"\x01\x02")), w.blf_object(86, 20, w.can_message(2, 0x80000200, b"\x03", 1)),
        w.blf_object(1, 3, w.can_message(1, 0x101, b"", 0x80), flags=1), w.blf_object(100, 40, w.can_fd(3, 0x102, bytes(range(12)))),
        w.blf_object(101, 50, w.can_fd_64(4, 0x103, b"abc")), w.blf_object(7, 60, b"other"), w.blf_object(73, 70, struct.pack("<H", 1) + bytes(8) + b"\x02" + bytes(5) + struct.pack("<I", 0x7FF) + bytes(4) + b"xy" + bytes(6)),
    ]
    (tmp_path / "a.blf").write_bytes(w.blf(objects, 61, compress))
    t = open_trace(spark, str(tmp_path / "a.blf"))
    assert rows(t.frames, "timestamp_ns", "channel", "direction", "kind", "can_id", "is_extended", "is_fd", "payload_len", "payload") == [
        (10, 1, "rx", "data", 0x100, False, False, 2, b"\x01\x02"), (20, 2, "tx", "data", 0x200, True, False, 1, b"\x03"), (30_000, 1, "rx", "remote", 0x101, False, False, 0, None),
        (40, 3, "rx", "data", 0x102, False, True, 12, bytes(range(12))), (50, 4, "tx", "data", 0x103, False, True, 3, b"abc"), (70, 1, "unknown", "error", 0x7FF, False, False, 2, b"xy"),
    ]
    m = t.meta.first()
    assert (m["measurement_start_ms"], m["valid_message_count"], m["duration_ns"]) == (1777550400005, 4, 50)


def blf_objects(rng, n, misleading):
    """Objects of all kinds; misleading ones hold marks, and whole frames, in their data."""
    some = lambda most: bytes(rng.randrange(256) for _ in range(rng.randrange(most)))
    fake, out = w.blf_object(1, 5, w.can_message(1, 0x77, b"ab")), []
    for i in range(n):
        kind = rng.choice([1, 86, 100, 101, 73, 7])
        if misleading and i % 5 == 0:
            out.append(w.blf_object(7, i, b"LOBJ" * rng.randrange(9) + fake + some(50)))
        elif kind in (1, 86):
            out.append(w.blf_object(kind, i * 10, w.can_message(i % 4, i, some(9), rng.choice([0, 1, 0x80])), flags=rng.choice([1, 2])))
        elif kind == 100:
            out.append(w.blf_object(100, i * 10, w.can_fd(3, i, bytes(rng.choice([3, 12, 64])))))
        elif kind == 101:
            out.append(w.blf_object(101, i * 10, w.can_fd_64(4, i, some(5))))
        elif kind == 73:
            out.append(w.blf_object(73, i * 10, w.error_frame(1, i, b"xy")))
        else:
            out.append(w.blf_object(7, i, some(300)))
    return out


@pytest.mark.parametrize(("size", "compress", "misleading"), [(61, True, False), (61, False, False), (2000, True, False), (900, False, True), (1500, True, True), (40, True, True)])
def test_blf_files_in_splits_equal_one_task(spark, tmp_path, size, compress, misleading):
    data = w.blf(blf_objects(random.Random(size), 300, misleading), size, compress)
    (tmp_path / "a.blf").write_bytes(data)
    want = [(i, *f) for i, f in enumerate(blf.frames(data))]
    plain = lambda df: sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r[1:]) for r in df.collect())
    conf = {"spark.sql.files.maxPartitionBytes": "3k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 1
        assert plain(blf.read(spark, str(tmp_path))[0]) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = spark.createDataFrame([("a.blf", data)], "path string, content binary")
    frames, meta = blf.read_files(files)
    assert plain(frames) == want and meta.first()["valid_message_count"] == sum(f[4] == "data" for f in want)


def test_blf_faults_show_in_splits_too(spark, tmp_path):
    data = w.blf(blf_objects(random.Random(1), 60, False), 500)
    for i, bad in enumerate((b"LOGX" + data[4:], data[:-3], data + b"LOBJ", data + bytes(30), data[: len(data) // 2], w.blf([w.blf_object(1, 1, w.can_message(1, 0x900, b""))]))):
        (tmp_path / f"{i}.blf").write_bytes(bad)
        with pytest.raises(asc.TraceError) as one:
            list(blf.frames(bad))
        with pytest.raises(Exception, match=str(one.value)):
            blf.read(spark, str(tmp_path / f"{i}.blf"))[0].count()
    with pytest.raises(Exception, match="exceeds 700 bytes"):
        blf.read_files(spark.createDataFrame([("a", data)], "path string, content binary"), 700)[0].count()


def test_blf_faults():
    good = w.blf([w.blf_object(1, 10, w.can_message(1, 0x100, b"\x01"))])
    assert len(list(blf.frames(good))) == 1
    for bad in (b"LOGX" + good[4:], good[:-3], w.blf([w.blf_object(1, 10, w.can_message(1, 0x100, b"\x01"))[:-4]])):
        with pytest.raises(asc.TraceError):
            list(blf.frames(bad))
    with pytest.raises(asc.TraceError):
        list(blf.frames(good, 10))


def can_group(m: w.Mf4, flags: int = 2, **more) -> int:
    at = 0
    for name, byte, bits, extra in (("DataBytes", 12, 64, {"data_type": 10}), ("BusChannel", 11, 8, {}), ("DataLength", 10, 8, {}), ("DLC", 9, 8, {}), ("IDE", 8, 1, {}), ("ID", 4, 29, {})):
        at = m.channel(f"CAN_DataFrame.{name}", byte, bits, after=at, **extra)
    frame = m.channel("CAN_DataFrame", 4, 128, data_type=10, part=at)
    time = m.channel("Timestamp", 0, 32, kind=2, sync=1, conversion=(1, 0.0, 1e-6), after=frame)
    return m.group(time, 20, 3, flags=flags, **more)


RECORDS = b"".join(struct.pack("<IIBBBB", us, can_id, ide, 8, n, 1) + data.ljust(8, b"\0") for us, can_id, ide, n, data in ((100, 0x100, 0, 2, b"\x01\x02"), (50, 0x18FF0001, 1, 1, b"\x03"), (300, 0x100, 0, 0, b"")))


@pytest.mark.parametrize("pack", [0, 1, 20])
def test_mf4_frames(spark, tmp_path, pack):
    m = w.Mf4(1777550400000 * 1_000_000)
    data = m.data(RECORDS) if pack == 0 else m.packed(RECORDS, pack if pack > 1 else 0)
    group = can_group(m)
    (tmp_path / "a.mf4").write_bytes(m.finish(m.data_group(group, data), m.attach("c:\\x\\bus.dbc", b"BO_ 1 A: 8 X\n")))
    t = open_trace(spark, str(tmp_path / "a.mf4"))
    assert rows(t.frames, "timestamp_ns", "channel", "kind", "can_id", "is_extended", "payload") == [(100_000, 1, "data", 0x100, False, b"\x01\x02"), (50_000, 1, "data", 0x18FF0001, True, b"\x03"), (300_000, 1, "data", 0x100, False, b"")]
    assert t.meta.first()["measurement_start_ms"] == 1777550400000 and t.meta.first()["duration_ns"] == 300_000
    own = mf4.read_databases(spark, str(tmp_path / "a.mf4")).first()
    assert own["name"] == "bus.dbc" and open_dbc(bytes(own["bytes"])).messages[0].name == "A"


def test_mf4_native_channels_unsorted_with_invalid_samples_and_absolute_clock(spark, tmp_path):
    m = w.Mf4()
    table = m.channel("Gear", 16, 8, conversion=(5, 0.0, 10.0, 2.0, 20.0), unit="g")
    volt = m.channel("Volt", 8, 64, data_type=4, flags=2, invalid=1, unit="V", after=table)
    signed = m.channel("Turn", 16, 4, data_type=2, bit=4, after=volt)
    time = m.channel("t", 0, 64, kind=2, sync=1, data_type=4, after=signed)
    native = m.group(time, 17, 3, "Engine", record_id=7, invalid=1)
    group = can_group(m, record_id=9, after=native)
    recs = [(2e8 + 1.0, 5.0, 0x12, 0), (2e8, 7.0, 0xF0, 0), (2e8 + 0.5, 9.0, 0x01, 2)]
    own = [b"\x07" + struct.pack("<ddBB", *r) for r in recs]
    data = m.data(own[0] + b"\x09" + RECORDS[:20] + own[1] + own[2])
    (tmp_path / "n.mf4").write_bytes(m.finish(m.data_group(group, data, 1)))
    path = str(tmp_path / "n.mf4")
    got = mf4.read_catalog(spark, path).orderBy("id").collect()
    assert [(r["group_name"], r["id"], r["name"], r["unit"]) for r in got] == [("Engine", 0, "Turn", ""), ("Engine", 1, "Volt", "V"), ("Engine", 2, "Gear", "g")]
    series = lambda i: [(r["time_ms"], r["value"]) for r in mf4.read_channel(spark, path, i).orderBy("seq").collect()]
    assert series(1) == [(0.0, 7.0), (1000.0, 5.0)]
    assert series(0) == [(0.0, -1.0), (500.0, 0.0), (1000.0, 1.0)]
    assert series(2) == [(0.0, 20.0), (500.0, 10.0), (1000.0, 20.0)]
    t = open_trace(spark, path)
    assert rows(t.frames, "timestamp_ns", "can_id") == [(100_000, 0x100)] and t.meta.first()["duration_ns"] == 1_000_000_000


def in_blocks(m, content, sizes):
    """A list of plain, packed and transposed blocks of the sizes, whatever records they cut."""
    at, links = 0, []
    for i, n in enumerate([*sizes, len(content)]):
        part = content[at : at + n]
        links += [m.data(part) if i % 3 == 0 else m.packed(part) if i % 3 == 1 else m.packed(part, 7)] if part else []
        at += n
    half = len(links) // 2
    later = m.block(b"##DL", [0, *links[half:]], bytes(8))
    return m.block(b"##HL", [m.block(b"##DL", [later, *links[:half]], bytes(8))], bytes(8))


@pytest.mark.parametrize(("ids", "start"), [(0, 0.0), (0, 3e8), (1, 3e8)])
def test_mf4_blocks_may_cut_records(spark, tmp_path, ids, start):
    rng = random.Random(ids)
    records, stamps = [], []
    for i in range(400):
        stamps.append(start + (i if i % 10 else i - 3) * 0.5)
        records.append(struct.pack("<ddBB", stamps[-1], i * 1.5 if i % 50 else float("nan"), i % 256, 2 if i % 31 == 0 else 0))
    frames = [RECORDS[k * 20 : k * 20 + 20] for k in range(len(RECORDS) // 20)]
    for name, sizes in (("one", []), ("many", [rng.randrange(1, 60) for _ in range(70)])):
        m = w.Mf4()
        value = m.channel("Value", 8, 64, data_type=4, unit="V")
        count = m.channel("Count", 16, 8, flags=2, invalid=1, after=value)
        time = m.channel("t", 0, 64, kind=2, sync=1, data_type=4, after=count)
        native = m.group(time, 17, 390, "Own", record_id=7, invalid=1)
        if ids:
            group = can_group(m, record_id=9, after=native)
            stream = b"".join(b"\x07" + r + (b"\x09" + frames[i // 100 % len(frames)] if i % 100 == 0 else b"") for i, r in enumerate(records))
            last = m.data_group(group, in_blocks(m, stream, sizes), 1)
        else:
            other = m.data_group(can_group(m), in_blocks(m, RECORDS, sizes[:3]))
            last = m.data_group(native, in_blocks(m, b"".join(records), sizes), 0, other)
        (tmp_path / f"{name}.mf4").write_bytes(m.finish(last))
    got = {}
    for name in ("one", "many"):
        path = str(tmp_path / f"{name}.mf4")
        t = open_trace(spark, path)
        got[name] = [tuple(r)[1:] for r in mf4.read_channels(spark, path, [0, 1]).orderBy("id", "seq").collect()], [tuple(r)[2:] for r in t.frames.orderBy("seq").collect()], tuple(t.meta.first())[2:]
    assert got["one"] == got["many"] and len(got["one"][1]) == (4 if ids else 3)
    n = 400 if ids else 390  # only records with ids are not counted
    want = sorted((s, i) for i, s in enumerate(stamps[:n]))
    origin = min(stamps[:n]) if start else 0.0
    ids_of = {r["name"]: r["id"] for r in mf4.read_catalog(spark, str(tmp_path / "one.mf4")).collect()}
    series = lambda k: [(r[2], r[3]) for r in got["one"][0] if r[0] == ids_of[k]]
    assert [v for _, v in series("Value")] == [i * 1.5 for _, i in want if i % 50]
    assert [v for _, v in series("Count")] == [float(i % 256) for _, i in want if i % 31]
    assert [t for t, _ in series("Count")] == pytest.approx([(s - origin) * 1000 for s, i in want if i % 31])


def test_mf4_faults():
    for bad in (b"UnFinMF " + bytes(100), b"MDF     3.30" + bytes(100), b"x"):
        with pytest.raises(asc.TraceError):
            mf4.File(bad)


def test_types_limits_and_library(spark, tmp_path):
    assert [trace_type(x) for x in ("a.ASC", "b.trc", "c.Blf", "d.mf4", "asc", "e.txt")] == ["asc", "trc", "blf", "mf4", None, None]
    with pytest.raises(ValueError):
        open_trace(spark, "x.csv")
    for bad in (0, 1 << 32, 1.5, True):
        with pytest.raises(ValueError):
            check_limit(bad)
    with pytest.raises(ValueError):
        open_dbc(b"x" * 20, 10)
    lib = Library(spark, str(tmp_path / "lib"))
    assert lib.rows().count() == 0
    data = b"BO_ 1 A: 8 X\n"
    ids = lib.put([("a.dbc", data), ("b.dbc", data)])
    assert lib.put([("c.dbc", data)]) == ids and lib.rows().count() == 1 and lib.get(ids[0]).messages[0].name == "A"
    with pytest.raises(ValueError):
        lib.put([("d.dbc", b"BO_ 2 B: 8 X\n"), ("bad.dbc", b" SG_ x\n")])
    assert lib.rows().count() == 1
