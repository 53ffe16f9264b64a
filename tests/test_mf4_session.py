"""A session over an MF4 recording: its native signals and the databases embedded in it."""

import struct

import pytest

from tracelark.session import Session

from tracelark.sources import writers as w
from .test_traces import RECORDS, can_group

BUS = b'BO_ 256 Motor: 2 E\n SG_ Low : 0|8@1+ (1,0) [0|0] "V" X\n'


def recording(path, database: bytes) -> str:
    m = w.Mf4()
    volt = m.channel("Volt", 8, 64, data_type=4, unit="V")
    time = m.channel("t", 0, 64, kind=2, sync=1, data_type=4, after=volt)
    native = m.data_group(m.group(time, 16, 3, "Engine"), m.data(b"".join(struct.pack("<dd", t, v) for t, v in ((0.5, 7.0), (0.0, 5.0), (1.0, 9.5)))))
    path.write_bytes(m.finish(m.data_group(can_group(m), m.data(RECORDS), after=native), m.attach("bus.dbc", database)))
    return str(path)


def test_native_signals_and_embedded_databases(spark, tmp_path):
    s = Session(spark)
    s.open_trace(recording(tmp_path / "a.mf4", BUS))
    assert s.database_fault is None and list(s.databases) == ["mf4:0:bus.dbc"]
    assert {r["label"]: r["unavailable_reason"] for r in s.catalog().collect()} == {"Motor.Low": None, "Engine.Volt": None}
    assert [r["label"] for r in s.search("engine volt")["results"]] == ["Engine.Volt"] and [r["label"] for r in s.search("0x100")["results"]] == ["Motor.Low"]
    assert len(s.select(["Engine.Volt", "Motor.Low"])["changed"]) == 2
    key = {x.label: k for k, x in s.selected.items()}
    got = {(r["signal_key"], r["time_ms"], r["value"]) for r in s.series().collect()}
    assert got == {(key["Engine.Volt"], 0.0, 5.0), (key["Engine.Volt"], 500.0, 7.0), (key["Engine.Volt"], 1000.0, 9.5), (key["Motor.Low"], 0.1, 1.0)}
    seen = s.inspect([400.0, 1000.0], [key["Engine.Volt"]])
    assert [(r["sample_ms"], r["text"]) for r in seen] == [(500.0, "7 V"), (1000.0, "9.5 V")] and seen[1]["delta_value"] == 2.5
    s.close()
    assert s.databases == {} and s.selected == {}


def test_an_unreadable_embedded_database_leaves_the_recording_open(spark, tmp_path):
    s = Session(spark)
    s.open_trace(recording(tmp_path / "b.mf4", b"BO_ x\n"))
    assert s.database_fault and s.databases == {}
    assert [r["label"] for r in s.catalog().collect()] == ["Engine.Volt"]
    with pytest.raises(ValueError):
        s.inspect([float("nan")])
    s.close()
