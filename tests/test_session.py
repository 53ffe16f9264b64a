import pytest

from tracelark.session import Session
from tracelark.sources import dbc
from tracelark.streaming import frames as streams

DBC = """BO_ 256 Motor: 4 E
 SG_ Speed : 0|16@1+ (0.5,0) [0|100] "km/h" X
 SG_ Mode : 16|8@1+ (1,0) [0|0] "" X
BO_ 257 Quiet: 1 E
 SG_ Level : 0|8@1+ (1,0) [0|0] "V" X
VAL_ 256 Mode 0 "off" 1 "on" ;
"""
ASC = "base hex timestamps absolute\n" + "".join(f"{i * 0.1:.6f} {1 + i % 2} 100 {'Rx' if i % 2 == 0 else 'Tx'} d 4 {i:02x} 00 {i // 5 % 2:02x} 00\n" for i in range(40))


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("s") / "a.asc"
    path.write_text(ASC)
    s = Session(spark)
    s.add_database("f", dbc.parse(DBC))
    s.open_trace(str(path))
    yield s
    s.close()


def test_catalogue_search_and_selection(session):
    labels = {r["label"]: r["unavailable_reason"] for r in session.catalog().collect()}
    assert labels == {"Motor.Speed [Channel 1 · Rx]": None, "Motor.Speed [Channel 2 · Tx]": None, "Motor.Mode [Channel 1 · Rx]": None, "Motor.Mode [Channel 2 · Tx]": None, "Quiet.Level": "Not present in this trace"}
    hits = session.search("0x100 channel speed", 1)
    assert (hits["truncated"], len(hits["results"])) == (True, 1)
    out = session.select(["motor.speed [channel 1 · rx]", "Motor.Mode [Channel 2 · Tx]", "Quiet.Level", "nothing"])
    assert (len(out["changed"]), len(out["unavailable"]), out["missing"]) == (2, 1, ["nothing"])


def test_inspection_markers_window_and_plot(session):
    speed, mode = list(session.selected)
    rows = session.inspect([0.0, 450.0, 99_999.0])
    assert [(r["sample_ms"], r["text"], r["outside"]) for r in rows[:3]] == [(0.0, "0 km/h", False), (400.0, "2.0 km/h", False), (3800.0, "19.0 km/h", True)]
    assert rows[1]["delta_value"] == 2.0 and [r["text"] for r in rows[3:]] == ["off", "on", "on"] and rows[4]["delta_value"] is None
    session.set_markers(c1=0.0, c2=1000.0)
    assert session.readout()[0]["delta"] == 5.0 and session.readout()[1]["delta"] is None
    assert session.set_window(1000.0, 99_999.0) == {"window": (1000.0, 3900.0)} and "error" in session.set_window(9e9, 9e10)
    assert session.plot(10).count() == 20
    with pytest.raises(ValueError):
        session.set_axes({speed: "y2", mode: "y9"})
    session.set_axes({speed: "y2"})
    axes = {r["axis"]: (r["unit"], r["y_min"], r["y_max"]) for r in session.axes().collect()}
    assert axes == {"y1": (None, 0.0, 1.0), "y2": ("km/h", 0.0, 19.0)}
    assert session.describe()["trace"][0]["valid_message_count"] == 40
    with pytest.raises(ValueError):
        session.inspect([float("nan")])


def test_streams_decode_and_keep_clocks(spark, tmp_path):
    (tmp_path / "a.asc").write_text("0.5 1 100 Rx d 1 00\nx\n0.25 2 100 Rx d 1 00\n0.5 1 100 Rx d 1 00\n")
    q = streams.running_clock(streams.stamped(streams.asc_lines(spark, str(tmp_path)))).writeStream.format("memory").queryName("clock").outputMode("update").start()
    q.processAllAvailable()
    (tmp_path / "b.asc").write_text("1 1 100 Rx d 1 00\n")
    q.processAllAvailable()
    q.stop()
    best = {r["channel"]: (r["n"], r["clock"]) for r in spark.sql("SELECT channel, max(n) AS n, max(clock) AS clock FROM clock GROUP BY channel").collect()}
    assert best == {"1": (3, 2_000_000_000), "2": (1, 250_000_000)}
