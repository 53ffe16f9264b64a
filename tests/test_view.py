import json

import pytest

from tracelark.functions import formats
from tracelark.plans.view import Heights, Span, View, first_free, shown, ticks, ticks_at
from tracelark.session import Session
from tracelark.sources import dbc
from tracelark.sources.traces import Library, dropped_databases, dropped_trace

from .test_session import ASC, DBC

WHOLE = View(Span(0.0, 100.0), Span(-10.0, 10.0))


def test_pan_zoom_and_box():
    assert WHOLE.panned(50, 10, 500, 100) == View(Span(-10.0, 90.0), Span(-8.0, 12.0)) and WHOLE.panned(5, 5, 0, 0) == WHOLE
    assert WHOLE.zoomed(0.5, 0.25, 0.0) == View(Span(12.5, 62.5), Span(0.0, 10.0)) and WHOLE.zoomed(0.5, 0.5, 0.5, y=False) == View(Span(25.0, 75.0), WHOLE.y)
    assert WHOLE.zoomed(float("nan"), 0, 0) == WHOLE and WHOLE.zoomed(-1, 0, 0) == WHOLE
    tiny = WHOLE.zoomed(1e-20, 0.5, 0.5)
    assert tiny.x.size == pytest.approx(1e-9, rel=1e-4) and tiny.x.low == pytest.approx(50.0)
    assert WHOLE.boxed((0.5, 0.75), (0.25, 0.25)) == View(Span(25.0, 50.0), Span(-5.0, 5.0)) and WHOLE.boxed((0, 0), (0.5, 0.004)) is None
    assert WHOLE.centre() == (50.0, 0.0) and WHOLE.point(0.1, 0.1) == (10.0, 8.0)
    assert WHOLE.near(View(Span(0.0, 100.00005), WHOLE.y)) and not WHOLE.near(View(Span(0.0, 100.1), WHOLE.y)) and not WHOLE.near(None)


def test_heights_follow_what_is_shown():
    half = Heights().followed(WHOLE.y, Span(0.0, 10.0))
    assert half == Heights(0.0, 0.5) and half.of(Span(0.0, 4.0)) == Span(2.0, 4.0)
    assert half.followed(Span(0.0, 10.0), Span(5.0, 10.0)) == Heights(0.0, 0.25) and half.followed(Span(1.0, 1.0), WHOLE.y) == half
    assert shown(WHOLE, None, half) == WHOLE and shown(WHOLE, Span(1.0, 2.0), half) == View(Span(1.0, 2.0), Span(0.0, 10.0)) and shown(None, None, half) is None
    assert Span(3.0, 3.0).height_of(3.0) == 0.5


def test_ticks_texts_and_free_places():
    assert ticks(Span(0.0, 10.0), 5) == [(0.0, 10.0), (0.2, 8.0), (0.4, 6.0), (0.6, 4.0), (0.8, 2.0), (1.0, 0.0)]
    assert ticks(Span(2.0, 2.0)) == [(0.5, 2.0)] and ticks(None) == [] and ticks(Span(0.0, 1.0), 0) == [] and ticks_at(Span(0.0, 4.0), [0.0, 0.25]) == [(0.0, 4.0), (0.25, 3.0)]
    assert [formats.axis_value(x) for x in (0.0, -1e-13, 1234.5, 12.34, 1.23456, 0.5, 2e6, -5e-4, float("inf"))] == ["0", "0", "1235", "12.3", "1.235", "0.5", "2.00e+6", "-5.00e-4", None]
    assert formats.axis_time(1500, 1777550400000, True) == "12:00:01.500" and formats.axis_time(61_000) == "1m 1.000s" and formats.axis_time(1500, None, True) == "1.500s"
    assert [first_free(x) for x in ([], [0, 1, 3], [1])] == [0, 2, 0]


def test_dropped_files():
    assert dropped_trace(["a.ASC"]) == "a.ASC" and dropped_trace(["a.asc", "b.asc"]) is None and dropped_trace(["a.dbc"]) is None
    assert dropped_databases(["a.dbc", "b.asc", "c.DBC"]) == ["a.dbc", "c.DBC"]


def test_library_keeps_what_can_be_read(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    good = lib.put([("a.dbc", b"BO_ 1 A: 8 X\n"), ("b.dbc", b"BO_ 2 B: 8 X\n")])
    spark.createDataFrame([("ab", "bad.dbc", b"BO_ x\n")], Library.SCHEMA).write.partitionBy("id").mode("append").parquet(lib.path)
    read, faults = lib.reload()
    assert set(read) == set(good) and len(faults) == 1 and faults[0].startswith("bad.dbc: ")
    assert lib.delete(good[0]) and not lib.delete("../x") and {r["id"] for r in lib.rows().collect()} == {good[1], "ab"}
    lib.reset()
    assert lib.rows().count() == 0


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("v") / "a.asc"
    path.write_text(ASC + "9.0 1 100 Rx d 9 00\n")
    s = Session(spark)
    s.add_database("f", dbc.parse(DBC))
    s.add_database("empty", dbc.parse("VERSION \"\"\n"))
    s.open_trace(str(path))
    yield s
    s.close()


def test_tree_of_files_messages_and_signals(session):
    rows = lambda **k: [(r["kind"], r["label"]) for r in session.tree(**k).collect()]
    speed = [("signal", "Motor.Speed [Channel 1 · Rx]"), ("signal", "Motor.Speed [Channel 2 · Tx]")]
    mode = [("signal", "Motor.Mode [Channel 1 · Rx]"), ("signal", "Motor.Mode [Channel 2 · Tx]")]
    assert rows() == [("dbc", "empty"), ("dbc", "f"), ("message", "Motor"), *speed, *mode, ("message", "Quiet"), ("signal", "Quiet.Level")]
    assert rows(query="speed") == [("dbc", "f"), ("message", "Motor"), *speed] and rows(query=" . ", closed=["f"]) == [("dbc", "f")]
    assert rows(hide_unavailable=True) == [("dbc", "f"), ("message", "Motor"), *speed, *mode] and rows(active_only=True) == []
    motor = next(r["key"] for r in session.tree().collect() if r["label"] == "Motor")
    assert rows(query="motor", closed=[motor]) == [("dbc", "f"), ("message", "Motor")]


def test_selection_axes_and_views(session):
    session.select(["Motor.Speed [Channel 1 · Rx]", "Motor.Mode [Channel 2 · Tx]"])
    session.toggle("motor.speed [channel 1 · rx]")
    session.toggle("Motor.Speed [Channel 2 · Tx]")
    assert {s.label: s.colour for s in session.selected.values()} == {"Motor.Mode [Channel 2 · Tx]": 1, "Motor.Speed [Channel 2 · Tx]": 0}
    mode, speed = session.selected
    assert session.plottable() == [mode, speed] and [session.add_axis() for _ in range(5)] == ["y2", "y3", "y4", "y5", None]
    session.set_axes({mode: "y2"})
    whole = session.view()
    assert whole["fit"] and whole["view"].x == Span(100.0, 3900.0) and set(whole["ranges"]) == {"y1", "y2", "y3", "y4", "y5"} and whole["ranges"]["y3"] == Span(0.0, 1.0)
    session.show(whole["view"].zoomed(0.5, 0.5, 1.0))
    now = session.view()
    assert not now["fit"] and now["view"].near(whole["view"].zoomed(0.5, 0.5, 1.0)) and now["ranges"]["y3"].near(Span(0.0, 0.5))
    session.show(None)
    session.remove_axis("y2")
    session.remove_axis("y1")
    assert session.selected[mode].axis == "y1" and session.open_axes == ["y1", "y3", "y4", "y5"]
    session.reset_axes()
    assert session.open_axes == ["y1"] and session.drop_file("f") == [mode, speed] and session.selected == {}
    with pytest.raises(ValueError):
        session.only("Motor", "Speed", "km/h")


def test_description_as_json(session, spark):
    own = json.loads(session.to_json())
    assert own["trace"][0]["warning"] == "Parsed with 1 malformed line skipped." and [m["name"] for m in own["catalogs"]["f"]] == ["Motor", "Quiet"]
    shown = dbc.shown_warnings(dbc.warning_table(spark, dbc.parse('BO_ 1 A: 8 X\nCM_ BO_ 1 "x";\n')))
    assert shown.count() == 0
