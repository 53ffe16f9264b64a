import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelark.functions import formats, text
from tracelark.operators import catalog, series
from tracelark.plans.model import Signal


def of(spark, points, key="s"):
    return spark.createDataFrame([(key, i, float(t), None if v is None else float(v)) for i, (t, v) in enumerate(points)], "signal_key string, seq long, time_ms double, value double")


def test_nearest_sample_ties_and_ends(spark):
    s = of(spark, [(0, 5), (10, 10), (20, 25), (20, 26)])
    asked = spark.createDataFrame([("s", x) for x in (-3.0, 0.0, 5.0, 15.0, 19.0, 20.0, 99.0, float("nan"))] + [("other", 1.0)], "signal_key string, at_ms double")
    got = {(r["signal_key"], str(r["at_ms"])): (r["sample_ms"], r["value"]) for r in series.nearest(s, asked).collect()}
    assert [got["s", k] for k in ("-3.0", "0.0", "5.0", "15.0", "19.0", "20.0", "99.0", "nan")] == [(0, 5), (0, 5), (0, 5), (10, 10), (20, 25), (20, 25), (20, 25), (None, None)]
    assert got["other", "1.0"] == (None, None)


def test_domains_windows_and_deltas(spark):
    d = series.domains(of(spark, [(0, 10), (10, 15), (20, 20), (30, -10), (40, 0), (50, math.nan), (60, math.inf)]), ["signal_key"]).first()
    assert (d["x_min"], d["x_max"], d["y_low"], d["y_high"]) == (0, 40, -11.5, 21.5)
    alone = series.domains(of(spark, [(1, 40)]), ["signal_key"]).first()
    assert (alone["y_low"], alone["y_high"]) == (38, 42)
    s = of(spark, [(t, t) for t in (0, 10, 20, 30, 40)])
    times = lambda a, b: sorted(r["time_ms"] for r in series.window(s, a, b).collect())
    assert times(10, 30) == [0, 10, 20, 30, 40] and times(19, 11) == [10, 20] and times(50, 60) == [] and times(20, 20) == [10, 20, 30]
    inspected = spark.createDataFrame([("s", 0.0, 1.0), ("s", 5.0, 4.0), ("s", 9.0, None)], "signal_key string, at_ms double, value double")
    assert [(r["delta_ms"], r["delta_value"]) for r in series.deltas(inspected).orderBy("at_ms").collect()] == [(None, None), (5, 3), (4, None)]


def test_lttb_keeps_ends_and_spikes(spark):
    x = np.arange(1000.0)
    y = np.zeros(1000)
    y[500] = 9
    kept = series.lttb_indices(x, y, 50)
    assert len(kept) == 50 and kept[0] == 0 and kept[-1] == 999 and 500 in kept
    assert list(series.lttb_indices(x, y, 2)) == [0, 999] and len(series.lttb_indices(x, y, 5000)) == 1000
    assert series.lttb(of(spark, [(i, i % 7) for i in range(300)]), 40).count() == 40
    assert (series.points_per_signal(10, True), series.points_per_signal(100_000, False)) == (15_000, 2)


def test_labels_and_ranges(spark):
    s = Signal("m", 0, 8, factor=0.1, offset=1.0, minimum=0.0, maximum=2.0, unit="V", value_descriptions=((3, "three"), (3, "late"), (5, "five")))
    rows = spark.createDataFrame([(1.3,), (1.5,), (1.55,), (2.04,), (2.06,), (None,)], "v double").select(series.label_of(s, F.col("v")).alias("l"), series.out_of_range(s, F.col("v")).alias("o"), series.display(s, F.col("v")).alias("d")).collect()
    assert [r["l"] for r in rows] == ["three", "five", None, None, None, None]
    assert [r["o"] for r in rows] == [False, False, False, False, True, False]
    assert [r["d"] for r in rows] == ["three", "five", "1.6 V", "2.0 V", "2.1 V", "-"]


@pytest.mark.parametrize(("args", "want"), [((42.37, 0.1), "42.4"), ((12, 0.01), "12.00"), ((1e-13, 1), "1.000000e-13"), ((1.005, 0.01), "1.00"), ((0, 1), "0"), ((1234567.0, 1), "1.234567e+6"), ((0.1 + 0.2, None), "0.3"), ((math.nan, 1), "-")])
def test_numbers(args, want):
    assert formats.number(*args) == want


def test_times():
    assert formats.duration(-61250) == "-1m 1.250s" and formats.seconds(59.9994) == "59.999s" and formats.duration(math.inf) == ""


def test_search_order_references_and_units(spark):
    assert text.terms("  SPÉED, 0x1E chan_nel") == ["speed", "1e", "chan", "nel"]
    rows = spark.createDataFrame([("k1", "Motor.Spéed", 0x1E0), ("k2", "Motor.Torque", 0x1E), ("k3", "motor.torque", 0x2)], "key string, label string, can_id int")
    found = lambda q: sorted(r["key"] for r in catalog.search(rows, q)[0].collect())
    assert found("speed motor") == ["k1"] and found("0x1e") == ["k2"] and found("01e0") == ["k1"] and found("") == ["k1", "k2", "k3"] and found("zz") == []
    refs = spark.createDataFrame(list(enumerate(["k1", "MOTOR.SPÉED", "motor.TORQUE", "none", "k1"])), "place int, ref string")
    assert [r["state"] for r in catalog.resolve(rows, refs).orderBy("place").collect()] == ["resolved", "repeated", "ambiguous", "missing", "repeated"]
    units = spark.createDataFrame([("y1", "V"), ("y1", ""), ("y9", " V "), ("y2", "A"), ("y2", "B")], "axis string, unit string")
    assert {r["axis"]: (r["n_signals"], r["unit"]) for r in catalog.axis_units(units, ["y1", "y2"]).collect()} == {"y1": (3, "V"), "y2": (2, None)}


def lines():
    """Series with spikes, ties, straight and flat parts, equal times, and numbers at the limits of doubles."""
    rng = np.random.default_rng(3)
    return {
        "noise": (np.arange(2000.0) * 0.1, rng.normal(0, 1, 2000)), "flat": (np.arange(900.0) * 0.7, np.full(900, 0.1)), "steps": (np.arange(2000.0) / 3, np.repeat(rng.integers(0, 3, 40) * 0.1, 50)),
        "straight": (np.arange(900.0) * 0.1, np.arange(900.0) * 0.3), "equal times": (np.sort(rng.integers(0, 200, 1500)).astype(float), rng.integers(0, 4, 1500).astype(float)), "one": ([5.0], [1.0]), "two": ([1.0, 2.0], [3.0, 4.0]),
        "wave": (np.arange(5000.0) * 0.01, np.sin(np.arange(5000) * 0.01)), "no numbers": (np.arange(300.0), np.where(np.arange(300) % 50 == 7, np.nan, rng.normal(size=300))), "endless": (np.arange(300.0), np.where(np.arange(300) % 100 == 7, np.inf, rng.normal(size=300))),
        "far off": (np.arange(900.0) + 1e15, rng.normal(size=900) * 1e-9 + 1e6), "walk": (np.cumsum(rng.exponential(1, 6000)), np.cumsum(rng.normal(size=6000))),
    }


@pytest.mark.parametrize(("chunk", "target"), [(65_536, 2), (65_536, 3), (65_536, 40.9), (65_536, 700), (97, 5), (97, 40)])
def test_lines_over_hulls_equal_the_sequential_ones(spark, monkeypatch, chunk, target):
    monkeypatch.setattr(series, "CHUNK", chunk)
    own = lines()
    rows = [(k, i, float(a), float(b)) for k, (x, y) in own.items() for i, (a, b) in enumerate(zip(x, y, strict=True))]
    got = {k: [] for k in own}
    for r in series.lttb(spark.createDataFrame(rows, "signal_key string, seq long, time_ms double, value double").repartition(3), target).collect():
        got[r["signal_key"]].append(r["seq"])
    assert {k: sorted(v) for k, v in got.items()} == {k: series.lttb_indices(np.array(x), np.array(y), target).tolist() for k, (x, y) in own.items()}


def test_only_what_a_line_may_choose_stays_on_a_hull():
    rng = np.random.default_rng(9)
    for n in (3, 10, 300, 20_000):
        x, y = np.arange(float(n)), rng.normal(size=n)
        kept = series.outer(x, y, x.max(), np.abs(y).max())
        assert len(kept) <= 60
        for _ in range(50):
            anchor, mean = (-rng.exponential(n), rng.normal() * 3), (n + rng.exponential(n), rng.normal() * 3)
            assert int(np.argmax(series._area(anchor, mean, x, y))) in kept


def test_empty_series_have_no_line(spark):
    assert series.lttb(of(spark, []), 10).count() == 0 and series.lttb(of(spark, []), 2).count() == 0


def test_legends_are_ordered_by_locale(spark):
    """Small and capital letters, and accents, count only where all else is equal; signs come before digits, and these before letters."""
    names = ["zeta", "Öl", "ol", "Zeta", "öl", "Ol", "oz", "a_b", "ab", "a-b", "9", "Ab", "éa", "e", "ez", "_x", "Straße", "Strasse", "Strassf"]
    rows = spark.createDataFrame([(n, "", "", "", i, "", 1.0, 0.0, []) for i, n in enumerate(names)], "signal_name string, message_name string, label string, key string, selected_at int, unit string, factor double, offset double, value_descriptions array<struct<raw_value: bigint, label: string>>")
    got = [r["signal_name"] for r in catalog.legend_order(rows, "alphabetical").collect()]
    assert got == ["_x", "9", "a_b", "a-b", "ab", "Ab", "e", "éa", "ez", "ol", "Ol", "öl", "Öl", "oz", "Strasse", "Straße", "Strassf", "zeta", "Zeta"]
    assert [r["signal_name"] for r in catalog.legend_order(rows, "selection").collect()] == names
    tables = [([(2, "b"), (1, "Z")], "V"), ([(1, "z")], "A"), ([], "v"), ([], "Ä"), ([], "a"), ([(1, "é"), (1, "d")], "")]
    rows = spark.createDataFrame([(str(i), "", "", "", i, u, 1.0, 0.0, t) for i, (t, u) in enumerate(tables)], rows.schema)
    assert [r["signal_name"] for r in catalog.legend_order(rows, "grouped").collect()] == ["5", "0", "1", "4", "3", "2"]
