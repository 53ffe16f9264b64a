"""Decoding by a table of plans and SQL functions against the projection, over random layouts and payloads."""

import random

import pytest

from tracelark import sql
from tracelark.operators import decode
from tracelark.plans import layouts
from tracelark.plans.model import Database, Message, Multiplex, Signal
from tracelark.sources.text_lines import FRAME_SCHEMA


def some_signal(rng, name, size, multiplex):
    while True:
        kind = rng.choice(["integer"] * 6 + ["float32", "float64"])
        bits = {"float32": 32, "float64": 64}.get(kind) or rng.choice([1, 8, 12, 31, 57, 63, 64, rng.randint(1, 64)])
        labels = ((0, "zero"), (1, "one"), (1, "late")) if rng.random() < 0.3 else ()
        s = Signal(name, rng.randrange(size * 8), bits, rng.random() < 0.5, rng.random() < 0.5, rng.choice([1.0, 0.1, -2.5]), rng.choice([0.0, 3.0]), value_type=kind, multiplex=multiplex, value_descriptions=labels)
        if not s.fault(size):
            return s


@pytest.fixture(scope="module")
def bus(spark):
    rng, messages = random.Random(2), []
    for i in range(40):
        size = rng.choice([1, 2, 8, 8, 8, 12, 16, 64])
        selector, inner = Signal("Sel", 0, 2, is_multiplexer=True), Signal("Sub", 0, 3, is_multiplexer=True, multiplex=Multiplex("Sel", ((1, 2),)))
        more = [some_signal(rng, f"S{k}", size, rng.choice([None, None, Multiplex("Sel", ((0, 1),)), Multiplex("Sub", ((1, 1), (4, 7)))])) for k in range(6)]
        messages.append(Message(i, i, i % 7 == 0, f"M{i}", size, (selector, inner, *more), is_fd=size > 8, frame_format=rng.choice([None, None, "fd", "classic"])))
    messages.append(Message(5, 5, False, "Again", 8, (Signal("Wide", 0, 64, is_multiplexer=True), Signal("Top", 8, 8, multiplex=Multiplex("Wide", (((1 << 63), (1 << 64) - 1),))))))
    rows = []
    for j in range(3000):
        i, n = rng.randrange(45), rng.choice([0, 1, 2, 8, 8, 8, 12, 16, 64])
        rows.append(("t", j, j * 1000, rng.choice([None, 1, 2]), rng.choice(["rx", "tx"]), rng.choice(["data"] * 9 + ["error"]), i, i % 7 == 0, rng.random() < 0.5, n, n, bytearray(rng.randrange(256) for _ in range(n))))
    wanted = decode.all_signals(Database(tuple(messages)))
    frames = spark.createDataFrame(rows, FRAME_SCHEMA).repartition(3).cache()
    return frames, wanted, plain(decode.decode_by_projection(frames, wanted))


def plain(df):
    return sorted(((r[0], str(r["channel"]), r["direction"], r["seq"], r["time_ms"], repr(r["value"])) for r in df.collect()))


def test_the_table_of_plans_decodes_as_the_projection(spark, bus):
    frames, wanted, want = bus
    assert plain(decode.decode_by_table(frames, wanted)) == want and len(want) > 2000
    assert plain(decode.decode_many(frames, wanted)) == want  # more messages than a projection takes
    assert decode.decode_by_table(frames, wanted, False).columns == decode.decode_by_projection(frames, wanted, False).columns
    assert decode.decode_by_table(frames.limit(0), wanted).count() == 0 and decode.decode_by_table(frames, []).count() == 0


def test_a_thousand_messages_in_one_scan(spark, bus):
    frames, _, _ = bus
    signals = tuple(Signal(f"S{k}", k, 8, factor=0.5) for k in range(20))
    wanted = [(f"{i}.{s.name}", m, s) for i in range(1000) for m in [Message(i, i, False, f"M{i}", 8, signals)] for s in signals]
    got = decode.decode_many(frames, wanted)
    some = [w for w in wanted if w[1].can_id in (1, 2, 3)]
    assert plain(got.where("signal_key like '1.%' or signal_key like '2.%' or signal_key like '3.%'")) == plain(decode.decode_by_projection(frames, some))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 1


def test_sql_functions_decode_as_the_projection(spark, bus):
    frames, wanted, want = bus
    sql.register(spark, frames, layouts.rows(spark, wanted))
    assert plain(spark.sql(sql._SAMPLES)) == want
    for key in ("M8.S1", "Again.Top", "M3.Sub"):
        own = [r for r in want if r[0] == key]
        assert [(str(r["channel"]), r["direction"], r["seq"], r["time_ms"], repr(r["value"])) for r in spark.sql(f"SELECT * FROM signal_samples('{key}') ORDER BY channel, direction, seq").collect()] == sorted((r[1:] for r in own), key=lambda r: (r[0] != "None", r))
        for at in (-1.0, 1.2345, 99.0):
            best = min(own, key=lambda r: (abs(r[4] - at), r[4], r[3]))
            assert [(r["sample_ms"], repr(r["value"])) for r in spark.sql(f"SELECT * FROM signal_nearest('{key}', {at}D)").collect()] == [(best[4], best[5])]
    assert spark.sql("SELECT * FROM signal_nearest('none', 1D)").count() == 0
    named = {r["value"]: r["label"] for r in spark.sql("SELECT signal_label(v, 0.5D, 1D, array(named_struct('raw_value', 2L, 'label', 'two'), named_struct('raw_value', 2L, 'label', 'late'))) AS label, v AS value FROM VALUES (2D), (2.2D), (1D), (CAST(NULL AS DOUBLE)) t(v)").collect()}
    assert named == {2.0: "two", 2.2: None, 1.0: None, None: None}
