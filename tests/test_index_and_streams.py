"""The index of frames opens few files; streams put frames in order and forget what is idle."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracelark.session import Session
from tracelark.sources import frame_index
from tracelark.sources.text_lines import FRAME_SCHEMA
from tracelark.sources.traces import open_trace
from tracelark.streaming import frames as streams


def some_frames(spark, n=4000):
    rng, rows = random.Random(4), []
    for i in range(n):
        kind = rng.choice(["data"] * 8 + ["error"])
        rows.append(("t", i, i * 1000, rng.choice([None, 1, 2]), rng.choice(["rx", "tx"]), kind, rng.randrange(100) if kind == "data" else None, rng.random() < 0.2, False, 8, 8, bytearray(8)))
    return spark.createDataFrame(rows, FRAME_SCHEMA), rows


def test_one_message_is_read_from_few_files(spark, tmp_path):
    df, rows = some_frames(spark)
    index = frame_index.write(df, str(tmp_path / "index"), 40)
    assert index.frames.count() == 4000 and index.files.agg(F.sum("n")).first()[0] == 4000
    total = index.files.count()
    assert total >= 30
    for can_id, extended, source, window in ((7, False, None, None), (63, True, (1, "rx"), None), (99, False, (None, "tx"), (0, 2_000_000)), (7, False, None, (3_000_000, 3_500_000))):
        want = sorted(r[1] for r in rows if r[5] == "data" and r[6] == can_id and r[7] == extended and (source is None or (r[3], r[4]) == source) and (window is None or window[0] <= r[2] <= window[1]))
        own = index.of_message(can_id, extended, source, window)
        assert sorted(r["seq"] for r in own.collect()) == want
        assert index.files_of(can_id, source, window).count() <= 3 and len(own.inputFiles()) <= 3  # of some forty
    assert index.of_message(5000, False).count() == 0 and index.of_message(5000, False).columns == df.columns


def test_a_session_over_an_index_and_closed_traces(spark, tmp_path):
    (tmp_path / "a.asc").write_text("base hex timestamps absolute\n" + "".join(f"{i * 0.1:.1f} 1 100 Rx d 1 {i:02x}\n" for i in range(30)))
    s = Session(spark)
    trace = s.open_trace(str(tmp_path / "a.asc"), index=str(tmp_path / "index"))
    assert trace.opened().frames.count() == 30 and "index" in trace.frames.inputFiles()[0] and s.warnings().count() == 0
    s.close()
    with pytest.raises(ValueError, match="trace handle is closed"):
        trace.opened()
    with pytest.raises(ValueError, match="more than 100 bytes"):
        open_trace(spark, str(tmp_path / "a.asc"), 100)
    assert open_trace(spark, str(tmp_path / "a.asc"), 10_000).frames.count() == 30


def test_late_frames_find_their_place(spark, tmp_path):
    """Frames up to ten seconds late are put in order; later ones are left out; a channel that stays silent is forgotten."""
    folder = tmp_path / "in"
    schema = "channel int, seq long, at timestamp, timestamp_ns long, can_id int, payload binary"
    folder.mkdir()
    source = spark.readStream.schema(schema).json(str(folder))
    second = lambda s: f"2026-01-01T00:{s // 60:02d}:{s % 60:02d}.000Z"
    row = lambda c, i, s: f'{{"channel":{c},"seq":{i},"at":"{second(s)}","timestamp_ns":{s * 1000},"can_id":1,"payload":"AA=="}}\n'
    q = streams.in_order(source, "at", "10 seconds").writeStream.format("memory").queryName("ordered").option("checkpointLocation", str(tmp_path / "cp")).start()
    states = []
    batches = [[(1, 0, 5), (1, 1, 3), (2, 2, 4)], [(1, 3, 20), (1, 4, 4), (2, 5, 14)], [(1, 6, 18), (1, 7, 16), (1, 8, 1)], [(1, 9, 120)], [(1, 10, 300)], [(1, 11, 600)]]
    for n, own in enumerate(batches):
        (folder / f"{n}.json").write_text("".join(row(*r) for r in own))
        q.processAllAvailable()
        states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    q.stop()
    got = [(r["channel"], r["seq"], r["step_ns"]) for r in spark.sql("SELECT * FROM ordered").collect()]
    assert [x for x in got if x[0] == 1] == [(1, 1, None), (1, 4, 1000), (1, 0, 1000), (1, 7, 11000), (1, 6, 2000), (1, 3, 2000), (1, 9, 100_000), (1, 10, 180_000)]
    assert [x for x in got if x[0] == 2] == [(2, 2, None), (2, 5, 10000)]
    assert states[0] == 2 and states[-1] == 1  # channel 2 has gone


def test_an_idle_clock_starts_anew(spark, tmp_path):
    q = streams.running_clock(streams.stamped(streams.asc_lines(spark, str(tmp_path))), 1000).writeStream.format("memory").queryName("idle").outputMode("update").trigger(processingTime="200 milliseconds").start()

    def until(done):
        end = time.time() + 60
        while not done() and time.time() < end:
            time.sleep(0.2)

    rows = lambda: [(r["n"], r["clock"]) for r in spark.sql("SELECT * FROM idle").collect()]
    try:
        (tmp_path / "a.asc").write_text("0.5 1 100 Rx d 1 00\n")
        until(rows)
        until(lambda: q.lastProgress and q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0)
        (tmp_path / "b.asc").write_text("1 1 100 Rx d 1 00\n")
        until(lambda: len(rows()) > 1)
        assert rows() == [(1, 500_000_000), (1, 1_000_000_000)]
    finally:
        q.stop()
