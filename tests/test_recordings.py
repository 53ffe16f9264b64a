"""Recordings of a bus of several files, where Spark deals small and large tables into different numbers of parts."""

import pytest
from pyspark.sql import functions as F

from tracelark import queries, recordings


@pytest.fixture(scope="module")
def bus_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bus"))
    ts = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1000)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("click", "view", "purchase", "error")]), (F.col("id") % 4 + 1).cast("int"))
    events = spark.range(6 * recordings.FILE).select(F.col("id").alias("event_id"), ts.cast("timestamp_ntz").alias("ts"), (F.col("id") % 3000).alias("user_id"), kind.alias("event_type"), (F.col("id") % 977 / 7).alias("value"))
    events.write.parquet(f"{path}/events.parquet")
    return path


@pytest.fixture
def many_parts(spark):
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize(("write", "header"), [(recordings.asc, ["date ", "base hex"]), (recordings.asc_relative, ["base dec"]), (lambda s, d: recordings.trc(s, d, True), [";$FILEVERSION=2.1", ";$COLUMNS="])])
def test_headers_stand_in_front_of_their_lines(spark, bus_dir, many_parts, write, header):
    lines = spark.read.text(write(spark, bus_dir), wholetext=True).collect()
    assert len({r["file"] for r in lines}) == len(lines) == 6
    for r in lines:
        own = r["value"].splitlines()
        assert len(own) > 1000 and all(x.startswith(h) for x, h in zip(own, header, strict=False))


def test_relative_stamps_of_many_files(spark, bus_dir, many_parts):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{bus_dir}/events.parquet/*.parquet'")
    want = c.execute(f"SELECT count(*), sum(timestamp_ns)::BIGINT, sum(can_id)::BIGINT FROM ({queries.ORACLE_SQL['read_asc_relative_decimal']})").fetchall()[0]
    got = queries.QUERIES["read_asc_relative_decimal"](spark, bus_dir).agg(F.count("*"), F.sum("timestamp_ns"), F.sum("can_id")).first()
    assert tuple(got) == tuple(want)


def test_filters_stay_above_the_parse(spark, bus_dir, tmp_path):
    """A filter on the kind of a line, moved below what the kind is made of, grew to a hundred times the line's own expressions."""
    from tracelark.sources import asc, trc

    for read, text in ((asc.read, "0.5 1 100 Rx d 1 00\n"), (trc.read, ";$FILEVERSION=1.1\n 1) 1.5 1 Rx 0100 - 1 00\n"), (trc.read, ";$FILEVERSION=2.1\n;$COLUMNS=N,O,T,B,I,d,R,L,D\n 1 1.5 DT 1 0100 Rx - 1 00\n")):
        path = tmp_path / f"{abs(hash(text))}.txt"
        path.write_text(text)
        frames, _ = read(spark, str(path))
        plan = frames._jdf.queryExecution().optimizedPlan().toString()
        filters = [x.split("Filter", 1)[1] for x in plan.splitlines() if "Filter " in x]
        assert filters and max(map(len, filters)) < 2000 and frames.count() == 1


def test_trc_files_of_different_versions_are_read_together(spark, tmp_path):
    from tracelark.sources import trc

    (tmp_path / "a.trc").write_text(";$FILEVERSION=1.1\n 1) 1.5 1 Rx 0100 - 1 0A\n")
    (tmp_path / "b.trc").write_text(";$FILEVERSION=2.1\n;$COLUMNS=N,O,T,B,I,d,R,L,D\n 1 2.5 DT 1 0101 Rx - 1 0B\n")
    (tmp_path / "c.trc").write_text(";$FILEVERSION=1.1\n 1) 3.5 1 Rx 0102 - 1 0C\n")
    both = lambda *names: sorted((r["timestamp_ns"], r["can_id"], bytes(r["payload"])) for r in trc.read(spark, [str(tmp_path / n) for n in names])[0].collect())
    assert both("a.trc", "b.trc", "c.trc") == [(1_500_000, 0x100, b"\x0a"), (2_500_000, 0x101, b"\x0b"), (3_500_000, 0x102, b"\x0c")]
    assert both("a.trc", "c.trc") == [(1_500_000, 0x100, b"\x0a"), (3_500_000, 0x102, b"\x0c")]


def test_blf_tasks_hold_few_frames_at_a_time():
    import pyarrow as pa

    from tracelark.sources import blf, writers

    data = writers.blf([writers.blf_object(1, i, writers.can_message(1, i % 2048, b"ab")) for i in range(12_000)], 1_000_000)
    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([0], pa.int32()), pa.array(list(blf.bodies(data)), pa.binary())], names=["path", "container", "body"])
    sizes = [b.num_rows for b in blf._frames(blf.MOST_BYTES, False)(iter([batch]))]
    assert sum(sizes) == 12_000 and max(sizes) <= 5_000
