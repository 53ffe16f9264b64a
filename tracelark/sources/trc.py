"""TRC recordings (versions 1.0 to 1.3, 2.0 and 2.1) as Spark SQL over text splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import FD_LENGTHS, fd_length
from .asc import TraceError
from .text_lines import channel, decimal_to_ns, direction, frames_of, lines, number, payload, token

#: Versions that are read (fixed values).
VERSIONS = ("1.0", "1.1", "1.2", "1.3", "2.0", "2.1")
COLUMNS = "NOTBIdRlLD"
ERRORS = ("Error", "ErrorFrame", "ERROR", "ERRORFRAME", "Warning")
REMOTES = ("RTR", "RR")
FD_TYPES, OTHER_TYPES = ("FD", "FB", "FE", "BI"), ("ST", "ER", "EC", "EV")
MOST_TOKENS = 96
#: Days from the OLE epoch to the Unix epoch (fixed value).
OLE_DAYS = 25569


def ole_ms(text: Column) -> Column:
    """Unix milliseconds of OLE automation days; nine digits of the fraction count."""
    days, part = F.split_part(text, F.lit("."), F.lit(1)).try_cast("bigint"), F.split_part(text, F.lit("."), F.lit(2))
    units = F.coalesce(F.rpad(F.substring(part, 1, 9), 9, "0").try_cast("bigint"), F.lit(0).cast("bigint"))
    ms = F.try_add(F.try_multiply(days - OLE_DAYS, F.lit(86_400_000).cast("bigint")), F.expr("0L") + F.floor(units * F.lit(86_400_000).cast("decimal(20,0)") / F.lit(1_000_000_000)).cast("bigint"))
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), ms)


def headers(rows: DataFrame) -> DataFrame:
    """A row for each file: version, start, and the places of the declared columns."""
    body = F.btrim(F.substring("line", 2, 1 << 20), F.lit(" \t\r"))
    own = rows.where(F.col("line").startswith(";")).select("trace_id", "seq", body.alias("body"))
    value = lambda key: F.when(F.col("body").startswith(f"${key}="), F.btrim(F.substring("body", len(key) + 3, 1 << 20), F.lit(" \t\r")))
    last = lambda key: F.max_by(value(key), F.when(value(key).isNotNull(), F.col("seq")))
    df = own.groupBy("trace_id").agg(last("FILEVERSION").alias("version"), last("STARTTIME").alias("start"), last("COLUMNS").alias("columns"))
    names = F.transform(F.split("columns", ","), lambda x: F.btrim(x, F.lit(" \t\r")))
    place = lambda c: F.nullif(F.array_position(names, c), F.lit(0).cast("bigint")).cast("int") - 1
    return df.select("trace_id", "version", ole_ms(F.btrim("start", F.lit(" \t\r;"))).alias("measurement_start_ms"), names.alias("names"), *[place(c).alias(f"c_{'up_' if c.isupper() else ''}{c}") for c in COLUMNS])


def _ident(text: Column) -> tuple[Column, Column]:
    """Identifier and whether it is extended: by the text's width of 4 or 8 digits."""
    value = number(text, 16, 0x1FFFFFFF)
    wide = F.length(text) == 8
    return F.when(wide | ((F.length(text) == 4) & (value <= 0x7FF)), value), wide


def parse_v1(rows: DataFrame) -> DataFrame:
    numbered = token(0).rlike(r"^[0-9]+\)?$")
    df = rows.withColumn("t", F.when(numbered, F.slice("t", 2, 1 << 20)).otherwise(F.col("t"))).where(F.size("t") > 0)
    ns, timed = decimal_to_ns(token(0), 6)
    hexes = F.transform(F.col("t"), lambda x, i: F.when((i > 0) & x.rlike("^([0-9a-fA-F]{4}|[0-9a-fA-F]{8})$"), i))
    df = df.select("trace_id", "seq", "t", F.size("t").alias("size"), ns.alias("stamp"), timed.alias("timed"), F.array_min(hexes).alias("i"))
    before = F.when(F.col("i") >= 2, token(F.col("i") - 1))
    typed = before.isin("Rx", "Tx", *REMOTES, *ERRORS)
    df = df.withColumn("type", F.when(typed, before).otherwise(""))
    ch, ch_good = channel(F.when(F.col("i") >= 3, token(F.col("i") - 2)))
    ident, wide = _ident(token(F.col("i")))
    at = F.col("i") + F.when(token(F.col("i") + 1) == "-", 2).otherwise(1)
    df = df.select("*", ch.alias("channel"), (ch_good | (F.col("i") < 3)).alias("channel_good"), ident.alias("id"), wide.alias("extended"), at.alias("at"))
    df = df.withColumn("dlc", number(token(F.col("at")), 10, 15).cast("int")).withColumn("n", F.col("dlc")).withColumn("bytes", payload(F.col("at") + 1, F.col("n"), 16))
    mark = F.coalesce(token(F.col("at") + 1), F.lit(""))
    kind = (
        F.when(~F.col("timed"), "ignored").when(F.col("stamp").isNull() | (F.col("size") > MOST_TOKENS + 1), "skipped").when(F.col("i").isNull(), "unknown")
        .when(~F.col("channel_good"), "skipped").when((F.upper(token(F.col("i"))) == "FFFFFFFF") & (token(F.col("i")) == "FFFFFFFF") | F.col("type").isin(*ERRORS), "error")
        .when(F.col("id").isNull() | token(F.col("at")).isNull(), "unknown").when(F.col("dlc").isNull(), "skipped").when(F.col("dlc") > 8, "unknown")
        .when(mark.isin(*ERRORS), "error").when(F.col("type").isin(*REMOTES) | mark.isin(*REMOTES), "remote").when(F.col("bytes").isNull(), "skipped").otherwise("data")
    )
    return df.withColumn("kind", kind).withColumn("fd", F.lit(False)).withColumn("direction", direction(F.col("type"))).withColumn("sourced", F.col("kind") != "unknown")


def parse_v2(rows: DataFrame) -> DataFrame:
    """``rows`` with the places of their file's columns."""
    at = lambda c: F.when(F.col(c).isNotNull(), F.coalesce(token(F.col(c)), F.lit("")))
    ns, timed = decimal_to_ns(at("c_up_O"), 6)
    kind_text = at("c_up_T")
    bus = F.when(F.col("c_up_B").isNotNull() & ~((kind_text == "EV") & (at("c_up_B") == "-")), at("c_up_B"))
    ch, ch_good = channel(bus)
    ident, wide = _ident(at("c_up_I"))
    df = rows.select(
        "trace_id", "seq", "t", F.size("t").alias("size"), "c_l", "c_up_L", "c_up_D", F.when(timed, ns).alias("stamp"), kind_text.alias("type"), ch.alias("channel"),
        (ch_good | bus.isNull()).alias("channel_good"), ident.alias("id"), wide.alias("extended"), direction(F.coalesce(at("c_d"), F.lit(""))).alias("direction"),
        number(at("c_l"), 10, 64).cast("int").alias("count"), number(at("c_up_L"), 10, 15).cast("int").alias("code"),
    )
    fd = F.col("type").isin(*FD_TYPES)
    expected = F.when(fd, fd_length(F.col("code"))).otherwise(F.col("code"))
    n = F.when(F.col("c_up_L").isNotNull(), F.when(F.col("c_l").isNull() | (F.col("count") == expected), expected)).otherwise(F.col("count"))
    of_length = F.nullif(F.array_position(F.array(*[F.lit(x) for x in FD_LENGTHS]), F.col("count")), F.lit(0).cast("bigint")).cast("int") - 1
    df = df.withColumn("fd", fd).withColumn("n", n).withColumn("dlc", F.when(F.col("c_up_L").isNotNull(), F.col("code")).otherwise(of_length))
    df = df.withColumn("bytes", payload(F.col("c_up_D"), F.col("n"), 16))
    whole = F.col("n").isNotNull() & F.col("dlc").isNotNull() & (F.col("fd") | (F.col("n") <= 8)) & F.col("bytes").isNotNull()
    kind = (
        F.when((F.col("size") > MOST_TOKENS) | (F.col("size") < F.col("c_up_D")) | F.col("stamp").isNull() | ~F.col("channel_good"), "skipped")
        .when(F.col("type") == "ER", "error").when(F.col("type").isin(*OTHER_TYPES) | F.col("id").isNull(), "unknown").when(F.col("type") == "RR", "remote")
        .when(~F.col("type").isin("DT", *FD_TYPES), "unknown").when(whole, "data").otherwise("skipped")
    )
    remote_dlc = F.coalesce(F.when(F.col("c_l").isNotNull(), F.col("count")).otherwise(F.col("code")), F.lit(0))
    df = df.withColumn("kind", kind).withColumn("dlc", F.when(F.col("kind") == "remote", remote_dlc).otherwise(F.col("dlc")))
    return df.withColumn("sourced", F.lit(True))


def read(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(frames, meta) of TRC files; an unknown version, unknown columns, or version 2 without columns is an error."""
    rows = lines(spark, path)
    head = headers(rows)
    files = rows.select("trace_id").distinct().join(head, "trace_id", "left").withColumn("version", F.coalesce("version", F.lit("1.0")))
    two = F.col("version").startswith("2.")
    needed = F.lit(False)
    for c in ("c_up_O", "c_up_T", "c_up_I", "c_d", "c_up_D"):
        needed = needed | F.col(c).isNull()
    strange = F.exists("names", lambda x: ~x.isin(*COLUMNS))
    fault = F.when(~F.col("version").isin(*VERSIONS), "unsupported version").when(strange, "unsupported column").when(two & (needed | (F.col("c_l").isNull() & F.col("c_up_L").isNull())), "columns are missing")
    places = [c for c in files.columns if c.startswith("c_")]
    heads = files.select(fault.alias("fault"), "version", *places).distinct().orderBy(F.col("fault").desc_nulls_last()).limit(2).collect()
    if heads and heads[0]["fault"] is not None:
        raise TraceError(heads[0]["fault"])
    body = rows.where(~F.col("line").startswith(";"))
    if len(heads) == 1:  # all files are alike, so no line looks up its file's header
        body = body.select("*", *[F.lit(heads[0][c]).cast(files.schema[c].dataType).alias(c) for c in ("version", *places)])
    else:
        body = body.join(files.drop("measurement_start_ms", "names"), "trace_id")
    keep = ["trace_id", "seq", "stamp", "kind", "sourced", "channel", "direction", "id", "extended", "fd", "dlc", "n", "bytes"]
    parsed = parse_v1(body.where(~two)).select(*keep).unionByName(parse_v2(body.where(two)).select(*keep))
    parsed = parsed.withColumn("status", F.when(F.col("kind").isin("ignored", "skipped"), F.col("kind")).otherwise("frame")).withColumnRenamed("stamp", "timestamp_ns")
    data = F.col("kind") == "data"
    meta = parsed.groupBy("trace_id").agg(F.count(F.when(data, 1)).alias("valid_message_count"), F.count(F.when(F.col("kind") == "skipped", 1)).alias("skipped_line_count"), F.max(F.when(data, F.col("timestamp_ns"))).alias("duration_ns"))
    meta = files.select("trace_id", "measurement_start_ms").join(meta, "trace_id", "left").na.fill(0, ["valid_message_count", "skipped_line_count"])
    return frames_of(parsed), meta.select("trace_id", F.lit("trc").alias("trace_type"), "measurement_start_ms", "valid_message_count", "skipped_line_count", "duration_ns")
