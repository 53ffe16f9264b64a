"""ASC recordings as Spark SQL over text splits: a file of any size is parsed by many tasks.

State that lines carry for later ones is small: header lines are collected per file and joined by their range; running
clocks are sums within splits plus the splits' offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bits import fd_length
from .text_lines import LINE_BITS, channel, decimal_to_ns, direction, frames_of, lines, number, payload, token

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_DATE = r"^\S+ +(\S+) +([0-9]{1,2}) +([0-9]{1,2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,3}))?(?: +([ap]m))? +([0-9]{4})$"


class TraceError(ValueError):
    """A recording that cannot be read."""


def wall_clock_ms(text: Column) -> Column:
    """Unix milliseconds of a date line's text, taken as UTC; null if it is none. The day of the month is not checked."""
    part = lambda i: F.coalesce(F.regexp_extract(text, _DATE, i), F.lit(""))
    num = lambda i: part(i).try_cast("int")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part(1)).cast("int")
    hour = F.when((part(7) != "") & num(3).between(1, 12), num(3) % 12 + F.when(part(7) == "pm", 12).otherwise(0)).otherwise(num(3))
    day = F.unix_date(F.make_date(num(8), F.greatest(month, F.lit(1)), F.lit(1))) + num(2) - 1
    ms = F.coalesce(F.rpad(F.nullif(part(6), F.lit("")), 3, "0").try_cast("long"), F.lit(0).cast("long"))
    good = text.rlike(_DATE) & (month > 0) & (hour <= 23) & (num(4) <= 59) & (num(5) <= 59)
    return F.when(good, day.cast("long") * 86_400_000 + (hour * 3600 + num(4) * 60 + num(5)).cast("long") * 1000 + ms)


def headers(rows: DataFrame) -> DataFrame:
    """of (trace_id), since, until, radix, relative, fault: the number base and clock in force from a line to the next such line."""
    base = rows.where(F.col("line").startswith("base ")).select(
        "trace_id", "seq", token(1).alias("base"), token(2).alias("word"), token(3).alias("clock"), F.size("t").alias("n")
    )
    good = F.col("base").isin("hex", "dec") & (F.col("word") == "timestamps") & F.col("clock").isin("absolute", "relative")
    nxt = F.lead("seq").over(Window.partitionBy("trace_id").orderBy("seq"))
    return base.select(
        F.col("trace_id").alias("of"), F.col("seq").alias("since"), F.coalesce(nxt, F.lit((1 << 63) - 1)).alias("until"),
        F.when(F.col("base") == "dec", 10).otherwise(16).alias("radix"), (F.col("clock") == "relative").alias("relative"), (~F.coalesce(good, F.lit(False))).alias("fault"),
    )


def parse(rows: DataFrame, radix: int | None = None, relative: bool | None = None) -> DataFrame:
    """Every line with status (frame, skipped, ignored), kind and the frame's parts.

    ``radix`` and ``relative`` are given where all lines have the same; otherwise each line looks up the header in force.
    """
    if radix is None or relative is None:
        state = headers(rows)
        rows = rows.join(state, (F.col("trace_id") == F.col("of")) & (F.col("seq") > F.col("since")) & (F.col("seq") < F.col("until")), "left")
        base, clock = F.coalesce("radix", F.lit(16)), F.coalesce("relative", F.lit(False))
    else:
        base, clock = F.lit(radix), F.lit(relative)
    ns, timed = decimal_to_ns(token(0), 9)
    # lines without a stamp go first, so that nothing else is looked up for them
    df = rows.where(token(0).rlike(r"^[0-9]+(\.[0-9]+)?$")).select(
        "trace_id", "seq", "t", F.size("t").alias("size"), base.alias("radix"), clock.alias("relative"),
        ns.alias("stamp"), timed.alias("timed"), F.coalesce(token(1) == "CANFD", F.lit(False)).alias("fd"),
    )
    radix = F.col("radix") if radix is None else radix
    fd = F.col("fd")
    df = df.withColumn("o", F.when(fd & ~F.coalesce(token(5).rlike("^[0-9]+$"), F.lit(True)), 1).otherwise(0))
    ch, ch_good = channel(F.when(fd, token(2)).otherwise(token(1)))
    id_text = F.when(fd, token(4)).otherwise(token(2))
    marked = id_text.rlike("[xX]$")
    ident = number(F.regexp_replace(id_text, "[xX]$", ""), radix, 0x1FFFFFFF)
    dlc_text = F.when(fd, token(F.col("o") + 7)).otherwise(token(5))
    dlc = F.when(F.length(dlc_text) == 1, number(dlc_text, 16, 15)).otherwise(number(dlc_text, 10, 15)).cast("int")
    df = df.select(
        "*", ch.alias("channel"), ch_good.alias("channel_good"), ident.alias("id"), (marked | (ident > 0x7FF)).alias("extended"),
        direction(token(3)).alias("direction"), dlc.alias("dlc"), dlc_text.isNull().alias("no_dlc"), number(token(F.col("o") + 8), 10, 64).cast("int").alias("length"),
    )
    n = F.when(fd, F.col("length")).otherwise(F.col("dlc"))
    df = df.withColumn("n", n).withColumn("bytes", payload(F.when(fd, F.col("o") + 9).otherwise(6), F.col("n"), radix))
    mark = token(4)
    good_fd = F.col("channel_good") & F.col("id").isNotNull() & (F.col("length") == fd_length(F.col("dlc"))) & F.col("bytes").isNotNull()
    good = lambda c: F.coalesce(c, F.lit(False))
    kind = (
        F.when(~F.col("timed"), "ignored").when(F.col("stamp").isNull(), "skipped").when(F.col("size") == 1, "unknown")
        .when(fd, F.when(good(good_fd), "data").otherwise("skipped"))
        .when(F.col("size") == 2, "unknown")
        .when(token(2) == "ErrorFrame", F.when(F.col("channel_good"), "error").otherwise("skipped"))
        .when(F.col("id").isNull() | (F.col("size") == 3), "unknown").when(~F.col("channel_good"), "skipped").when(F.col("size") == 4, "unknown")
        .when(mark == "d", F.when(good((F.col("dlc") <= 8) & F.col("bytes").isNotNull()), "data").otherwise("skipped"))
        .when(mark == "r", F.when(F.col("no_dlc") | F.col("dlc").isNotNull(), "remote").otherwise("skipped"))
        .otherwise("unknown")
    )
    df = df.withColumn("kind", kind)
    return df.select(
        "trace_id", "seq", "stamp", "relative", F.when(F.col("kind").isin("ignored", "skipped"), F.col("kind")).otherwise("frame").alias("status"), "kind",
        (F.col("kind").isin("data", "remote", "error")).alias("sourced"), "channel", F.when(F.col("kind") != "error", F.col("direction")).otherwise("unknown").alias("direction"),
        "id", "extended", "fd", F.coalesce("dlc", F.lit(0)).alias("dlc"), "n", "bytes",
    )


def run_clocks(parsed: DataFrame) -> DataFrame:
    """timestamp_ns: the stamp itself, or in files with relative stamps the running sum of all stamps so far."""
    df = parsed.withColumn("split", F.shiftright("seq", LINE_BITS))
    step = F.when(F.col("relative"), F.coalesce("stamp", F.lit(0)))
    within = Window.partitionBy("trace_id", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("trace_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy("trace_id", "split").agg(F.sum(step).alias("total")).select("trace_id", "split", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    df = df.withColumn("upto", F.sum(step).over(within)).join(offsets, ["trace_id", "split"])
    return df.withColumn("timestamp_ns", F.when(F.col("relative"), F.col("offset") + F.col("upto")).otherwise(F.col("stamp"))).drop("split", "upto", "offset")


def read(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(frames, meta) of ASC files; a malformed ``base`` line is an error."""
    rows = lines(spark, path)
    one = F.count_if((F.col("radix") != 16) | F.col("relative"))
    state = headers(rows).agg(F.max("fault").alias("fault"), F.max("relative").alias("relative"), one.alias("other")).first()
    if state["fault"]:
        raise TraceError("a base line is malformed")
    parsed = parse(rows) if state["other"] else parse(rows, 16, False)  # hex and absolute is also what holds without a header
    parsed = run_clocks(parsed) if state["relative"] else parsed.withColumn("timestamp_ns", F.col("stamp"))
    frames = frames_of(parsed)
    ms = wall_clock_ms(F.regexp_replace("line", r"^(date|Begin Triggerblock) +", ""))
    starts = rows.where(F.col("line").startswith("date ") | F.col("line").startswith("Begin Triggerblock ")).select("trace_id", "seq", F.col("line").startswith("Begin").alias("trigger"), ms.alias("ms")).where("ms is not null")
    first_date, last_trigger = F.min_by(F.when(~F.col("trigger"), F.col("ms")), F.when(~F.col("trigger"), F.col("seq"))), F.max_by(F.when(F.col("trigger"), F.col("ms")), F.when(F.col("trigger"), F.col("seq")))
    starts = starts.groupBy("trace_id").agg(F.coalesce(last_trigger, first_date).alias("measurement_start_ms"))
    data = (F.col("status") == "frame") & (F.col("kind") == "data")
    meta = parsed.groupBy("trace_id").agg(
        F.count(F.when(data, 1)).alias("valid_message_count"), F.count(F.when(F.col("status") == "skipped", 1)).alias("skipped_line_count"),
        F.max(F.when(data, F.col("timestamp_ns"))).alias("duration_ns"),
    )
    return frames, meta.join(starts, "trace_id", "left").select("trace_id", F.lit("asc").alias("trace_type"), "measurement_start_ms", "valid_message_count", "skipped_line_count", "duration_ns")
