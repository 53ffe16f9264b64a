"""What the text recordings share: lines with their order, and tokens to numbers, identifiers and payloads, all as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_COLUMNS = ("trace_id", "seq", "timestamp_ns", "channel", "direction", "kind", "can_id", "is_extended", "is_fd", "dlc", "payload_len", "payload")
FRAME_SCHEMA = "trace_id string, seq long, timestamp_ns long, channel int, direction string, kind string, can_id int, is_extended boolean, is_fd boolean, dlc int, payload_len int, payload binary"
#: Places of a line's number: the split of the file above, the line within the scan below.
LINE_BITS = 33


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """trace_id, seq, line, t (tokens): the lines that are not blank. A file is read in splits; seq rises with the place in the file."""
    raw = spark.read.option("lineSep", "\n").text(path)
    split = F.shiftleft(F.expr("_metadata.file_block_start div 4096").cast("long"), LINE_BITS)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << LINE_BITS) - 1))
    df = raw.select(F.col("_metadata.file_path").alias("trace_id"), (split + at).alias("seq"), F.btrim(F.make_valid_utf8("value"), F.lit(" \t\r")).alias("line"))
    return df.where("line <> ''").withColumn("t", F.split("line", r"[ \t\r]+"))


def token(i: int | Column) -> Column:
    """A token or null; i counts from 0."""
    return F.get(F.col("t"), F.lit(i) if isinstance(i, int) else i)


def decimal_to_ns(text: Column, places: int) -> tuple[Column, Column]:
    """Nanoseconds of a decimal text whose unit has so many places, and whether it is a decimal text at all.

    Too many places, or a number out of range, give null nanoseconds.
    """
    form = text.rlike(r"^[0-9]+(\.[0-9]+)?$")
    whole, part = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    scale = 10**places
    units = F.try_add(F.try_multiply(whole.try_cast("bigint"), F.lit(scale).cast("bigint")), F.coalesce(F.rpad(part, places, "0").try_cast("bigint"), F.lit(0).cast("bigint")))
    return F.when(form & (F.length(part) <= places), units), F.coalesce(form, F.lit(False))


def number(text: Column, radix: Column | int, most: int) -> Column:
    """An unsigned number of radix 10 or 16 up to ``most``, else null."""
    def of(r: int) -> Column:
        digits = F.regexp_replace(text, "^0+(?=.)", "")
        value = F.when(text.rlike("^[0-9]+$" if r == 10 else "^[0-9a-fA-F]+$") & (F.length(digits) <= 15), F.conv(digits, r, 10).try_cast("bigint"))
        return F.when(value <= most, value)

    return of(radix) if isinstance(radix, int) else F.when(radix == 16, of(16)).otherwise(of(10))


def channel(text: Column) -> tuple[Column, Column]:
    """Channel (0 is none) and whether the text is one."""
    value = number(text, 10, 65535)
    return F.nullif(value, F.lit(0).cast("bigint")).cast("int"), value.isNotNull()


def direction(text: Column) -> Column:
    return F.when(text == "Rx", "rx").when(text == "Tx", "tx").otherwise("unknown")


def payload(first: Column, n: Column, radix: Column | int) -> Column:
    """The bytes of n tokens from ``first`` on; null if one is missing or no byte.

    Hexadecimal tokens of two digits, as nearly all are, take one pattern and one conversion for all of them.
    """
    own = F.slice(F.col("t"), first + 1, F.greatest(n, F.lit(0)))
    whole = F.array_join(own, "")

    def of(r: int) -> Column:
        form = "^0*[0-9a-fA-F]{1,2}$" if r == 16 else "^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
        digit = (lambda x: F.right(F.lpad(x, 2, "0"), F.lit(2))) if r == 16 else (lambda x: F.lpad(F.conv(x, 10, 16), 2, "0"))
        slow = F.when((F.size(own) == n) & F.forall(own, lambda x: x.rlike(form)), F.unhex(F.array_join(F.transform(own, digit), "")))
        if r == 10:
            return slow
        pairs = F.array_join(own, " ")
        plain = (F.length(pairs) == 3 * n - 1) & pairs.rlike("^[0-9a-fA-F]{2}( [0-9a-fA-F]{2})*$")
        return F.when(plain, F.unhex(whole)).otherwise(slow)

    return of(radix) if isinstance(radix, int) else F.when(radix == 16, of(16)).otherwise(of(10))


def settled(df: DataFrame) -> DataFrame:
    """The same rows, through a generator of one row each.

    Filters are not moved across it. A filter that is moved below columns which build on one another is written out down to the line's
    tokens, where each use of a column repeats all that it is made of.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def frames_of(parsed: DataFrame) -> DataFrame:
    """The frames of parsed lines: what kind of frame has which columns."""
    known = F.col("kind").isin("data", "remote")
    data = F.col("kind") == "data"
    return settled(parsed).where("status = 'frame'").select(
        "trace_id", "seq", "timestamp_ns", F.when(F.col("sourced"), F.col("channel")).alias("channel"),
        F.when(F.col("sourced"), F.col("direction")).otherwise("unknown").alias("direction"), "kind",
        F.when(known, F.col("id")).cast("int").alias("can_id"), F.when(known, F.col("extended")).alias("is_extended"),
        (data & F.col("fd")).alias("is_fd"), F.when(known, F.col("dlc")).otherwise(0).cast("int").alias("dlc"),
        F.when(data, F.col("n")).otherwise(0).cast("int").alias("payload_len"), F.when(data, F.col("bytes")).alias("payload"),
    )
