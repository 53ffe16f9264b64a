"""Mixing sources to target weights as a time-varying curriculum.

Each source has a target number of words (weights, filled up to three times the source's size) and a weight schedule
over training time from 0 to 1. The schedule's integral is the source's cumulative demand of words;
a document that occupies words c..c+size of its source's stream is placed at the time at which the demand reaches
the middle of its slot, by inverting the integral, and the documents are range-sorted by that position.
A source whose target exceeds its size is streamed again, up to three times.

All expressions are Spark's own. A source of any size is dealt over ``(source, bucket of a hash)``, so its running sum
is a sum within buckets plus the buckets' offsets; only one row per source and bucket meets in one place.

Nulls and edge cases: a null text has size 0 and is never taken; a null source is a source of its own, ordered last;
a null doc_id is ordered by its text like any other; repeated rows are documents of their own; an empty table gives no rows;
extra columns are kept by ``mix`` and ignored by the query; a source without words has target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_parts, table, word_count

WEIGHTS = (1, 2, 3)
MOST = 3
#: Knots (time, weight) of each weight's schedule, in order of WEIGHTS; only their shape counts. Light sources come
#: early, heavy ones late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (0.5, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
SEED = "curriculum"


def inverse_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of a piecewise linear schedule reaches ``share`` of its total."""
    area = [(a[1] + b[1]) / 2 * (b[0] - a[0]) for a, b in zip(knots, knots[1:], strict=False)]
    total, done = sum(area), 0.0
    out = F.lit(float(knots[-1][0]))
    pieces = []
    for (t0, w0), (t1, w1), size in zip(knots, knots[1:], area, strict=False):
        pieces.append((done / total, (done + size) / total, t0, t1, w0, w1))
        done += size
    for low, high, t0, t1, w0, w1 in reversed(pieces):
        need = (share - F.lit(low)) * F.lit(total)  # w0*x + (w1-w0)/(2*(t1-t0))*x*x = need
        bend = (w1 - w0) / (t1 - t0)
        x = need / F.lit(w0) if bend == 0 else need * 2.0 / (F.lit(w0) + F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + need * F.lit(2.0 * bend))))
        out = F.when(share < F.lit(high), F.lit(t0) + x).otherwise(out)
    return F.least(F.lit(float(knots[-1][0])), F.greatest(F.lit(float(knots[0][0])), out))


def position(share: Column) -> Column:
    """Training time of a place in the source's stream, by the schedule of the source's weight."""
    out = inverse_demand(share, SCHEDULES[-1])
    for w, knots in zip(WEIGHTS[:-1], SCHEDULES[:-1], strict=True):
        out = F.when(F.col("weight") == w, inverse_demand(share, knots)).otherwise(out)
    return out


def targets(sizes: DataFrame) -> DataFrame:
    """no_src, src, source_size -> with weight, target: one row per source.

    The targets are the fixed point of sharing the words of all sources by weight and stopping at MOST times a source's
    size: min(MOST * size, level * weight), with the level found in order of MOST * size / weight.
    """
    by_name = Window.orderBy("no_src", "src")
    ratio = Window.orderBy("fill", "no_src", "src")
    ahead = ratio.rowsBetween(Window.unboundedPreceding, -1)
    weigh = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    df = sizes.withColumn("weight", weigh).withColumn("fill", MOST * F.col("source_size") / F.col("weight").cast("double"))
    every = Window.partitionBy()
    df = df.withColumns(
        {
            "left_words": F.sum("source_size").over(every) - F.coalesce(F.sum(MOST * F.col("source_size")).over(ahead), F.lit(0)),
            "left_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(ahead), F.lit(0)),
        }
    ).withColumn("level", F.col("left_words") / F.col("left_weight").cast("double"))
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "no_src", "src", "level"))).over(every)["level"]
    target = F.when(level.isNull() | (F.col("fill") <= level), (MOST * F.col("source_size")).cast("double")).otherwise(F.col("weight") * level)
    return df.select("no_src", "src", "source_size", "weight", target.alias("target"))


def plan(docs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, full, taken, copies, start, first_position.

    ``full`` whole rounds of the source are taken, and of the next round the documents up to the target, in the order of a hash;
    the one document on the border is taken in part (``taken`` words), or counts as a copy if half of it is taken.
    """
    spark = docs.sparkSession
    buckets = max(16, 4 * shuffle_parts(spark))
    key = F.md5(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string")))
    base = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"),
        F.col("source").isNull().alias("no_src"), F.coalesce("source", F.lit("")).alias("src"),
        F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")))).alias("tie"), *extra,
    )
    slot = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int")
    base = materialize(base.withColumn("slot", slot), "mix")
    own = ["no_src", "src", "slot"]
    parts = base.groupBy(*own).agg(F.sum("size").alias("words"))
    offset = F.coalesce(F.sum("words").over(Window.partitionBy("no_src", "src").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = parts.groupBy("no_src", "src").agg(F.sum("words").alias("source_size"))
    parts = parts.withColumn("offset", offset).drop("words").join(targets(sizes), ["no_src", "src"])
    order = Window.partitionBy(*own).orderBy("key", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = base.withColumn("upto", F.sum("size").over(order)).join(parts, own)
    whole = F.floor(F.col("target") + 0.5).cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size")).cast("long")).otherwise(0)
    df = df.withColumn("start", F.col("offset") + F.col("upto") - F.col("size")).withColumn("full", full)
    rest = F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("full") * F.col("source_size") - F.col("start")))
    df = df.withColumn("rest", rest)
    middle = (F.col("start") + F.col("size") / 2.0) / F.col("target")
    taken = (F.col("full") * F.col("size") + F.col("rest")).cast("long")
    copies = F.col("full") + F.when((F.col("size") > 0) & (2 * F.col("rest") >= F.col("size")), 1).otherwise(0)
    return df.select(
        "doc_id", "source", "size", "source_size", "target", "weight", "start", taken.alias("taken"),
        F.when(F.col("size") > 0, copies).otherwise(0).cast("int").alias("copies"),
        F.when(taken > 0, F.round(position(middle), 6)).alias("first_position"), *extra,
    )


def mix(docs: DataFrame) -> DataFrame:
    """The documents in training order: each as often as the mix takes it, range-sorted by position."""
    names = docs.columns
    df = plan(docs.select("doc_id", "source", "text", F.struct(*names).alias("__row")), ["__row"])
    df = df.where("copies > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    middle = (F.col("start") + F.col("size") / 2.0 + F.col("round") * F.col("source_size")) / F.col("target")
    df = df.select(position(middle).alias("position"), F.col("doc_id").alias("tie"), "__row")
    return df.orderBy("position", "tie").select(*[F.col("__row")[c].alias(c) for c in names])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = plan(table(spark, sf_dir, "documents"))
    return df.orderBy("first_position", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "copies", "first_position")
