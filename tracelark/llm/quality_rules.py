"""Quality rules with adaptive thresholds.

Every document gets a few integer measures. Per language and source, a mergeable quantile sketch of each measure over the documents that pass
the base rule
(logarithmic buckets with counts: two sketches merge by adding counts, in any order, with the same result)
gives the median and a high quantile; a fence above it, ``REACH`` times their spread away, replaces a fixed cutoff, and the documents are
joined with the fences of their group. No cutoff bounds a fence; only the spread has a least value (``MEASURES``), for measures
that are the same in most documents.
Groups of fewer than ``MIN_GROUP`` documents use the sketch of their language, and below that the one of the corpus:
both are merges of the same sketches.

All expressions are Spark's own. Nulls and edge cases: a null text has no words (all measures 0, ``base_failed`` true);
a null ``lang`` or ``source`` is a group of its own; a group without a document that passes the base rule has null fences;
repeated rows are judged each by itself; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, checkpoint, table

MIN_WORDS = 50
MIN_GROUP = 20
#: Buckets of the sketch: values below 64 exactly, then 32 buckets for each doubling (an error of at most about 3 %).
EXACT, FINE = 64, 32
#: Fence: a high quantile plus REACH times its distance from the median, or times the noise of a typical text, if that is more.
REACH = 3
#: measure -> (percent of the high quantile, what it is counted in). Rates are per 10,000 words (or lines), word lengths in hundredths of a
#: character. Lines and word groups repeat in a few sound documents of every group, so their fences start from further up.
MEASURES = {"symbol_rate": (90, "n_words"), "dup_line_rate": (99, "n_lines"), "repeat_rate": (99, "n_words"), "mean_word": (90, "n_words")}
#: Sizes whose medians say what a typical text of a group is.
SIZES = ("n_words", "n_lines")
#: Salts by which the rows of one group are spread when they meet their fences.
SALTS = 16


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+)"), F.lit(1))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, even inside further lambdas."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more in the text.

    Windows are compared by a 64-bit hash first; only those whose hash repeats are compared as strings, so the count is exact.
    """

    def gram_hash(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def starts(w: Column, h: Column) -> Column:
        """Sorted starts of the windows that repeat, given the windows' hashes."""
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        maybe = _let(
            by_hash,
            lambda s: F.filter(
                F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])),
                lambda x: x.isNotNull(),
            ),
        )
        text = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        by_text = F.sort_array(F.transform(maybe, lambda i: F.struct(text(i).alias("g"), i.alias("i"))))
        return _let(
            by_text,
            lambda s: F.sort_array(
                F.filter(
                    F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"]), x["i"])),
                    lambda x: x.isNotNull(),
                )
            ),
        )

    def covered(s: Column) -> Column:
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
        return F.aggregate(s, zero, step, lambda a: a["n"])

    return F.when(
        F.size(words) >= 4,
        _let(words, lambda w: _let(gram_hash(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(starts(w, h))).otherwise(0))),
    ).otherwise(0)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts of the contract and ``base_failed``, from one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.regexp_replace(F.col("text"), f"[{SPACE}]+", "")
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    df = docs.select("doc_id", "lang", "source", text.alias("text")).select(
        "doc_id", "lang", "source",
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate(F.col("text"), "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        _let(_words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("rep"))).alias("words"),
    )
    df = df.select(
        "doc_id", "lang", "source", F.col("words.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.col("lines.dup").cast("long").alias("n_dup_lines"), F.col("words.rep").cast("long").alias("n_repeat_words"),
        F.col("lines.n").cast("long").alias("n_lines"),
    )
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def rates(df: DataFrame) -> DataFrame:
    """The measures that are judged, as whole numbers, so that they fall into the same bucket everywhere."""
    per = lambda a, b: F.expr(f"cast({a} * 10000 div greatest({b}, 1) as bigint)")
    return df.withColumns(
        {
            "symbol_rate": per("n_symbols", "n_words"),
            "dup_line_rate": per("n_dup_lines", "n_lines"),
            "repeat_rate": per("n_repeat_words", "n_words"),
            "mean_word": F.expr("cast(word_chars * 100 div greatest(n_words, 1) as bigint)"),
        }
    )


def bucket(name: str) -> Column:
    """Number of the sketch's bucket of a column of whole numbers of 0 or more; integer arithmetic only."""
    bits = f"length(bin({name}))"
    return F.expr(f"cast(if({name} < {EXACT}, {name}, {EXACT} + ({bits} - 7) * {FINE} + shiftright({name}, greatest({bits} - 6, 0)) - {FINE}) as bigint)")


def lower_edge(b: Column) -> Column:
    """The smallest number of a bucket."""
    octave, step = F.floor((b - EXACT) / FINE), (b - EXACT) % FINE
    return F.when(b < EXACT, b).otherwise(((FINE + step) * F.pow(F.lit(2.0), octave + 1)).cast("long")).cast("long")


def sketches(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, bucket, n: a sketch for each group and measure. Adding the n of equal buckets merges sketches."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(m).alias("bucket")) for m in (*MEASURES, *SIZES)]))
    return df.select(*keys, pairs.alias("m")).groupBy(*keys, "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, total, median, high. A group has a bounded number of buckets, which are folded in one pass."""
    percent = F.create_map(*[x for m, p in [*((m, p) for m, (p, _) in MEASURES.items()), *((s, 50) for s in SIZES)] for x in (F.lit(m), F.lit(p))])
    rows = sketch.groupBy(*keys, "measure").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b")).withColumn("percent", percent[F.col("measure")])

    def at(percent: str) -> Column:
        place = F.expr(f"(total * {percent} + 99) div 100")
        zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))
        step = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["at"].isNull() & (a["seen"] + x["n"] >= place), x["bucket"]).otherwise(a["at"]).alias("at"))
        return lower_edge(F.aggregate("b", zero, step, lambda a: a["at"]))

    return rows.select(*keys, "measure", "total", at("50").alias("median"), at("percent").alias("high"))


def fences(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """keys, n_<tag>, <measure>_<tag>: one row of upper fences per group.

    Where most texts of a group are alike in a measure, its spread says nothing. So the spread counts as no less than the noise of a text
    of the group's median size: one symbol, one line or one window of three words more, or the error of a mean word length.
    """
    at = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    q = quantiles(sketch, keys).groupBy(*keys).agg(F.max("total").alias(f"n_{tag}"), *[at(s, "median").alias(s) for s in SIZES], *[at(m, c).alias(f"{m}_{c}") for m in MEASURES for c in ("median", "high")])
    noise = {m: F.expr(f"{10_000 * (3 if m == 'repeat_rate' else 1)} div greatest({size}, 1)") for m, (_, size) in MEASURES.items()}
    noise["mean_word"] = F.floor(F.col("mean_word_median") / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double")))
    fence = {m: (F.col(f"{m}_high") + REACH * F.greatest(F.col(f"{m}_high") - F.col(f"{m}_median"), noise[m])).cast("long") for m in MEASURES}
    return q.select(*keys, f"n_{tag}", *[c.alias(f"{m}_{tag}") for m, c in fence.items()])


def judge(docs: DataFrame) -> DataFrame:
    """One row per document with the counts, the group's fences and ``kept``."""
    df = checkpoint(measures(docs))
    df = rates(df).withColumns({"g_lang": F.coalesce("lang", F.lit("\x00null")), "g_source": F.coalesce("source", F.lit("\x00null"))})
    own = checkpoint(sketches(df.where("not base_failed"), ["g_lang", "g_source"]))
    by_lang = merge(own, ["g_lang"])
    limits = fences(own, ["g_lang", "g_source"], "g").join(fences(by_lang, ["g_lang"], "l"), "g_lang")
    limits = limits.withColumn("one", F.lit(1)).join(fences(merge(own.withColumn("one", F.lit(1)), ["one"]), ["one"], "a"), "one")
    chosen = {m: F.when(F.col("n_g") >= MIN_GROUP, F.col(f"{m}_g")).when(F.col("n_l") >= MIN_GROUP, F.col(f"{m}_l")).otherwise(F.col(f"{m}_a")) for m in MEASURES}
    limits = limits.select("g_lang", "g_source", *[c.alias(f"max_{m}") for m, c in chosen.items()])
    salted = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    df = df.withColumn("salt", F.pmod(F.xxhash64("doc_id", "word_chars", "n_words"), F.lit(SALTS)).cast("int"))
    df = df.join(salted, ["g_lang", "g_source", "salt"], "left")  # a group of failed documents alone has no fences
    fits = F.lit(True)
    for m in MEASURES:
        fits = fits & (F.col(m) <= F.col(f"max_{m}"))
    return df.withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(True)))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *[f"max_{m}" for m in MEASURES],
    )
