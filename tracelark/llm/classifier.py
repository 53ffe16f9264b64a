"""Quality classifier: random Fourier features over document statistics, ridge by summed normal equations, isotonic calibration.

1. Statistics of every text (Spark expressions, one pass), none of which is a label, a language, a source or an id.
2. The statistics, scaled by the training rows' means and deviations, go through ``FEATURES`` random cosines, whose inner products approximate
   a Gaussian kernel.
3. Each partition of the training rows gives its part of the normal equations; Spark adds them up and the driver solves a system
   of fixed size.
4. The training scores, counted in bins, are made monotone by pooling adjacent violators and interpolated.

Cases: null and empty texts have zero statistics and are scored like any row; labels that are null are not learnt from, of several labels
of a doc_id the largest counts; without training rows of both kinds the score is the share of good ones (or 0.5); repeated rows are
scored each by itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, held_out, materialize, table

FEATURES = 96
RIDGE = 1e-3
BINS = 1000
SEED = 20240501
THRESHOLD = 0.3
STATISTICS = ("log_words", "word_length", "symbols", "upper", "digits", "exclaims", "bars", "stops", "dup_lines", "distinct_words", "line_length", "non_ascii")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda chars: F.length("text") - F.length(F.translate(F.col("text"), chars, ""))
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    words = F.regexp_extract_all(F.col("text"), F.lit(f"([^{SPACE}]+)"), F.lit(1))
    counted = lambda a: F.transform(F.array(a), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))[0]
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", F.length("text").alias("n"), counted(words).alias("w"), counted(lines).alias("l"),
        without("#*$%&<>").alias("symbols"), without("|").alias("bars"), without("!").alias("exclaims"), without(".").alias("stops"), without("0123456789").alias("digits"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).alias("upper"), (F.octet_length("text") - F.length("text")).alias("wide"),
    )
    n, w, lines_n = F.greatest("n", F.lit(1)), F.greatest(F.col("w.n"), F.lit(1)), F.greatest(F.col("l.n"), F.lit(1))
    return df.select(
        "doc_id", F.log1p(F.col("w.n").cast("double")).alias("log_words"), (F.col("n") / w).alias("word_length"), (F.col("symbols") / w).alias("symbols"),
        (F.col("upper") / n).alias("upper"), (F.col("digits") / n).alias("digits"), (F.col("exclaims") / w).alias("exclaims"), (F.col("bars") / w).alias("bars"),
        (F.col("stops") / w).alias("stops"), ((F.col("l.n") - F.col("l.d")) / lines_n).alias("dup_lines"), (F.col("w.d") / w).alias("distinct_words"),
        F.log1p(F.col("n") / lines_n).alias("line_length"), (F.col("wide") / n).alias("non_ascii"),
    )


class Kernel:
    """x -> a constant, the scaled statistics and the random cosines of a Gaussian kernel over them."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0.0, 1.0 / np.sqrt(d), (d, FEATURES))
        self.b = rng.uniform(0.0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8.0, 8.0)
        return np.hstack([np.ones((len(x), 1)), x, np.sqrt(2.0 / FEATURES) * np.cos(x @ self.w + self.b)])


def _columns(batch) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(c), dtype=np.float64) for c in STATISTICS])


def _sums(kernel: Kernel) -> Callable:
    """The partition's part of the normal equations, as cells (i, j, v); j = -1 is the right side."""

    def sums(batches: Iterator) -> Iterator:
        import pyarrow as pa

        gram = right = None
        for batch in batches:
            if batch.num_rows:
                z, y = kernel(_columns(batch)), np.asarray(batch.column("label"), dtype=np.float64)
                gram = z.T @ z if gram is None else gram + z.T @ z
                right = z.T @ y if right is None else right + z.T @ y
        if gram is not None:
            i, j = np.triu_indices(len(gram))
            cells = [np.concatenate([i, np.arange(len(right))]), np.concatenate([j, np.full(len(right), -1)]), np.concatenate([gram[i, j], right])]
            yield pa.RecordBatch.from_arrays([pa.array(cells[0].astype(np.int32)), pa.array(cells[1].astype(np.int32)), pa.array(cells[2])], names=["i", "j", "v"])

    return sums


def pool(centres: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of the shares y/n: places and values of a non-decreasing polygon."""
    blocks: list[list[float]] = []
    for c, m, s in zip(centres, n, y, strict=True):
        blocks.append([c * m, m, s])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


class Model:
    def __init__(self, kernel: Kernel | None, weights: np.ndarray, places: np.ndarray, values: np.ndarray):
        self.kernel, self.weights, self.places, self.values = kernel, weights, places, values

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(x), self.values[0])
        return np.clip(np.interp(self.raw(x), self.places, self.values), 0.0, 1.0)


def learn(stats: DataFrame, labels: DataFrame, label: str) -> Model:
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(label) > 0).cast("double").alias("label"))
    rows = materialize(stats.join(marks, "doc_id").select(*STATISTICS, "label"), "training")
    got = rows.agg(F.count("*").alias("n"), F.avg("label").alias("share"), *[f(c).alias(f"{k}_{c}") for c in STATISTICS for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not got["n"] or got["share"] in (0.0, 1.0):
        return Model(None, np.zeros(0), np.zeros(1), np.array([got["share"] if got["n"] else 0.5]))
    kernel = Kernel(np.array([got[f"m_{c}"] for c in STATISTICS]), np.array([max(got[f"s_{c}"], 1e-6) for c in STATISTICS]))
    cells = rows.mapInArrow(_sums(kernel), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # a fixed number of cells
    size = 1 + len(STATISTICS) + FEATURES
    gram, right = np.zeros((size, size)), np.zeros(size)
    for r in cells:
        if r["j"] < 0:
            right[r["i"]] = r["v"]
        else:
            gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["v"]
    weights = np.linalg.solve(gram + RIDGE * got["n"] * np.eye(size), right)
    model = Model(kernel, weights, np.zeros(1), np.zeros(1))

    def binned(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                at = np.floor(np.clip(model.raw(_columns(batch)), -1.0, 2.0) * BINS).astype(np.int32)
                bins, index = np.unique(at, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(np.bincount(index).astype(np.int64)), pa.array(np.bincount(index, np.asarray(batch.column("label"), dtype=np.float64)))], names=["bin", "n", "y"])

    counts = rows.mapInArrow(binned, "bin int, n long, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()  # 3 * BINS + 1 rows at most
    places, values = pool(np.array([(r["bin"] + 0.5) / BINS for r in counts]), np.array([float(r["n"]) for r in counts]), np.array([r["y"] for r in counts]))
    return Model(kernel, weights, places, values)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row of statistics."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_columns(batch)) if batch.num_rows else np.zeros(0))], names=["doc_id", "score"])

    return stats.select("doc_id", *STATISTICS).mapInArrow(run, "doc_id long, score double")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(statistics(table(spark, sf_dir, "documents")), "statistics")
    out = score(stats, learn(stats, table(spark, sf_dir, "labels"), "quality"))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
