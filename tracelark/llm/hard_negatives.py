"""Hard-negative mining with exact integer scores from a residue number system.

Vectors become integers. Anchors and candidates are dealt into blocks of bounded size, every pair of blocks is a tile of one task. A tile
multiplies the matrices modulo several small primes in float32: residues are centred and the components taken in strips, so that every sum
stays below 2**24 and is exact. The Chinese remainder theorem (in mixed radix with centred digits, where the signed score comes out by itself)
gives the scores. A first pass finds the positives of each anchor, a second one the negatives in the window of each positive.
The best of the tiles are chosen by windows that keep k rows for each key before they shuffle.

Cases: rows without a vec_id, a label or a vector, with an empty vector, and with null or non-finite components take no part; nor do rows whose
scores no 64-bit integer is sure to hold (components of about 2**31 / sqrt(length) or more); vectors of different lengths are never compared; rows that
repeat a vec_id are anchors and candidates each by itself, and only the very same row is no candidate; ties go to the smaller vec_id; an
anchor without positives, or a positive without negatives in its window, gives no rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Rows of a block of anchors and of candidates; anchors of a tile that are multiplied at a time.
ANCHOR_BLOCK, CANDIDATE_BLOCK, STRIP = 2048, 8192, 256
#: Components that are multiplied before the residues are taken again.
DEPTH = 1024
#: Bits that all scores stay below, with their sign.
SCORE_BITS = 62

_FOUND = "anchor_row long, anchor_id long, place int, positive_id long, positive_score long, row long, vec_id long, score long"


def integers(vectors: DataFrame, label: Column, scale: float) -> DataFrame:
    """row (unique), vec_id, label, v (array of long) of the rows that take part, in the shared folder."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    largest = F.array_max(F.transform(x, lambda e: F.abs(e) * scale)) + 1
    rows = vectors.where(F.col("vec_id").isNotNull() & label.isNotNull() & (F.size(x) > 0) & finite & (largest * largest * F.size(x) < 2.0**SCORE_BITS))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(x, lambda e: F.floor(e * F.lit(scale)).cast("long")).alias("v"))
    return materialize(rows, "negatives-rows")


def moduli(depth: int, bound: int) -> list[int]:
    """The largest odd primes whose centred residues multiply exactly in float32 over ``depth`` components, as many as signed scores up to ``bound`` need."""
    half = int(((1 << 24) / max(depth, 1)) ** 0.5)
    while depth * half * half >= 1 << 24:
        half -= 1
    out, product, p = [], 1, 2 * half + 1
    while product <= 2 * bound:
        if p < 3:
            raise ValueError("too few primes for these scores")
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """The residue of least absolute value."""
    return (x + p // 2) % p - p // 2


class Residues:
    """A matrix of integers as float32 matrices of centred residues, one for each modulus."""

    def __init__(self, rows: np.ndarray, primes: list[int]):
        self.primes, self.parts = primes, [centred(rows, p).astype(np.float32) for p in primes]

    def times(self, other: Residues, a: int, b: int) -> np.ndarray:
        """Exact int64 products of rows a to b with all rows of ``other``."""
        score, weight, digits = np.zeros((b - a, len(other.parts[0])), np.int64), 1, []
        for i, p in enumerate(self.primes):
            left, right = self.parts[i][a:b], other.parts[i]
            rest = np.zeros_like(score)
            for at in range(0, left.shape[1], DEPTH):
                rest += (left[:, at : at + DEPTH] @ right[:, at : at + DEPTH].T).astype(np.int64)
            digit = centred((rest - self._mod(digits, p)) % p * pow(weight, -1, p), p)  # the next one in mixed radix
            score += digit * np.int64(_signed(weight))  # what overflows on the way comes back, as the score itself fits
            digits.append(digit)
            weight *= p
        return score

    def _mod(self, digits: list[np.ndarray], p: int) -> np.ndarray | int:
        """The number with the mixed-radix ``digits``, modulo p."""
        out, weight = 0, 1
        for q, digit in zip(self.primes, digits, strict=False):
            out = (out + digit % p * (weight % p)) % p
            weight *= q
        return out


def _signed(x: int) -> int:
    """x modulo 2**64, as a signed number."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _first(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``at``, the k of largest score; the earlier ones among equals."""
    own = scores[at]
    if len(at) > k:
        least = np.partition(own, len(at) - k)[len(at) - k]
        above, ties = at[own > least], at[own == least]
        at = np.concatenate([above, ties[: k - len(above)]])
    return at[np.lexsort((at, -scores[at]))]


def _tile(k: int, window: tuple[int, int, int] | None) -> Callable:
    """Anchors x candidates -> for each anchor its k best rows of the same label, or for each of its positives the k best others in the window."""

    def tile(key, anchors, candidates):
        import pyarrow as pa

        out: list[tuple] = []
        if anchors.num_rows and candidates.num_rows:
            width = key[0].as_py()
            a, c = (np.asarray(t.column("v").combine_chunks().flatten()).reshape(-1, width) for t in (anchors, candidates))
            row, vec, label = (np.asarray(candidates.column(n)) for n in ("row", "vec_id", "label"))
            order = np.lexsort((row, vec))
            c, row, vec, label = c[order], row[order], vec[order], label[order]
            bound = max(1, int(np.abs(a).max()) * int(np.abs(c).max()) * width)
            primes = moduli(min(width, DEPTH), bound)
            left, right = Residues(a, primes), Residues(c, primes)
            ids, own, its = (anchors.column(n).to_pylist() for n in ("row", "vec_id", "label"))
            positives = anchors.column("positives").to_pylist() if window else [None] * len(ids)
            for at in range(0, len(ids), STRIP):
                scores = left.times(right, at, min(len(ids), at + STRIP))
                for i, s in enumerate(scores, at):
                    if window is None:
                        for j in _first(s, np.flatnonzero((label == its[i]) & (row != ids[i])), k):
                            out.append((ids[i], own[i], 0, own[i], 0, row[j], vec[j], s[j]))
                        continue
                    other = label != its[i]
                    least, scale, most = window
                    for place, positive, p in ((x["place"], x["positive_id"], x["positive_score"]) for x in positives[i]):
                        low, high = -(-least * p // scale), most * p // scale
                        if low <= high:
                            for j in _first(s, np.flatnonzero(other & (s >= low) & (s <= high)), k):
                                out.append((ids[i], own[i], place, positive, p, row[j], vec[j], s[j]))
        types = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5]
        names = [c.split()[0] for c in _FOUND.split(", ")]
        return pa.table([pa.array([int(r[j]) for r in out], t) for j, t in enumerate(types)], names=names)

    return tile


def _search(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], k: int, window: tuple[int, int, int] | None) -> DataFrame:
    n_a, n_c = blocks
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    fresh = lambda *names: [F.col(n).alias(n) for n in names]  # noqa: E731 - both sides come from one table: a cogroup mixes up columns of one identity
    more = ["positives"] if window else []
    left = anchors.select(F.size("v").alias("dim"), block(n_a).alias("ab"), every(n_c).alias("cb"), *fresh("row", "vec_id", "label", "v", *more))
    right = rows.select(F.size("v").alias("dim"), every(n_a).alias("ab"), block(n_c).alias("cb"), *fresh("row", "vec_id", "label", "v"))
    keys = ["dim", "ab", "cb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(k, window), _FOUND)
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, n_positives: int, n_negatives: int, window: tuple[int, int, int]) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over the rows of ``integers``.

    A negative's score lies from window[0] / window[1] to window[2] / window[1] times the positive's.
    """
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(is_anchor, 1)).alias("a")).first()
    blocks = max(1, -(-sizes["a"] // ANCHOR_BLOCK)), max(1, -(-sizes["n"] // CANDIDATE_BLOCK))
    anchors = rows.where(is_anchor)
    near = _search(anchors, rows, blocks, n_positives, None)
    listed = near.groupBy(F.col("anchor_row").alias("row")).agg(F.collect_list(F.struct(F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))).alias("positives"))
    listed = materialize(listed, "negatives-positives")  # n_positives a row at most
    found = _search(anchors.join(listed, "row"), rows, blocks, n_negatives, window)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(integers(table(spark, sf_dir, "embeddings"), label, 256.0), F.col("vec_id") % 50 == 0, 5, 3, (50, 100, 95))
