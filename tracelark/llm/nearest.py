"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks of bounded size; every pair of blocks is one tile of one task. In a tile the unit
vectors are int8 with a scale each; the product of the int8 tiles gives every similarity with a bound on its error, pairs that cannot be
among the k best vec_ids are dropped by those bounds, and the rest is recomputed in double precision from the original vectors. Tiles' results
are merged by heaps. The result is exact: the bounds never drop a true neighbour.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a vec_id, take no part; rows that
share the query's vec_id are no candidates; a vec_id with several rows is found once, with its largest score; vectors of
different lengths are never compared; ties go to the smaller vec_id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Rows of a block of queries and of candidates.
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
#: Queries of a tile that are multiplied at a time.
STRIP = 256


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double), dim of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & some).select(F.col("vec_id").cast("long"), v.alias("v"), F.size(v).alias("dim"))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as float32, whose products stay exact), scales, and norms of the coded part and of its error."""
    scale = np.abs(x).max(axis=1) / 127.0
    code = np.rint(x / scale[:, None])
    coded = code * scale[:, None]
    return code.astype(np.float32), scale, np.sqrt((coded * coded).sum(1)), np.sqrt(((x - coded) ** 2).sum(1))


def _matrix(column) -> np.ndarray:
    import pyarrow as pa

    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return np.asarray(flat.flatten()).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 0))


def _tile(k: int) -> Callable:
    def tile(key, queries, candidates):
        import pyarrow as pa

        ids: list[np.ndarray] = [np.zeros(0, np.int64)]
        found: list[np.ndarray] = [np.zeros(0, np.int64)]
        scores: list[np.ndarray] = [np.zeros(0)]
        if queries.num_rows and candidates.num_rows:
            q, c = _matrix(queries.column("v")), _matrix(candidates.column("v"))
            qid, cid = np.asarray(queries.column("vec_id")), np.asarray(candidates.column("vec_id"))
            order = np.argsort(cid, kind="stable")
            c, cid = c[order], cid[order]
            heads = np.flatnonzero(np.concatenate([[True], cid[1:] != cid[:-1]]))  # first row of each vec_id
            # scaled by the largest component first, so that no norm overflows or vanishes
            qs, cs = q / np.abs(q).max(1)[:, None], c / np.abs(c).max(1)[:, None]
            qn, cn = np.sqrt((qs * qs).sum(1)), np.sqrt((cs * cs).sum(1))
            qc, qscale, qnorm, qerr = quantise(qs / qn[:, None])
            cc, cscale, cnorm, cerr = quantise(cs / cn[:, None])
            exact = 127 * 127 * q.shape[1] < 1 << 24
            cct = (cc if exact else cc.astype(np.float64)).T
            for a in range(0, len(q), STRIP):
                b = min(len(q), a + STRIP)
                near = (qc[a:b] if exact else qc[a:b].astype(np.float64)) @ cct * qscale[a:b, None] * cscale
                bound = qerr[a:b, None] * cnorm + qnorm[a:b, None] * cerr + qerr[a:b, None] * cerr + 1e-12
                low, high = near - bound, near + bound
                own = qid[a:b, None] == cid
                low[own], high[own] = -np.inf, -np.inf
                # a vec_id counts once in the result, so its rows count once, by the best, in the bound
                sure = np.maximum.reduceat(low, heads, axis=1) if len(heads) < len(cid) else low
                rank = min(k, sure.shape[1])
                least = np.partition(sure, sure.shape[1] - rank, axis=1)[:, sure.shape[1] - rank]
                qi, ci = np.nonzero((high >= least[:, None]) & ~own)
                for at in range(0, len(qi), 1 << 16):
                    i, j = qi[at : at + (1 << 16)] + a, ci[at : at + (1 << 16)]
                    ids.append(qid[i])
                    found.append(cid[j])
                    scores.append((qs[i] * cs[j]).sum(1) / (qn[i] * cn[j]))
        out = _best(zip(np.concatenate(ids).tolist(), np.concatenate(found).tolist(), np.concatenate(scores).tolist(), strict=True), k)
        return pa.table([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return tile


def _best(rows, k: int) -> list[tuple[int, int, float]]:
    """The k best (query, vector, score) of each query, by a heap for each; a vector counts once."""
    heaps: dict[int, list[tuple[float, int]]] = {}
    for q, v, s in rows:
        heap = heaps.setdefault(q, [])
        if len(heap) >= k and (s, -v) <= heap[0]:
            continue
        old = next((x for x in heap if x[1] == -v), None)
        if old is not None:
            if old[0] >= s:
                continue
            heap.remove(old)
            heapq.heapify(heap)
        (heapq.heappush if len(heap) < k else heapq.heapreplace)(heap, (s, -v))
    return [(q, -v, s) for q, heap in heaps.items() for s, v in sorted(heap, reverse=True)]


def _merge(k: int) -> Callable:
    """Rows (query_id, vec_id, score) sorted by query -> the k best of each; only one query's candidates are held, k from each of its tiles at most."""

    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def ranked(rows: list[tuple[int, int, float]]):
            out = [(q, rank, v, s) for rank, (q, v, s) in enumerate(_best(rows, k), 1)]
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["query_id", "rank", "vec_id", "score"])

        held: list[tuple[int, int, float]] = []
        for batch in batches:
            for row in zip(*[batch.column(j).to_pylist() for j in range(3)], strict=True):
                if held and held[0][0] != row[0]:
                    yield ranked(held)
                    held = []
                held.append(row)
                if len(held) > 1000 * k:
                    held = _best(held, k)
        yield ranked(held)

    return merge


def nearest(vectors: DataFrame, is_query, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest cosine to each query row, out of all others."""
    rows = usable(vectors)
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    n_q, n_c = max(1, -(-sizes["q"] // QUERY_BLOCK)), max(1, -(-sizes["n"] // CANDIDATE_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where(is_query).select("dim", block(n_q).alias("qb"), every(n_c).alias("cb"), "vec_id", "v")
    candidates = rows.select("dim", every(n_q).alias("qb"), block(n_c).alias("cb"), "vec_id", "v")
    keys = ["dim", "qb", "cb"]
    tiles = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(_tile(k), "query_id long, vec_id long, score double")
    return tiles.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)
