"""N-gram Jaccard join: groups of documents whose sets of word n-grams overlap, by a prefix-tree join.

1. A pass over the texts gives each document its set's size and a 128-bit hash of the set. Documents with
   equal sets are one class from here on, whatever their number: the smallest doc_id stands for it.
2. A second pass gives signatures: the range of hashes is cut into m equal pieces, with m above the largest possible difference between two linked
   sets, so at least one piece of two linked sets has the same content. A signature is a piece's content. No linked pair
   is lost; what two sets merely share in passing (a common line) does not make whole pieces equal.
   Linked sets have not one but room + 1 equal pieces at least, so each set leaves out the room commonest ones of its signatures, in one
   order for all: the rarest that two linked sets share is left out by neither. Pieces that are equal by chance or
   by a passage, which would string more and more unlike documents together as the input grows, are mostly gone then.
3. Sets with a common signature are gathered into blocks (connected components, in Spark).
   Each block's sets form a trie that is joined with itself (``trie_join``). A block beyond ``BLOCK_TOKENS`` is dealt out over
   several tries. Sets with a common signature that are not in one group then are compared again: those with a signature that more than
   FEW have by pairs of parts of the blocks that such signatures make, other pairs one by one.

Cases: a null or wordless text has an empty set and is linked with nothing (its component is its own doc_id); a null
doc_id cannot stand for a component: such a row gets its size and a null component_id and links nothing; rows that repeat a doc_id
are in one component, and each input row gives a row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, release, table
from .components import components
from .shingles import U, sets, splitmix
from .trie_join import groups

#: Elements of the sets that one trie holds at most (8 bytes each); a set counts for SET_COST more, for its nodes.
BLOCK_TOKENS, SET_COST = 1_000_000, 50
#: Sets with a signature, beyond which not all their pairs are listed.
FEW = 8
#: Sets that a task remembers to have signed.
SEEN = 100_000


def _differ(total: int, num: int, den: int) -> int:
    """Largest symmetric difference of two linked sets with so many elements together."""
    return total * (den - num) // (den + num)


def _pieces(differ: int) -> int:
    """Number of pieces for a largest difference: the next rung of a ladder, with room for empty pieces."""
    need = differ + 1 if differ < 4 else differ + 2 + differ // 8
    rung = 1
    while rung < need:
        rung = rung + 1 if rung < 4 else rung * 5 // 4 + 1
    return rung


def plans(n: int, num: int, den: int) -> list[tuple[int, int]]:
    """(pieces, largest difference) of every rung that a linked pair with a set of n elements can call for."""
    rungs: dict[int, int] = {}
    low, high = n + -(-n * num // den), n + n * den // num
    for differ in range(_differ(low, num, den), _differ(high, num, den) + 1):
        rungs[_pieces(differ)] = differ
    return sorted(rungs.items())


def signatures(x: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a sorted set and, for each, its plan: pieces << 32 | room, where a linked set has room + 1 of these signatures at least."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(splitmix(x))])
        sigs, of = [], []
        for m, differ in plans(len(x), num, den):
            edges = (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(U)
            cut = np.concatenate([[0], np.searchsorted(x, edges), [len(x)]])
            size = np.diff(cut)
            room = m - int((size == 0).sum()) - differ - 1
            sig = splitmix((sums[cut[1:]] - sums[cut[:-1]]) ^ splitmix(np.arange(m, dtype=U) + U(m << 20)))
            keep = size > 0 if room >= 0 else size >= 0
            sigs.append(sig[keep])
            of.append(np.full(int(keep.sum()), (m << 32) + max(room, 0)))
    return np.concatenate(sigs), np.concatenate(of)


def _hashes(x: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    with np.errstate(over="ignore"):
        return int(splitmix(x).sum(dtype=U)), int(splitmix(splitmix(x ^ U(0xA5A5A5A5A5A5A5A5)) + U(7)).sum(dtype=U))


def _scan(k: int) -> Callable:
    """Rows (doc_id, text) -> doc_id, size and hashes of its set."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at, size, h = [], [], []
            for i, x in sets(batch.column(1), k):
                at.append(i)
                size.append(len(x))
                h.append(_hashes(x))
            if at:
                signed = lambda v: pa.array(np.array(v, dtype=U).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(size, pa.int64()), signed([a for a, _ in h]), signed([b for _, b in h])], names=["doc_id", "n", "h1", "h2"])

    return scan


def _sign(k: int, num: int, den: int) -> Callable:
    """Texts -> (sig, h1, plan) for the signatures of each set; a set that this task has signed lately is not signed again."""

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            sigs, of, owners, size = [], [], [], 0

            def rows():
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (sigs, owners, of)], names=["sig", "h1", "plan"])

            for _, x in sets(batch.column(0), k):
                if not len(x) or (h := _hashes(x)[0]) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(h)
                s, f = signatures(x, num, den)
                sigs.append(s)
                of.append(f)
                owners.append(np.full(len(s), h, U))
                size += len(s)
                if size > 200_000:
                    yield rows()
                    sigs, of, owners, size = [], [], [], 0
            if sigs:
                yield rows()

    return sign


def _join(k: int, num: int, den: int) -> Callable:
    """Rows (block, id, text) sorted by block -> (u, v): each set that is linked, with one that stands for its group."""

    def flush(ids: list[int], own: list[np.ndarray], out: list[tuple[int, int]]) -> None:
        if len(ids) > 1:
            at = groups(own, num, den)
            low: dict[int, int] = {}
            for i, g in zip(ids, at, strict=True):
                low[g] = min(low.get(g, i), i)
            out += [(i, low[g]) for i, g in zip(ids, at, strict=True) if low[g] != i]

    def join(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, ids, own, out = None, [], [], []
        for batch in batches:
            blocks, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, x in sets(batch.column(2), k):
                if blocks[i] != now:
                    flush(ids, own, out)
                    now, ids, own = blocks[i], [], []
                ids.append(docs[i])
                own.append(x)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["u", "v"])
                out = []
        flush(ids, own, out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["u", "v"])

    return join


def _links(docs: DataFrame, blocks: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links within each block of (block, id); the texts are fetched by doc_id."""
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(blocks, "id").select("block", "id", "text")
    dealt = texts.repartition("block").sortWithinPartitions("block", "id")
    return materialize(dealt.mapInArrow(_join(k, num, den), "u long, v long"), "links")


def _split(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """Of (sig, id): the runs whose members are not yet all in one group, with each member's group and the number of members."""
    now = runs.join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_runs = now.groupBy("sig").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("r"), F.min("id").alias("first")).where("a <> b")
    return now.join(open_runs.select("sig", "r", "first"), "sig").select("sig", "id", "root", "r", "first")


def _parts(sized: DataFrame) -> DataFrame:
    """(id, n, block) with the number of tries that each block takes."""
    parts = sized.groupBy("block").agg(F.ceil(F.sum(F.col("n") + SET_COST) / (BLOCK_TOKENS + SET_COST)).alias("parts"))
    return sized.select("id", "n", "block").join(parts, "block")


def _part(x: str) -> Column:
    """One of the tries of a block, for an id."""
    return F.pmod(F.xxhash64(x), F.col("parts"))


def _again(todo: DataFrame, sizes: DataFrame) -> list[DataFrame]:
    """Blocks (block, id) in which every two sets meet that have a signature in common but no group: by pairs of parts, and each
    set with the larger ids that it shares rarer signatures with."""
    hot = materialize(components(todo.where(F.col("r") > FEW).select("id", "first"), "id", "first").withColumnRenamed("root", "block"), "hot")
    parts = _parts(hot.join(sizes, "id"))
    dealt = parts.select("id", "block", "parts", _part("id").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("q"))
    dealt = dealt.where("p <> q or parts = 1").select("id", F.xxhash64("block", F.least("p", "q"), F.greatest("p", "q")).alias("block"))
    rare = todo.where(F.col("r") <= FEW).join(hot, "id", "left").select("sig", "id", "root", "block")
    a, b = (rare.select("sig", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "root", "block")]) for side in "ab")
    pairs = a.join(b, "sig").where("id_a < id_b and root_a <> root_b and coalesce(block_a <> block_b, true)").select("id_a", "id_b").distinct()
    stars = _parts(pairs.select(F.col("id_b").alias("id"), F.col("id_a").alias("block")).join(sizes, "id")).select("id", "block", _part("id").alias("p"))
    stars = materialize(stars, "stars")
    ends = stars.select(F.col("block").alias("id"), "block", "p").distinct().unionByName(stars)
    return [dealt, ends.select("id", F.xxhash64("block", "p").alias("block"))]


def linked(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: sets of k-word shingles linked at a Jaccard similarity of num/den."""
    scan = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan(k), "doc_id long, n long, h1 long, h2 long"), "sets")
    full = scan.where("n > 0 and doc_id is not null")
    # classes of equal sets; a repeated doc_id with different texts ties its classes together below
    classes = materialize(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n")), "classes")
    rows = docs.where("doc_id is not null").select("text").mapInArrow(_sign(k, num, den), "sig long, h1 long, plan long")
    by_sig = Window.partitionBy("sig")
    runs = rows.select("*", F.count("*").over(by_sig).alias("n_run"), F.min("h1").over(by_sig).alias("a"), F.max("h1").over(by_sig).alias("b")).where("a <> b")
    runs = materialize(runs.select("sig", "h1", "plan", "n_run").distinct().join(classes.select("h1", "id"), "h1").drop("h1"), "runs")
    place = F.row_number().over(Window.partitionBy("id", "plan").orderBy(F.desc("n_run"), "sig"))
    kept = runs.select("sig", "id", "plan", place.alias("place")).where(F.col("place") > F.col("plan") % (1 << 32)).select("sig", "id")
    kept = kept.select("*", F.min("id").over(by_sig).alias("first"), F.max("id").over(by_sig).alias("last")).where("first <> last").drop("last")
    kept = materialize(kept, "kept")
    release(docs.sparkSession)
    block = components(kept.select("id", "first"), "id", "first").withColumnRenamed("root", "block")
    sized = materialize(_parts(block.join(classes.select("id", "n"), "id")), "blocks")
    links = _links(docs, sized.select("id", F.xxhash64("block", _part("id")).alias("block")), k, num, den)
    found = [links]
    large = sized.where("parts > 1")
    if large.limit(1).count():
        todo = materialize(_split(kept.join(large.select("id"), "id", "left_semi").select("sig", "id"), components(links)), "todo")
        if todo.limit(1).count():
            found += [_links(docs, b, k, num, den) for b in _again(todo, classes.select("id", "n"))]
            for more in found[1:]:
                links = links.unionByName(more)
            discard(todo)
    # rows that repeat a doc_id tie their classes together
    ties = full.select("doc_id", "h1", "h2").join(classes.select("h1", "h2", "id"), ["h1", "h2"])
    again = full.groupBy("doc_id").agg(F.count("*").alias("c"), F.min("h1").alias("a"), F.max("h1").alias("b")).where("c > 1 and a <> b").select("doc_id")
    tied = ties.join(again, "doc_id").select(F.col("id").alias("u"), F.col("doc_id").alias("v"))
    roots = components(links.unionByName(tied))
    discard(runs, kept, sized, *found)
    release(docs.sparkSession)
    named = classes.select("h1", "h2", "id").join(roots, "id", "left").select("h1", "h2", F.coalesce("root", "id").alias("root"))
    out = scan.join(named, ["h1", "h2"], "left")
    own = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.least("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def drop_near_copies(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest doc_id stays (of rows that repeat it,
    the one with the smallest hash). Documents without words, or without doc_id, stay."""
    names = docs.columns
    group = linked(docs, k, num, den).where("component_id <> doc_id").select("doc_id").distinct()
    left = docs.select(F.struct(*names).alias("__row"), "doc_id").join(group, "doc_id", "left_anti")
    by_id = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col("__row")[c] for c in names if c in ("text", "lang", "source")]))
    twice = left.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 and doc_id is not null")
    once = left.join(twice.select("doc_id"), "doc_id", "left_anti")
    first = left.join(twice.select("doc_id"), "doc_id", "left_semi").withColumn("place", F.row_number().over(by_id)).where("place = 1").drop("place")
    return once.unionByName(first).select(*[F.col("__row")[c].alias(c) for c in names])


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), k=3, num=90, den=100)
