"""Merkle manifest of a dataset by checkpoint and recompute.

Every row is a leaf; the leaves of a source, in the order of their doc_id, are the lowest level of its tree, and the roots of the sources' trees
are the leaves of one tree over all. Only every STEP-th level is written. A proof needs the levels between as well: for each aligned subtree
(one stored node and its at most 16 ** STEP stored descendants) they are regenerated from the descendants, the siblings of each
descendant are emitted, and the levels are dropped again. Paths go down from the root, so an upper path is held once for a subtree, not
once for a leaf. All of it is DataFrame functions; no group is larger than a subtree, however many rows a source has.

Cases: nulls in any column count as ``-``; rows without a doc_id come first in their source; rows that repeat a doc_id are leaves of their
own, in the order of their hashes (equal rows are alike in every column); a null source is a source, the first one; an empty table gives no
rows; texts of any length are hashed whole; extra columns are ignored. Nothing is tampered with in a row without a doc_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Children of a node, as bits, and levels from one stored level to the next.
BITS, STEP = 4, 2
FAN = 1 << BITS
#: One level of a proof: the siblings to the left and to the right of the node, as text.
_PATH = "array<struct<before:string,after:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return digest(F.concat(field(F.col("doc_id").cast("long")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars").cast("long")), field(text)))


def leaves(docs: DataFrame) -> DataFrame:
    """tree (the source, so written that null comes first), doc_id, node, tampered (null where nothing is tampered with)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    forged = F.when(F.crc32(F.col("doc_id").cast("long").cast("string")) % 5 == 0, leaf(F.translate("text", upper, lower)))
    return docs.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("node"), forged.alias("tampered"))


def number(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with pos, the place of a row in its tree from 0, and height, the levels above the leaves of that tree.

    A range sort deals the rows out evenly, whatever the trees' sizes (equal rows too, by a tie-breaker); a small table with a row
    for each range and tree says where each tree goes on in each range.
    """
    keys = ["tree", *order, "tie"]
    laid = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = materialize(laid.drop("tie").withColumn("range", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "merkle-order")
    parts = laid.groupBy("range", "tree").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    count, before = "sum(n) OVER (PARTITION BY tree)", "sum(n) OVER (PARTITION BY tree ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    parts = parts.selectExpr("range", "tree", "first", f"coalesce({before}, 0) AS before", f"{count} AS size")
    height = F.when(F.col("size") <= 1, 0).otherwise(F.length(F.hex(F.col("size") - 1)))
    return laid.join(parts, ["range", "tree"]).select(*rows.columns, (F.col("before") + F.col("seq") - F.col("first")).alias("pos"), height.cast("int").alias("height"))


def climb(nodes: Column) -> Column:
    """The level above an aligned run of nodes."""
    return F.transform(F.sequence(F.lit(1), F.size(nodes), F.lit(FAN)), lambda i: digest(F.array_join(F.slice(nodes, i, FAN), "")))


def subtrees(level: DataFrame, depth: int, step: int, *extra: str) -> DataFrame:
    """tree, height, block, own (the stored nodes of an aligned subtree in order), l0 to l{step}: its levels, those between regenerated."""
    own = F.sort_array(F.collect_list(F.struct("pos", "node", *extra)))
    out = level.where(F.col("height") > depth).groupBy("tree", "height", F.shiftright("pos", BITS * step).alias("block")).agg(own.alias("own")).withColumn("l0", F.col("own.node"))
    for k in range(step):
        out = out.withColumn(f"l{k + 1}", climb(F.col(f"l{k}")))
    return out


def store(lowest: DataFrame, step: int) -> list[DataFrame]:
    """Every ``step``-th level of the trees (tree, height, pos, node), from the leaves up; a tree's root is in the last of its levels."""
    levels = [lowest]
    top = lowest.agg(F.max("height")).first()[0] or 0
    for depth in range(0, top, step):
        tops = F.array(*[F.col(f"l{k + 1}")[0] for k in range(step)])
        up = subtrees(levels[-1], depth, step).select("tree", "height", F.col("block").alias("pos"), F.element_at(tops, F.least(F.lit(step), F.col("height") - depth)).alias("node"))
        levels.append(materialize(up, "merkle-level"))
    return levels


def roots(levels: list[DataFrame], step: int) -> DataFrame:
    """tree, node: the root of every tree."""
    return reduce(DataFrame.union, [x.where((F.col("height") <= k * step) & (F.col("height") > (k - 1) * step)).select("tree", "node") for k, x in enumerate(levels)])


def siblings(i: Column, k: int) -> Column:
    """The others of the run, at level l{k} of a subtree, that lies above its stored node ``i``."""
    at = F.shiftright(i, BITS * k)
    start = F.shiftleft(F.shiftright(at, BITS), BITS)
    nodes = F.col(f"l{k}")
    return F.struct(F.array_join(F.slice(nodes, start + 1, at - start), "").alias("before"), F.array_join(F.slice(nodes, at + 2, FAN - 1 - (at - start)), "").alias("after"))


def proofs(levels: list[DataFrame], step: int, tops: DataFrame, extra: list[str]) -> DataFrame:
    """tree, pos, node, ``extra``, path of every leaf; ``tops`` has tree, path and more columns, which are handed down, of every root."""
    handed = [c for c in tops.columns if c not in ("tree", "path")]
    found = None
    for k in reversed(range(len(levels))):
        depth, more = k * step, extra if k == 0 else []
        own = levels[k].where(F.col("height") <= depth).select("tree", "pos", "node", *more).join(tops, "tree")
        if found is not None:
            between = lambda i, depth=depth: F.slice(F.array(*[siblings(i, j) for j in range(step)]), F.lit(1), F.least(F.lit(step), F.col("height") - depth))
            each = F.transform("own", lambda x, i: F.struct(x["pos"].alias("pos"), x["node"].alias("node"), *[x[c].alias(c) for c in more], between(i).alias("low")))  # noqa: B023
            upper = found.select("tree", F.col("pos").alias("block"), F.col("path").alias("upper"), *handed)
            below = subtrees(levels[k], depth, step, *more).join(upper, ["tree", "block"]).select("tree", "upper", *handed, F.inline(each))
            own = own.unionByName(below.withColumn("path", F.concat("low", "upper")).drop("low", "upper"))
        found = own
    return found


def fold(node: Column) -> Column:
    """The root that a node and the siblings of its path lead to."""
    return F.aggregate("path", node, lambda h, p: digest(F.concat(p["before"], h, p["after"])))


def manifest(docs: DataFrame, step: int = STEP) -> tuple[list[DataFrame], list[DataFrame]]:
    """The stored levels of the sources' trees and of the tree over their roots; the first level of either are its leaves."""
    own = store(materialize(number(leaves(docs), "doc_id", "node"), "merkle-leaves"), step)
    subroots = roots(own, step).select(F.lit("").alias("tree"), F.col("tree").alias("member"), "node")
    return own, store(materialize(number(subroots, "member"), "merkle-subroots"), step)


def prove(stored: tuple[list[DataFrame], list[DataFrame]], step: int = STEP) -> DataFrame:
    """tree, pos, doc_id, node (the leaf), tampered, subroot, root, path (from the leaf to the root) of every leaf."""
    own, over = stored
    top = roots(over, step).select("tree", F.array().cast(_PATH).alias("path"), F.col("node").alias("root"))
    tops = proofs(over, step, top, ["member"]).select(F.col("member").alias("tree"), "path", F.col("node").alias("subroot"), "root")
    return proofs(own, step, tops, ["doc_id", "tampered"])


def audit(docs: DataFrame, step: int = STEP) -> DataFrame:
    """Every row with its proof's hash, and with the root that its leaf, tampered with where that is due, folds to."""
    siblings_text = F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), "")
    out = prove(manifest(docs, step), step)
    out = out.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", digest(siblings_text).alias("proof_sha256"), fold(F.coalesce("tampered", "node")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
