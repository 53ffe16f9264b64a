"""Toxicity scores: a lexicon learnt from labels, misspellings by Levenshtein automata, quotation told from abuse by context.

1. From a bounded sample of labelled rows (``SAMPLE`` of either label, by a hash of doc_id) the words and word beginnings that
   set toxic texts apart become the lexicon; the sample bounds their number. A term needs no pure record: it is taken if, over all
   its texts or those that have it outside quotation or several times, the lift is ``LIFT`` and no chance of all keys tried.
2. The lexicon's trie, intersected with Levenshtein automata, is a table (``levenshtein``; several where one would grow too large) that every word of a text walks.
3. Each match has a context: quotation marks around it and words of reporting before it count for quotation, an address
   ("you") for abuse. Matches by term, edits, context and whether they recur are given a weight: the lift of their precision in the sample.
4. A text's score is one minus the product of what its distinct matches leave open.

Cases: null and empty texts, and texts without matches, get the share of toxic rows among sample texts without matches;
labels that are null are not learnt from; several labels of a doc_id count as toxic if one is; without usable labels every score
is 0; repeated rows are scored each by itself; an empty table gives no rows; extra columns are kept by ``reject`` and ignored by the query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, held_out, materialize, table, utf8_slices
from .levenshtein import Tables, classes

#: Labelled rows of either kind that are learnt from at most.
SAMPLE = 10_000
#: Lengths of the word beginnings that are counted.
STEMS = range(4, 9)
#: A single finer term replaces a beginning if it keeps this share of the evidence.
FINER = 0.9
#: A match whose precision lifts the sample's share of toxic texts by less than this says nothing.
LIFT = 0.3
#: Characters of context on either side.
CONTEXT = 80
QUOTES = "\"“”„«»‹›"
REPORTING = ("said", "says", "wrote", "quote", "quoted", "called", "word", "term", "sagte", "schrieb", "zitat", "wort", "dit", "écrit", "mot", "dijo", "dice", "cita", "palabra")
ADDRESS = ("you", "your", "du", "ihr", "dich", "tu", "vous", "toi", "usted", "eres", "ti")
REJECT = 0.5


def _words(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The slice's text, its classes, starts and ends of its words, and the first character of each row."""
    raw = data.tobytes()
    text = raw.decode("utf-8", "replace")
    if len(raw) == len(text):
        heads = offsets
        own = lut[data]
    else:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        heads = lead[offsets]
        own = lut[points]
    full = own > 0
    first, last = full.copy(), full.copy()
    first[1:] &= ~full[:-1]
    last[:-1] &= ~full[1:]
    inner = heads[(heads > 0) & (heads < len(own))]  # a word ends where its row ends
    first[inner] = full[inner]
    last[inner - 1] = full[inner - 1]
    return text, own, np.flatnonzero(first), np.flatnonzero(last) + 1, heads


def _quoted(text: str, start: int, end: int, low: int, high: int) -> bool:
    left, right = text[max(low, start - CONTEXT) : start], text[end : min(high, end + CONTEXT)]
    left, right = left.rsplit("\n", 1)[-1], right.split("\n", 1)[0]
    score = 0.6 * (any(q in left for q in QUOTES) and any(q in right for q in QUOTES))
    near = left.lower().replace(":", " ").split()[-6:]
    score += 0.3 * any(w.strip(QUOTES + ",.") in REPORTING for w in near)
    score -= 0.3 * any(w.strip(QUOTES + ",.") in ADDRESS for w in near[-3:] + right.lower().split()[:3])
    return score >= 0.5


def matches(column, lexicon: Tables, lut: np.ndarray) -> Iterator[tuple[int, set[int]]]:
    """(row, features) of the rows with a match; a feature is 8 * term + 4 * edits + 2 * quoted + again (two or more such words)."""
    for base, data, offsets in utf8_slices(column, 1 << 20):
        if not len(data):
            continue
        text, own, starts, ends, heads = _words(data, offsets, lut)
        found = lexicon.walk(own, starts, ends)
        rows: dict[int, Counter] = {}
        hits = np.flatnonzero(found >= 0)
        owner = np.searchsorted(heads, starts[hits], side="right") - 1
        for h, row in zip(hits.tolist(), owner.tolist(), strict=True):
            quoted = _quoted(text, int(starts[h]), int(ends[h]), int(heads[row]), int(heads[row + 1]))
            rows.setdefault(base + row, Counter())[2 * int(found[h]) + quoted] += 1
        yield from ((row, {2 * f + (n > 1) for f, n in seen.items()}) for row, seen in rows.items())


def _family(text: str) -> Column:
    """A key that near copies mostly share and other texts do not: the smallest hash of a window of three words."""
    words = F.split(F.lower(F.col(text)), rf"[{SPACE}]+")
    least = F.transform(F.array(words), lambda w: F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))
    return least[0]


def sample(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """text, label of at most SAMPLE training rows of either label, chosen by a hash of doc_id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max(label).alias("label")).withColumn("h", F.xxhash64("doc_id"))
    few = [rows.where(F.col("label") == v).orderBy("h", "doc_id").limit(SAMPLE).select("doc_id", "label") for v in (0, 1)]
    ids = F.broadcast(few[0].unionByName(few[1]))  # at most 2 * SAMPLE rows of 12 bytes
    return materialize(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id").select("text", "label"), "labelled")


#: Texts whose record may make a term: all that have it, those with it outside quotation, those with it twice or more there.
KINDS = ("all", "plain", "again")


def _count_keys(batches: Iterator) -> Iterator:
    """For each batch: key, whole, and the numbers of its toxic and other texts that have it, by KINDS."""
    import pyarrow as pa

    lut = classes({})
    for batch in batches:
        label = batch.column(1).to_pylist()
        counts: dict[tuple[str, bool], list[int]] = {}
        for base, data, offsets in utf8_slices(batch.column(0), 1 << 20):
            original, _, starts, ends, heads = _words(data, offsets, lut)
            text = original.lower() if len(original.lower()) == len(original) else "".join(c.lower() if len(c.lower()) == 1 else c for c in original)
            upto = np.searchsorted(starts, heads)
            for i in range(len(heads) - 1):
                low, high = int(heads[i]), int(heads[i + 1])
                own = [(text[starts[w] : ends[w]], int(starts[w]), int(ends[w])) for w in range(upto[i], upto[i + 1])]
                every = Counter(w for w, _, _ in own)
                plain = every
                if sum(original.count(q, low, high) for q in QUOTES) > 1:  # else nothing is quoted
                    plain = Counter(w for w, a, b in own if not _quoted(original, a, b, low, high))
                kinds = [Counter(), Counter()]
                for kind, words in zip(kinds, (every, plain), strict=True):
                    for w, n in words.items():
                        if 3 <= len(w) <= 24:
                            kind[w, True] += n
                        for size in STEMS:
                            if len(w) >= size:
                                kind[w[:size], False] += n
                toxic = label[base + i] > 0
                for key in kinds[0]:
                    row = counts.setdefault(key, [0] * 6)
                    n = kinds[1][key]
                    row[not toxic] += 1
                    row[2 + (not toxic)] += n > 0
                    row[4 + (not toxic)] += n > 1
        numbers = [pa.array([n[k] for n in counts.values()], pa.int64()) for k in range(6)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.string()), pa.array([w for _, w in counts], pa.bool_()), *numbers], names=["key", "whole", *(f"{x}_{k}" for k in KINDS for x in ("toxic", "other"))])


def _pick(rows: list[tuple[str, bool, float]], price: float) -> list[tuple[str, bool]]:
    """Of the telling keys (key, whole, evidence) the lexicon, strongest first.

    A word hangs on its longest beginning, and that on the shorter ones. From the leaves up, a beginning stays as one term, or the terms
    below it do, whichever has more evidence once each term has paid ``price``; a single finer term is preferred if it keeps FINER of it.
    """
    evidence = {(k, whole): g for k, whole, g in rows}
    best: dict[tuple[str, bool], tuple[float, list[tuple[str, bool]]]] = {}
    below: dict[tuple[str, bool], list[tuple[str, bool]]] = {}
    out: list[tuple[str, bool]] = []
    for key in sorted(evidence, key=lambda x: (-len(x[0]), not x[1], x[0])):  # longer ones first, whole words before beginnings
        k, whole = key
        kids = below.get(key, [])
        finer, terms = sum(best[x][0] for x in kids), [t for x in kids for t in best[x][1]]
        gain = evidence[key] - price
        best[key] = (finer, terms) if finer > gain or (len(terms) == 1 and finer >= FINER * gain) else (gain, [key])
        over = next(((k[:n], False) for n in range(min(len(k), STEMS[-1]) if whole else len(k) - 1, STEMS[0] - 1, -1) if (k[:n], False) in evidence), None)
        if over is None:
            out += best[key][1]
        else:
            below.setdefault(over, []).append(key)
    return sorted(out, key=lambda x: (-evidence[x], x))


def learn_lexicon(rows: DataFrame) -> list[tuple[str, bool]]:
    """The lexicon from rows (text, label). Of a family of copies one text counts: its words are no evidence of their own."""
    rows = materialize(rows.withColumn("family", _family("text")).dropDuplicates(["family", "label"]).select("text", "label"), "families")
    size = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("label") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = size.get(True, 0), size.get(False, 0)
    if not n_toxic or not n_other:
        return []
    names = [f"{x}_{k}" for k in KINDS for x in ("toxic", "other")]
    kind = "key string, whole boolean, " + ", ".join(f"{x} long" for x in names)
    keys = materialize(rows.select("text", "label").mapInArrow(_count_keys, kind).groupBy("key", "whole").agg(*[F.sum(x).alias(x) for x in names]).where("toxic_all + other_all > 1"), "keys")
    tried = keys.count()
    share = n_toxic / (n_toxic + n_other)
    # a term's price: with it hardly one key of all those tried, in any kind, would pass by chance
    price = math.log(2 * len(KINDS) * max(tried, 1))

    def evidence(toxic: Column, other: Column) -> Column:
        """Log-likelihood of the texts' labels at the key's own share of toxic ones over the sample's; null if it lifts too little."""
        n, zero = toxic + other, F.lit(0.0)
        own = toxic / n
        gain = toxic * F.log(own / share) + F.when(other > 0, other * F.log((1 - own) / (1 - share))).otherwise(zero)
        return F.when((n > 0) & (own - share >= LIFT * (1 - share)), gain)

    best = F.greatest(*[F.coalesce(evidence(F.col(f"toxic_{k}"), F.col(f"other_{k}")), F.lit(0.0)) for k in KINDS])
    telling = keys.where("toxic_all > 2").select("key", "whole", best.alias("evidence")).where(F.col("evidence") > price).collect()  # the labelled sample bounds their number
    return _pick([(r["key"], r["whole"], r["evidence"]) for r in telling], price)


class Model:
    def __init__(self, lexicon: Tables | None, base: float, weight: dict[int, float]):
        self.lexicon, self.base, self.weight = lexicon, base, weight

    def score(self, features: set[int]) -> float:
        left = 1.0 - self.base
        for f in sorted(features):
            left *= 1.0 - self.weight.get(f, 0.0)
        return min(1.0, max(0.0, 1.0 - left))


#: Precision of a kind of match before any was seen: by edits and quotation.
PRIOR = {(0, 0): 0.9, (0, 1): 0.45, (1, 0): 0.6, (1, 1): 0.3}


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    rows = sample(docs, labels, "toxic")
    terms = learn_lexicon(rows)
    if not terms:
        share = rows.agg(F.avg((F.col("label") > 0).cast("double"))).first()[0]
        return Model(None, float(share or 0.0), {})
    lexicon = Tables(terms)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lut = classes(lexicon.letter)
        for batch in batches:
            label = [x > 0 for x in batch.column(1).to_pylist()]
            seen = Counter((-1, t) for t in label)
            for i, features in matches(batch.column(0), lexicon, lut):
                seen[-1, label[i]] -= 1
                seen.update((f, label[i]) for f in features)
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in seen], pa.int32()), pa.array([n * t for (_, t), n in seen.items()], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["feature", "toxic", "n"])

    counted = rows.select("text", "label").mapInArrow(count, "feature int, toxic long, n long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).collect()
    counts = {r["feature"]: (r["toxic"], r["n"]) for r in counted}  # at most 8 rows for each term, and one
    toxic, n = counts.pop(-1, (0, 0))
    base = min(0.4, (toxic + 0.1) / (n + 1.0))
    kind = {k: [0, 0] for k in PRIOR}
    for f, (t, m) in counts.items():
        own = kind[f >> 2 & 1, f >> 1 & 1]
        own[0], own[1] = own[0] + t, own[1] + m
    prior = {k: (t + 4 * PRIOR[k]) / (m + 4) for k, (t, m) in kind.items()}
    share = rows.agg(F.avg((F.col("label") > 0).cast("double"))).first()[0]
    weight = {}
    for f in range(8 * len(terms)):
        k = (f >> 2 & 1, f >> 1 & 1)
        t, m = counts.get(f, (0, 0))
        precision = (t + 2 * prior[k]) / (m + 2)
        lift = (precision - share) / (1 - share)
        weight[f] = lift if lift >= LIFT else 0.0
    return Model(lexicon, base, weight)


def _scores(batch_column, model: Model, lut) -> np.ndarray:
    out = np.full(len(batch_column), model.score(set()))
    if model.lexicon is not None:
        for i, features in matches(batch_column, model.lexicon, lut):
            out[i] = model.score(features)
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lut = classes(model.lexicon.letter) if model.lexicon else None
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), model, lut))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, most: float = REJECT) -> DataFrame:
    """The rows whose score is below ``most``, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lut = classes(model.lexicon.letter) if model.lexicon else None
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), model, lut) < most))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
