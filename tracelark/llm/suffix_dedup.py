"""Removal of long repeated byte strings by suffix order and longest previous factors.

A string of ``length`` bytes is repeated if it also starts somewhere else. To find all of them without sorting every suffix of the corpus:

1. Anchors. Of each string of the smallest length asked for (``levels[0]``) the gram with the smallest hash is its anchor; equal strings
   have equal anchors at equal places. Consecutive starts with one anchor are a segment: they and the bytes their strings reach
   over, up to the largest length asked for. Texts that are equal as a whole are one text from here on, whatever their number.
2. Only anchors seen twice can belong to a repeat. Equal segments are counted by hash, without their bytes: all strings of a segment that
   stands twice are repeats. Of equal segments one goes on, and only where its anchor has unlike segments.
3. These are dealt by anchor, so all places of a string meet in one task, and joined there into blocks. In a block the suffixes that begin
   at the starts whose string, by its hash, may stand twice are sorted by their first bytes (up to the largest length), with the
   longest common prefixes of neighbours. The previous and next smaller places in that order give every start its longest previous factor; the neighbours on
   either side, whatever their place, give its longest other match (``Factors``).
4. An anchor with more than ``CROWD`` unlike segments (the edge of a passage that very many texts share) would fill a task. Its strings
   are compared by two 64-bit hashes that Spark counts with map-side sums instead; nothing is left out.

``keep="none"`` removes every occurrence, ``keep="first"`` all but the first in order of doc_id and place.

Cases: a null text is empty; texts shorter than a length lose nothing at it; repeated rows (equal doc_id and text) are different places
for ``keep="none"`` and one place for ``keep="first"``, which keeps them all; rows without a doc_id come last, in order of a
hash of the text; one doc_id may have several texts; an empty table gives no rows; extra columns are ignored by the query and kept by ``cleaned``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, release, shuffle_parts, table, utf8_slices
from .shingles import _SPACES, U, splitmix

LENGTH = 400
#: Bytes from which a repeated string counts as part of a passage, and words that a passage has more of.
PASSAGE, PASSAGE_WORDS = 200, 50
#: Bytes of a gram at most; shorter strings take a sixth.
GRAM = 64
#: Unlike segments of one anchor that one task sorts at most (of under levels[0] + levels[-1] bytes each: 2.4 MB for 400).
CROWD = 4_000
#: Bytes that one suffix sort takes at most (one anchor's segments stay together).
BLOCK = 1_200_000
#: Bytes of texts that are hashed at a time.
CHUNK = 1 << 18
#: In no text encoded as UTF-8: ends a segment.
END = b"\xff"

_BASE = 0x9E3779B97F4A7C15 | 1
_BASES = (_BASE, 0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    with np.errstate(over="ignore"):
        out[1:] = U(base)
        np.multiply.accumulate(out, out=out)
    return out


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        got = _POWERS[base] = _powers(base, max(n, 4096))
    return got[:n]


def running(data: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Running sums from which ``hashes`` are taken (base is odd, so its powers can be undone)."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * powers(base, len(data)))])


def hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair."""
    with np.errstate(over="ignore"):
        return splitmix((sums[end] - sums[start]) * powers(pow(base, -1, 1 << 64), len(sums))[start])


def gram_hashes(data: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of data[i:i+k] for each i."""
    n = len(data)
    if n < k:
        return np.zeros(0, U)
    sums = running(data, base)
    with np.errstate(over="ignore"):
        return splitmix((sums[k:] - sums[:-k]) * powers(pow(base, -1, 1 << 64), n - k + 1))


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest entry of every window of w entries, by their upper bits; the first of equals."""
    n = len(h)
    bits = U(max(1, n - 1).bit_length())
    key = (h >> bits << bits) | np.arange(n, dtype=U)
    pad = -n % w
    rows = (np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, U)]) if pad else key).reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[: n - w + 1], left[w - 1 : n]) & ((U(1) << bits) - U(1))).astype(np.int64)


def segments(data: np.ndarray, offsets: np.ndarray, levels: tuple[int, ...], gram: int) -> tuple[np.ndarray, ...]:
    """Segments of the texts data[offsets[i]:offsets[i+1]]: text, anchor's hash, first start, number of starts, bytes and hash of the segment.

    The work goes on chunk by chunk; a segment on the border of two chunks is two segments.
    """
    low, high = levels[0], levels[-1]
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(0, len(data) - low + 1), CHUNK):
        part = data[at : at + CHUNK + low + high]
        n = min(CHUNK, len(data) - low + 1 - at)  # starts
        sums = running(part)
        with np.errstate(over="ignore"):
            h = splitmix((sums[gram : n + low] - sums[: n + low - gram]) * powers(pow(_BASE, -1, 1 << 64), n + low - gram))
        place = window_minima(h, low - gram + 1)
        start = np.arange(at, at + n)
        text = np.searchsorted(offsets, start, side="right") - 1
        end = offsets[text + 1]
        fits = np.flatnonzero(end - start >= low)
        if not len(fits):
            continue
        own = place[fits]
        edge = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (np.diff(fits) > 1)]))
        first, last = fits[edge], fits[np.concatenate([edge[1:], [len(fits)]]) - 1]
        stop = np.minimum(last + high, end[first] - at)
        found.append((text[first], h[own[edge]], first + at - offsets[text[first]], last - first + 1, stop - first, hashes(sums, first, stop)))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, U, np.int64, np.int64, np.int64, U))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    full = ~_SPACES[data]
    first = full.copy()
    first[1:] &= ~full[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = full[heads]
    upto = np.concatenate([[0], np.cumsum(first)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


_SCANNED = "key long, doc_id long, n_bytes long, n_words long, sha string, h array<long>, first array<int>, n array<int>, size array<int>, ph array<long>"


def _scan(levels: tuple[int, ...], gram: int) -> Callable:
    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for base, data, offsets in utf8_slices(batch.column(2), CHUNK):
                rows = len(offsets) - 1
                text, h, first, n, size, ph = segments(data, offsets, levels, gram)
                ends = pa.array(np.searchsorted(text, np.arange(rows + 1)).astype(np.int32))
                columns = (h.view(np.int64), first.astype(np.int32), n.astype(np.int32), size.astype(np.int32), ph.view(np.int64))
                shas = [hashlib.sha256(data[offsets[i] : offsets[i + 1]]).hexdigest() for i in range(rows)]
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in columns]
                plain = [pa.array(np.diff(offsets).astype(np.int64)), pa.array(_word_counts(data, offsets).astype(np.int64)), pa.array(shas)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(base, rows), batch.column(1).slice(base, rows), *plain, *lists], names=[x.split(" ")[0] for x in _SCANNED.split(", ")])

    return scan


def _cut(batches: Iterator) -> Iterator:
    """Rows (id, text, list of segments) -> a row for each segment: anchor, id, first start, number of starts, crowded, its bytes."""
    import pyarrow as pa

    names = ["h", "id", "first", "n", "crowd", "piece"]
    for batch in batches:
        for base, data, offsets in utf8_slices(batch.column(1)):
            raw, ids = data.tobytes(), batch.column(0).slice(base, len(offsets) - 1)
            marks = batch.column(2).slice(base, len(offsets) - 1)
            row = np.repeat(np.arange(len(marks)), np.asarray(marks.value_lengths()))
            h, first, n, size, crowd = marks.flatten().flatten()
            a = offsets[row] + np.asarray(first)
            b = a + np.asarray(size)
            part = np.cumsum(b - a) // 4_000_000  # bytes that go out at a time
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(row)]
            for i, j in zip(edges, edges[1:], strict=False):
                pieces = pa.array([raw[x:y] for x, y in zip(a[i:j].tolist(), b[i:j].tolist(), strict=True)], pa.binary())
                columns = [h.slice(i, j - i), ids.take(pa.array(row[i:j])), *(x.slice(i, j - i) for x in (first, n, crowd)), pieces]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def _ranks(key: np.ndarray, bits: int) -> np.ndarray:
    """Dense ranks of the keys (of so many bits); equal keys have equal ranks."""
    places = len(key).bit_length()
    if bits + places <= 63:  # key and place in one number
        ordered = np.sort((key << places) | np.arange(len(key)))
        order, ordered = ordered & ((1 << places) - 1), ordered >> places
    else:
        order = np.argsort(key)
        ordered = key[order]
    changes = np.zeros(len(order), np.int32)
    np.not_equal(ordered[1:], ordered[:-1], out=changes[1:], casting="unsafe")
    np.cumsum(changes, out=changes)
    out = np.empty(len(order), np.int32)
    out[order] = changes
    return out


def prefix_ranks(data: np.ndarray, most: int) -> list[tuple[int, np.ndarray]]:
    """(k, ranks of the first k bytes of every suffix of k bytes or more) for growing k, up to the last k below ``most``.

    Each step joins the ranks of two or three strings that follow one another.
    """
    bits = len(data).bit_length()
    times = 3 if 3 * bits <= 63 else 2
    steps = [most]
    while steps[-1] > 7:
        steps.append(-(-steps[-1] // times))
    k = steps[-1]
    key = np.zeros(len(data) - k + 1, np.int64)
    for j in range(k):
        key = (key << 8) | data[j : len(data) - k + 1 + j]
    out = [(k, _ranks(key, 8 * k))]
    for to in steps[-2:0:-1]:
        out.append((to, _ranks(_joined(*out[-1], to, np.arange(len(data) - to + 1), times, bits), times * bits)))
    return out


def _joined(k: int, ranks: np.ndarray, to: int, at: np.ndarray, times: int, bits: int) -> np.ndarray:
    """Keys of the first ``to`` bytes at the places ``at``, from the ranks of k bytes."""
    key = ranks[at].astype(np.int64)
    for j in range(1, times):
        key = (key << bits) | ranks[at + min(j * k, to - k)]
    return key


class Factors:
    """Suffix order of some starts in ``data``, truncated to ``most`` bytes, and their longest factors.

    ``place`` orders the starts: of equal strings the one with the smallest place is the first. ``previous`` is the length of the longest
    string at the start that also begins at a smaller place, ``other`` of the longest that begins at any other; neither counts bytes
    beyond ``room`` (those left in the start's own segment).
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, place: np.ndarray, room: np.ndarray, most: int):
        data = np.concatenate([data, np.full(2 * most, 0xFF, np.uint8)])
        self.data, self.most = data, most
        self.levels = prefix_ranks(data, most)
        bits = len(data).bit_length()
        k, ranks = self.levels[-1]
        key = _joined(k, ranks, most, starts, 3 if 3 * bits <= 63 else 2, bits) if k < most else ranks[starts].astype(np.int64)
        rising = bool(np.all(place[1:] > place[:-1]))
        self.order = order = np.argsort(key, kind="stable") if rising else np.lexsort((place, key))
        n = len(order)
        at, left = starts[order], np.minimum(room[order], most)
        common = np.zeros(n + 1, np.int64)  # with the neighbour before; none before the first and after the last
        if n > 1:
            same = key[order[1:]] == key[order[:-1]]
            common[1:n] = np.minimum(np.where(same, most, self._common(at[:-1], at[1:])), np.minimum(left[1:], left[:-1]))
        self.place, self.common = place, common
        self.other = np.empty(n, np.int64)
        self.other[order] = np.maximum(common[:n], common[1:])

    @cached_property
    def previous(self) -> np.ndarray:
        order, n = self.order, len(self.order)
        out = np.empty(n, np.int64)
        out[order] = np.maximum(_smaller(self.place[order], self.common[:n]), _smaller(self.place[order][::-1], self.common[:0:-1])[::-1])
        return out

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefixes of the suffixes at a and b, by descending through the levels, up to ``most``."""
        off = np.zeros(len(a), np.int64)
        for k, ranks in reversed(self.levels):
            for _ in range(2):
                todo = off < self.most
                off += k * (todo & (ranks[a + off * todo] == ranks[b + off * todo]))
        for _ in range(self.levels[0][0] - 1):
            off += (off < self.most) & (self.data[a + off] == self.data[b + off])
        return np.minimum(off, self.most)


def _smaller(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For entries in suffix order the common prefix with the nearest one before that has a smaller place (0: none).

    ``common`` is that with the neighbour before. All entries jump at once: while the place found is not smaller, an entry takes
    over what that one has found, since all in between have larger places still.
    """
    n = len(place)
    to, low = np.arange(-1, n - 1), common.copy()
    todo = np.arange(n)
    while True:
        todo = todo[to[todo] >= 0]
        todo = todo[place[to[todo]] > place[todo]]
        if not len(todo):
            return np.where(to >= 0, low, 0)
        over = to[todo]
        low[todo], to[todo] = np.minimum(low[todo], low[over]), to[over]


def seen_twice(data: np.ndarray, at: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Which of the rising places ``at`` (their segments end at ``end``) begin a string of ``length`` bytes whose hash another of them has as well.

    Equal strings have equal hashes, so the start of no repeat is missing; what else is among them the suffix order sorts out.
    """
    fits = np.flatnonzero(end - at >= length)
    h, own = np.empty(len(fits), U), at[fits]
    edges = np.searchsorted(own, np.arange(0, len(data) + CHUNK, CHUNK))
    for i, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = own[x:y] - i * CHUNK
        h[x:y] = hashes(running(data[i * CHUNK : (i + 1) * CHUNK + length]), part, part + length)
    order = np.argsort(h)
    ordered = h[order]
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    twice = np.zeros(len(at), bool)
    twice[fits[order[same]]] = twice[fits[order[same + 1]]] = True
    return np.flatnonzero(twice)


def _edges(at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last entries of the runs of consecutive places within one segment."""
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (owner[1:] != owner[:-1])]))
    return edge, np.concatenate([edge[1:], [len(at)]]) - 1


def factor_runs(pieces: list[tuple[int, int, int, bytes]], levels: tuple[int, ...], first: bool) -> list[tuple[int, int, int, int]]:
    """Of unlike segments (id, first start, number of starts, bytes) the runs (id, from, to, level) of starts that are repeats.

    With ``first`` those whose longest previous factor reaches the level's length; otherwise those with any other match of that length.
    """
    pieces = sorted(pieces, key=lambda p: p[:2])  # segments of one text share no start, so this is the order of all starts
    sizes = np.array([len(p[3]) + 1 for p in pieces])
    raw = END.join([p[3] for p in pieces]) + END
    heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = np.array([p[2] for p in pieces])
    owner = np.repeat(np.arange(len(pieces)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    # only starts whose string may stand twice are sorted, run by run, with the bytes that such strings reach over
    at, end = heads[owner] + offset, (heads + sizes - 1)[owner]
    stop = at.copy()
    for length in levels:
        some = np.flatnonzero(stop > at) if length > levels[0] else np.arange(len(at))
        some = some[seen_twice(np.frombuffer(raw, np.uint8), at[some], end[some], length)]
        stop[some] = at[some] + length
    some = np.flatnonzero(stop > at)
    if not len(some):
        return []
    owner, offset, at = owner[some], offset[some], at[some]
    a, b = _edges(at, owner)
    stop = np.maximum.reduceat(stop[some], a)
    data = np.frombuffer(END.join([raw[i:j] for i, j in zip(at[a].tolist(), stop.tolist(), strict=True)]) + END, np.uint8)
    run = np.repeat(np.arange(len(a)), b - a + 1)
    moved = at + (np.cumsum(stop - at[a] + 1) - stop - 1)[run]
    factors = Factors(data, moved, np.arange(len(at)), stop[run] - at, levels[-1])
    reach = factors.previous if first else factors.other
    ids, start = np.array([p[0] for p in pieces])[owner], np.array([p[1] for p in pieces])[owner] + offset
    out: list[tuple[int, int, int, int]] = []
    for level, length in enumerate(levels):
        hit = np.flatnonzero(reach >= length)
        if len(hit):
            a, b = (hit[x] for x in _edges(at[hit], owner[hit]))
            out += zip(ids[a].tolist(), start[a].tolist(), start[b].tolist(), [level] * len(a), strict=True)
    return out


_RUNS = "id long, a long, b long, level int"


def _sort(levels: tuple[int, ...], first: bool) -> Callable:
    """Rows (h, id, first, n, piece) sorted by anchor -> runs of starts of repeated strings."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[tuple[int, int, int], tuple[int, int, int, bytes]] = {}  # a repeated row brings its segments again
        size, last = 0, None

        def flush():
            out = factor_runs(list(held.values()), levels, first) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["id", "a", "b", "level"])

        for batch in batches:
            for h, i, s, n, piece in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if h != last and size > BLOCK:
                    yield flush()
                    held, size = {}, 0
                held[h, i, s] = i, s, n, piece
                size += len(piece)
                last = h
        yield flush()

    return work


def _string_hashes(levels: tuple[int, ...]) -> Callable:
    """For the segments of crowded anchors every string's two hashes: (level, g1, g2, id, start)."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for base, data, offsets in utf8_slices(batch.column(3), CHUNK):
                ids, first, n = (np.asarray(batch.column(k).slice(base, len(offsets) - 1)) for k in range(3))
                sums = [running(data, x) for x in _BASES]
                for level, length in enumerate(levels):
                    m = np.clip(np.diff(offsets) - length + 1, 0, n)
                    owner = np.repeat(np.arange(len(m)), m)
                    offset = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)
                    at = offsets[owner] + offset
                    g1, g2 = (pa.array(hashes(x, at, at + length, y).view(np.int64)) for x, y in zip(sums, _BASES, strict=True))
                    columns = [pa.array(np.full(len(at), level, np.int32)), g1, g2, pa.array(ids[owner]), pa.array(first[owner].astype(np.int64) + offset)]
                    yield pa.RecordBatch.from_arrays(columns, names=["level", "g1", "g2", "id", "start"])

    return work


def _sha(text: str) -> Column:
    return F.sha2(F.encode(F.col(text), "utf-8"), 256)


def _late(sha: Column) -> Column:
    """A number for a text without a name of its own, from the end of the range."""
    return F.lit((1 << 63) - 1) - F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")


def _keyed(docs: DataFrame, *extra: Column) -> DataFrame:
    """key, text: rows by doc_id, those without one by a hash of their text; a null text is empty."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *extra)
    return df.withColumn("key", F.coalesce("doc_id", _late(_sha("text"))))


def repeats(docs: DataFrame, levels: tuple[int, ...] = (LENGTH,), keep: str = "none") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, runs): rows has doc_id, sha, n_bytes and n_words of every row; texts has id, key, sha, n_bytes, copies of every distinct
    text; runs has id, a, b, level: starts of strings of levels[level] bytes, or more, that are repeats.

    ``key`` is the smallest key of the text's rows and ``id`` is the same but for the second text of a key.
    """
    release(docs.sparkSession)
    gram = min(GRAM, max(8, levels[0] // 6))
    scan = _keyed(docs).select("key", "doc_id", "text").mapInArrow(_scan(levels, gram), _SCANNED)
    scan = materialize(scan.withColumn("row", F.monotonically_increasing_id()), "anchors")
    texts = scan.groupBy("sha").agg(F.min(F.struct("key", "row")).alias("low"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"))
    nth = F.row_number().over(Window.partitionBy("low.key").orderBy("sha"))
    texts = texts.select("sha", F.col("low.key").alias("key"), F.col("low.row").alias("row"), "copies", "n_bytes", F.when(nth == 1, F.col("low.key")).otherwise(_late(F.col("sha"))).alias("id"))
    texts = materialize(texts, "texts")
    one = scan.where(F.size("h") > 0).join(texts.select("row", "id"), "row")
    places = materialize(one.select("id", F.explode(F.arrays_zip("h", "first", "n", "size", "ph")).alias("m")).select("id", "m.*"), "places")
    twice = materialize(places.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "shared")
    shared = materialize(places.join(twice, "h"), "segments")
    kinds = materialize(shared.groupBy("h", "ph", "n").agg(F.count("*").alias("c"), F.min(F.struct("id", "first", "size")).alias("low")), "kinds")
    discard(places, twice)
    # all strings of a segment that stands twice are repeats
    release(docs.sparkSession)
    equal = shared.join(kinds.where("c > 1").select("h", "ph", "n", "low"), ["h", "ph", "n"])
    equal = equal.where((F.col("id") != F.col("low.id")) | (F.col("first") != F.col("low.first"))) if keep == "first" else equal
    ends = [(level, F.col("first") + F.least(F.col("n") - 1, F.col("size") - length)) for level, length in enumerate(levels)]
    spans = F.array(*[F.struct(F.col("id"), F.col("first").cast("long").alias("a"), b.cast("long").alias("b"), F.lit(level).alias("level")) for level, b in ends])
    runs = equal.select(F.explode(F.filter(spans, lambda r: r["b"] >= r["a"])).alias("r")).select("r.*")
    unlike = kinds.groupBy("h").agg(F.count("*").alias("d")).where("d > 1").select("h", (F.col("d") > CROWD).alias("crowd"))
    marks = kinds.join(unlike, "h").groupBy("low.id").agg(F.collect_list(F.struct("h", "low.first", "n", "low.size", "crowd")).alias("marks"))
    marks = materialize(marks.join(texts.select("id", "key", "sha"), "id"), "marks")
    named = _keyed(docs).select("key", "text").join(marks, "key").where(_sha("text") == F.col("sha"))
    pieces = named.select("id", "text", "marks").mapInArrow(_cut, "h long, id long, first int, n int, crowd boolean, piece binary")
    pieces = materialize(pieces, "pieces")
    dealt = pieces.where("not crowd").select("h", "id", "first", "n", "piece").repartition(shuffle_parts(docs.sparkSession), "h").sortWithinPartitions("h", "id", "first")
    runs = runs.unionByName(dealt.mapInArrow(_sort(levels, keep == "first"), _RUNS))
    crowded, counts = pieces.where("crowd"), None
    if crowded.limit(1).count():
        strings = crowded.select("id", "first", "n", "piece").distinct().mapInArrow(_string_hashes(levels), "level int, g1 long, g2 long, id long, start long")
        keys = ["level", "g1", "g2"]
        counts = materialize(strings.groupBy(*keys).agg(F.count("*").alias("c"), F.min(F.struct("id", "start")).alias("least")).where("c > 1"), "strings")
        again = strings.join(counts, keys)
        again = again.where((F.col("id") != F.col("least.id")) | (F.col("start") != F.col("least.start"))) if keep == "first" else again
        runs = runs.unionByName(again.select("id", F.col("start").alias("a"), F.col("start").alias("b"), "level"))
    runs = materialize(runs, "runs")
    discard(shared, kinds, marks, pieces, *([counts] if counts is not None else []))
    release(docs.sparkSession)
    return scan.select("doc_id", "sha", "n_bytes", "n_words"), texts, runs


def _covered(runs: list[tuple[int, int]], n_bytes: int, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by strings of ``length`` bytes starting in the given runs of starts."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        a, b = a, min(n_bytes, b + length)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _covered_rows(row: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_covered`` of many texts at once: row, from, to of the maximal runs of bytes, in order."""
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order], b[order]
    base = row * (int(sizes.max(initial=0)) + 1)  # texts lie one after the other with a gap between
    reach = np.maximum.accumulate(base + np.minimum(sizes[row], b + length))
    first = np.flatnonzero(np.concatenate([[True], (base + a)[1:] > reach[:-1]])[: len(row)])
    last = np.concatenate([first[1:], [len(row)]])[: len(first)] - 1
    return row[first], a[first], reach[last] - base[last]


def _words_within(raw: bytes, a: int, b: int) -> int:
    """Words of the text that lie within raw[a:b] as a whole."""
    own = raw[a:b]
    n = len(own.split())
    n -= n > 0 and a > 0 and not _SPACES[raw[a - 1]] and not _SPACES[own[0]]
    return n - (n > 0 and b < len(raw) and not _SPACES[raw[b]] and not _SPACES[own[-1]])


def _digest(length: int, passage: int) -> Callable:
    def digest(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for base, data, offsets in utf8_slices(batch.column(0)):
                raw, sizes, shas = data.tobytes(), np.diff(offsets), batch.column(1).slice(base, len(offsets) - 1).to_pylist()
                own = [hashlib.sha256(raw[offsets[i] : offsets[i + 1]]).hexdigest() == sha for i, sha in enumerate(shas)]  # else another text under the same key
                marks = batch.column(2).slice(base, len(shas))
                row = np.repeat(np.arange(len(shas)), np.asarray(marks.value_lengths()))
                a, b, level = (np.asarray(x) for x in marks.flatten().flatten())
                long = np.flatnonzero((level > 0) | (passage == length))
                spans = _covered_rows(row[long], a[long], b[long], sizes, length)
                shared = _covered_rows(row, a, b, sizes, passage)
                cuts, passages = (np.searchsorted(x[0], np.arange(len(shas) + 1)).tolist() for x in (spans, shared))
                (_, a, b), (_, x, y) = ([z.tolist() for z in runs] for runs in (spans, shared))
                rows = []
                for i in range(len(shas)):
                    if not own[i]:
                        continue
                    text, cut, seen = raw[offsets[i] : offsets[i + 1]], slice(*cuts[i : i + 2]), slice(*passages[i : i + 2])
                    kept, at = hashlib.sha256(), 0
                    for c, d in zip(a[cut], b[cut], strict=True):
                        kept.update(text[at:c])
                        at = d
                    kept.update(text[at:])
                    longest = max((d - c for c, d in zip(x[seen], y[seen], strict=True)), default=0)
                    wordy = sum(_words_within(text, c, d) > PASSAGE_WORDS for c, d in zip(x[seen], y[seen], strict=True))
                    rows.append((shas[i], sum(b[cut]) - sum(a[cut]), len(a[cut]), kept.hexdigest(), longest, wordy))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["sha", "n_removed", "n_spans", "kept", "longest_repeat", "n_passages"])

    return digest


def digest(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, with every occurrence of a repeated string of ``length`` bytes removed.

    Strings of ``passage`` bytes are looked for as well: longest_repeat is the longest run of bytes that they cover, and n_passages the
    number of such runs with more than fifty words.
    """
    passage = min(passage, length)
    rows, texts, runs = repeats(docs, (passage, length) if passage < length else (length,), "none")
    by_text = runs.groupBy("id").agg(F.collect_list(F.struct("a", "b", "level")).alias("runs"))
    alone = texts.where((F.col("copies") == 1) | (F.col("n_bytes") < length))
    part = materialize(alone.join(by_text, "id").select("key", "sha", "runs"), "cuts")
    cut = _keyed(docs).select("key", "text").join(part, "key")
    removed = cut.select("text", "sha", "runs").mapInArrow(_digest(length, passage), "sha string, n_removed long, n_spans long, kept string, longest_repeat long, n_passages long").dropDuplicates(["sha"])
    nothing = hashlib.sha256(b"").hexdigest()
    info = materialize(texts.select("sha", "copies").join(removed, "sha", "left"), "removed")
    out = rows.join(info, "sha")
    copied, whole = F.col("copies") > 1, (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    known = copied & (F.col("n_bytes") >= passage)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(zero("n_removed")).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(zero("n_spans")).alias("n_spans"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(known, F.col("n_bytes")).otherwise(zero("longest_repeat")).alias("longest_repeat"),
        F.when(known, (F.col("n_words") > PASSAGE_WORDS).cast("long")).otherwise(zero("n_passages")).alias("n_passages"),
    )


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents without later copies of strings of ``length`` bytes; the first copy of each stays.

    A document of which nothing is left goes; where a cut falls within a character, the whole character stays; ``n_chars``, if
    there is one, follows the text.
    """
    names = docs.columns
    _, texts, runs = repeats(docs, (length,), "first")
    part = runs.groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("runs")).join(texts, "id").select("key", "sha", "runs")
    # of rows that share a whole text only those with the smallest key stay, if the text is long enough to be a repeat
    several = texts.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("sha", F.col("key").alias("low"))
    later = _keyed(docs).select("key", _sha("text").alias("sha")).join(several, "sha").where("key > low").select("key", "sha").distinct()
    rows = _keyed(docs, F.struct(*names).alias("__row")).withColumn("sha", _sha("text"))
    rows = rows.join(later, ["key", "sha"], "left_anti").join(part, ["key", "sha"], "left").select("__row", "text", "runs")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not own:
                    out.append(None)
                    continue
                raw, at, left = text.encode(), 0, []
                for a, b in _covered([(r["a"], r["b"]) for r in own], len(raw), length):
                    while a < len(raw) and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b < len(raw) and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    left.append(raw[at:a])
                    at = max(a, b)
                left.append(raw[at:])
                out.append(b"".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["__row", "new"])

    kind = rows.select("__row").schema["__row"].dataType.simpleString()
    changed = rows.where("runs is not null").mapInArrow(cut, f"__row {kind}, new string")
    same = rows.where("runs is null").select("__row", F.lit(None).cast("string").alias("new"))
    whole = same.unionByName(changed.where("new is null or trim(new) <> ''"))
    new = {"text": F.coalesce("new", F.col("__row")["text"])}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("new").isNull(), F.col("__row")["n_chars"]).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType))
    return whole.select(*[new.get(c, F.col("__row")[c]).alias(c) for c in names])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
