"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves pre-tokens that are tokens themselves. Tier two: a miss is merged
with a heap of ranked pairs over a linked list of bytes. No pre-token reaches over white space, so a text is first cut into words with the
space before them; each task keeps the results of recent words and pre-tokens, within a bound, and frees them when it ends.
The vocabulary (about 50,000 tokens, under 1 MB) goes to the tasks with the function; texts stay on Spark's Arrow path.

Cases: a null or empty text has no ids (n_tokens 0, the hashes of the empty string); repeated rows are encoded each by itself; an
empty table gives no rows; extra columns are ignored; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Entries in each of the two tables of the words and pre-tokens used last.
MEMORY = 150_000
#: White space of the pattern: a word with the space before it, or a run of white space, as the pattern takes it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNITS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall
#: Letters and digits that are newer than the tokenizer's own character tables: it takes them for symbols. Fixed values.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2),
    (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE),
    (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED),
    (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


class PerfectHash:
    """A minimal perfect hash over byte strings: n keys, n slots; the key kept in the slot tells strangers apart.

    Keys fall into buckets by one hash; from the largest bucket on, each bucket gets the first seed that
    sends all its keys to free slots (buckets of one key get a free slot outright).
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        self.n_buckets = max(1, n // 3)
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        for i, key in enumerate(keys):
            buckets[zlib.crc32(key) % self.n_buckets].append(i)
        self.seeds = [0] * self.n_buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        free = None
        for b in sorted(range(self.n_buckets), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if not own:
                break
            if len(own) == 1:
                free = iter([s for s in range(n) if self.keys[s] is None]) if free is None else free
                slots, seed = [next(free)], None
                self.seeds[b] = -1 - slots[0]
            else:
                seed = 0
                while True:
                    seed += 1
                    slots = [self._slot(keys[i], seed) for i in own]
                    if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                        break
                self.seeds[b] = seed
            for s, i in zip(slots, own, strict=True):
                self.keys[s], self.values[s] = keys[i], values[i]

    def _slot(self, key: bytes, seed: int) -> int:
        return ((zlib.adler32(key, seed) * 0x9E3779B1 ^ zlib.crc32(key, seed) * 0x85EBCA77) >> 7) % self.n

    def get(self, key: bytes) -> int | None:
        seed = self.seeds[zlib.crc32(key) % self.n_buckets]
        slot = -1 - seed if seed < 0 else self._slot(key, seed)
        return self.values[slot] if self.keys[slot] == key else None


class Codec:
    """Encoder and decoder for the ranks of a vocabulary file and a pattern that cuts texts into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pairs = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.two = [-1] * 65536  # ranks of pairs of bytes
        for key, r in ranks.items():
            if len(key) == 2:
                self.two[key[0] << 8 | key[1]] = r
        self.whole = PerfectHash(list(ranks), list(ranks.values()))
        self.find = regex.compile(pattern).findall
        newer = "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER)
        self.newer = regex.compile(f"[{newer}]")
        strict = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{newer}])").replace(r"?\p{L}+", rf"?[\p{{L}}--[{newer}]]+").replace(r"?\p{N}+", rf"?[\p{{N}}--[{newer}]]+")
        self.find_strict = regex.compile(strict, regex.V1).findall
        self.forget()

    def forget(self) -> None:
        """Ids as text, and what they decode to, of words and pre-tokens; the older table goes when the newer one is full."""
        self.recent: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of a pre-token: always the adjacent pair of lowest rank is joined first, the leftmost among equals.

        The heap holds rank, start and end of each pair in one number.
        """
        rank, two, n, push, pop = self.pairs.get, self.two, len(piece), heapq.heappush, heapq.heappop
        bits = n.bit_length()
        mask, high = (1 << bits) - 1, 2 * bits
        end = list(range(1, n + 1))  # of the part that starts here; 0 where none starts
        before = list(range(-1, n - 1))
        heap, left = [], piece[0] << 8
        for i, byte in enumerate(piece[1:]):
            if (r := two[left | byte]) >= 0:
                heap.append((r << high) | (i << bits) | (i + 2))
            left = byte << 8
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            i, to = (top >> bits) & mask, top & mask
            mid = end[i]
            if not mid or mid >= to or end[mid] != to:  # one of the two parts has been joined meanwhile
                continue
            end[i], end[mid] = to, 0
            if to < n:
                before[to] = i
                if (r := rank(piece[i : end[to]])) is not None:
                    push(heap, (r << high) | (i << bits) | end[to])
            if i and (r := rank(piece[before[i] : to])) is not None:
                push(heap, (r << high) | (before[i] << bits) | to)
        out, i, ranks = [], 0, self.pairs
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def piece(self, text: str) -> tuple[str, bytes]:
        """The ids of one pre-token as text, and what they decode to."""
        raw = text.encode()
        one = self.whole.get(raw)
        if one is not None:
            return str(one), self.tokens[one]
        ids = self.merge(raw)
        return ",".join(map(str, ids)), b"".join([self.tokens[i] for i in ids])

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if not text.isascii() and self.newer.search(text):
            return self.find_strict(text)
        return self.find(text)

    def word(self, text: str) -> tuple[str, bytes]:
        """The ids of a word with the space before it, of a pre-token, or of white space, as text, and what they decode to."""
        got = self.older.get(text)
        if got is None:
            cut = self.cut(text)
            if len(cut) == 1:
                got = self.piece(text)
            else:
                known = self.recent.get
                parts = [known(p) or self.word(p) for p in cut]
                got = ",".join([p for p, _ in parts]), b"".join([d for _, d in parts])
        if len(text) <= 64:
            if len(self.recent) >= MEMORY:
                self.older, self.recent = self.recent, {}
            self.recent[text] = got
        return got

    def pieces(self, text: str) -> list[tuple[str, bytes]]:
        """For each word, or run of white space, its ids as text and what they decode to."""
        units = _UNITS(text)
        out = list(map(self.recent.get, units))
        if None in out:
            for at in [i for i, x in enumerate(out) if x is None]:
                out[at] = self.recent.get(units[at]) or self.word(units[at])  # it may have come up meanwhile
        return out

    def encode(self, text: str) -> list[int]:
        ids = ",".join([p for p, _ in self.pieces(text)])
        return list(map(int, ids.split(","))) if ids else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken vocabulary file: base64 of the token's bytes, its rank. The path is a parameter; vocabularies are not kept here."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(ranks_file: bytes, pattern: str) -> Codec:
    """The codec of a vocabulary file's content; built once in each Python worker."""
    key = (hashlib.sha256(ranks_file).hexdigest(), pattern)
    if key not in _CODECS:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line.strip())}
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


@contextmanager
def _task(ranks_file, pattern: str) -> Iterator[Codec]:
    """The codec for one task: what it remembers holds no cycles and is freed at the end."""
    own, was = codec(ranks_file.value, pattern), gc.isenabled()
    gc.disable()
    try:
        yield own
    finally:
        own.forget()
        if was:
            gc.enable()


def _digests(ranks_file, pattern: str) -> Callable:
    def digests(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with _task(ranks_file, pattern) as own:
            for batch in batches:
                counts, ids_sha, decoded_sha = [], [], []
                for text in batch.column(1):
                    pieces = own.pieces(text.as_py() or "")
                    ids = ",".join([p for p, _ in pieces])
                    counts.append(ids.count(",") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    decoded = hashlib.sha256()
                    for at in range(0, len(pieces), 4096):
                        decoded.update(b"".join([d for _, d in pieces[at : at + 4096]]))
                    decoded_sha.append(decoded.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digests


def _ids(ranks_file, pattern: str) -> Callable:
    def ids(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with _task(ranks_file, pattern) as own:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.encode(t.as_py() or "") for t in batch.column(1)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return ids


def _vocabulary(spark: SparkSession, path: str):
    small_batches(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # the size of one vocabulary file


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids: the token ids of every text."""
    return docs.select("doc_id", "text").mapInArrow(_ids(_vocabulary(docs.sparkSession, path), pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text (binary) of rows (doc_id, ids)."""
    ranks_file = _vocabulary(encoded.sparkSession, path)

    def texts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = codec(ranks_file.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x.as_py() or []) for x in batch.column(1)], pa.binary())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(texts, "doc_id long, text binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of what they decode to."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_digests(_vocabulary(docs.sparkSession, path), pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
