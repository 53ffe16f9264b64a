"""SentencePiece encoding and decoding of BPE models: merge-type encoding by backtracking, exact.

A sequence of pieces is what the merges lead to if and only if each two neighbours, merged again from characters, come out as themselves. So
no merging takes place: an Aho-Corasick automaton finds the longest piece at each place of a text, the pieces are taken from the left, a piece that
does not fit the one before gives way to its next shorter prefix, and a place that nothing leads on from is marked in a bitfield and never
tried again (what comes before a place is unique). The check of two neighbours replays the recorded merges of both, in the order of their
scores, and looks for a pair across the border that would have come first.

No piece of a model reaches over certain borders (before white space, around digits and line ends, where the model has no such pieces), so texts
are cut there, exactly; each task keeps the results of recent units within a bound, and frees them when it ends.

Cases: a null or empty text has no ids (n_tokens 0, the hashes of the empty string); characters without a piece become their bytes; a text of any
length is encoded whole, with or without white space; repeated rows are encoded each by itself; an empty table gives no rows; extra columns are ignored.
Models with other normalisation than the identity, with user-defined or unused pieces, or without pieces for bytes are refused.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Entries in each of the two tables of the units used last, and in the table of pairs of pieces.
MEMORY, PAIRS = 150_000, 200_000
#: The mark that stands for a space.
MARK = "▁"
#: Kinds of pieces and of models, as the file numbers them. Fixed values.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2
_NEVER = 1 << 60


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, raw[at : at + size]
        at += size


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("tracelark-each-byte", _each_byte)


class Codec:
    """Encoder and decoder of a model file's content."""

    def __init__(self, model: bytes):
        top = list(_fields(model))
        trainer, normalizer = ({k: v for f, raw in top if f == n for k, v in _fields(raw)} for n in (2, 3))
        if trainer.get(3) != BPE or not trainer.get(35) or trainer.get(24):
            raise ValueError("a BPE model with pieces for bytes, and marks before words, is needed")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only models without normalisation are known")
        self.prefix = MARK if normalizer.get(3, 1) else ""
        self.surface = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.pieces: list[tuple[str, int]] = []
        scores: dict[str, float] = {}
        for f, raw in top:
            if f == 1:
                piece = dict(_fields(raw))
                text, kind = piece[1].decode(), piece.get(3, NORMAL)
                if kind == NORMAL:
                    scores[text] = struct.unpack("<f", piece.get(2, bytes(4)))[0]
                elif kind not in (UNKNOWN, CONTROL, BYTE):
                    raise ValueError("user-defined and unused pieces are not known")
                self.pieces.append((text, kind))
        self.ids = {text: i for i, (text, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.bytes = {int(text[3:5], 16): i for i, (text, kind) in enumerate(self.pieces) if kind == BYTE}
        self.values = {i: bytes([b]) for b, i in self.bytes.items()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {text: order[s] for text, s in scores.items()}  # the best score first; equal ones go from the left
        self._prepare()
        self.forget()

    def _prepare(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for text in self.ids:
            self.automaton.add_word(text, len(text))
        self.automaton.make_automaton()
        #: Length of the next shorter prefix that is a piece, or one character.
        self.shorter = {text: next(k for k in range(len(text) - 1, 0, -1) if k == 1 or text[:k] in self.ids) for text in self.ids if len(text) > 1}
        self.cut = self._cutter([text for text in self.ids if len(text) > 1])
        #: Ids as text and bytes of every piece, and of the characters without one that have come up.
        self.known = {text: (str(i), text.replace(MARK, " ").encode()) for text, i in self.ids.items()}

    @staticmethod
    def _cutter(joined: list[str]) -> Callable[[str], list[str]]:
        """A function that cuts a text where no piece of several characters reaches over, as far as those pieces allow."""
        beside = {(a, b) for text in joined for a, b in zip(text, text[1:], strict=False)}
        if any(a != MARK and b == MARK for a, b in beside):
            return lambda text: [text] if text else []
        inside = {c for pair in beside for c in pair}
        alone = set(map(chr, range(128))) - inside  # in no such piece
        signs = {c for c in inside if not c.isalpha() and c != MARK}  # in pieces with one another and the mark only
        while out := {c for a, b in beside for c, other in ((a, b), (b, a)) if c in signs and other not in signs and other != MARK}:
            signs -= out
        as_class = lambda chars: re.escape("".join(sorted(chars)))
        ways = [f"{MARK}*[^{MARK}{as_class(alone | signs)}]+", *([f"{MARK}*[{as_class(signs)}]+"] if signs else []), f"{MARK}+", *([f"[{as_class(alone)}]"] if alone else [])]
        return re.compile("|".join(ways)).findall

    def forget(self) -> None:
        """Ids as text, and what they decode to, of units (the older table goes when the newer one is full); pairs of pieces that were checked."""
        self.recent: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.histories: dict[str, list[tuple[int, int, int]] | None] = {}

    def history(self, part: str) -> list[tuple[int, int, int]] | None:
        """The merges that make a piece of its characters: rank, length of the first and of the last part after it; None if they lead elsewhere."""
        if part not in self.histories:
            rank, cut, steps = self.rank.get, list(part), []
            while len(cut) > 1:
                best, i = min((rank(cut[i] + cut[i + 1], _NEVER), i) for i in range(len(cut) - 1))
                if best == _NEVER:
                    break
                cut[i : i + 2] = [cut[i] + cut[i + 1]]
                steps.append((best, len(cut[0]), len(cut[-1])))
            self.histories[part] = steps if len(cut) == 1 else None
        return self.histories[part]

    def fits(self, a: str, b: str) -> bool:
        """Whether the merges of the two pieces side by side never join anything across their border."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        got = self.pairs[a, b] = self._merged_apart(a, b)
        return got

    def _merged_apart(self, a: str, b: str) -> bool:
        left, right = self.history(a), self.history(b)
        if left is None or right is None:
            return False
        i = j = 0
        x, y = a[-1], b[0]  # the parts on either side of the border
        while True:
            next_left = left[i][0] if i < len(left) else _NEVER
            next_right = right[j][0] if j < len(right) else _NEVER
            across = self.rank.get(x + y, _NEVER)
            if across < next_left and across <= next_right and across < _NEVER:
                return False
            if next_left == next_right == _NEVER:
                return True
            if next_left <= next_right:
                x = a[-left[i][2] :]
                i += 1
            else:
                y = b[: right[j][1]]
                j += 1

    def parts(self, text: str) -> list[str]:
        """The pieces (or single characters without a piece) that the merges of ``text`` lead to."""
        n = len(text)
        longest = [1] * n  # a character may always stand alone
        for end, size in self.automaton.iter(text):
            longest[end - size + 1] = size  # a later end is a longer piece
        failed = None  # the bitfield, as soon as a place has failed
        out: list[str] = []
        pair, last = self.pairs.get, None
        at, size = 0, longest[0] if n else 0
        while at < n:
            if size == 0:  # nothing leads on from here
                failed = failed or bytearray((n >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                given_up = out.pop()
                at -= len(given_up)
                last = out[-1] if out else None
                size = self.shorter.get(given_up, 0)
                continue
            end = at + size
            part = text[at:end]
            if failed and failed[end >> 3] >> (end & 7) & 1:
                fits = False
            elif last is None:
                fits = self.history(part) is not None
            elif (fits := pair((last, part))) is None:
                fits = self.fits(last, part)
            if fits:
                out.append(part)
                last, at = part, end
                size = longest[end] if end < n else 0
            else:
                size = self.shorter.get(part, 0)
        return out

    def unit(self, text: str) -> tuple[str, bytes]:
        """The ids of one unit as text, and the bytes they decode to."""
        got = self.older.get(text)
        if got is None:
            parts = self.parts(text)
            found = list(map(self.known.get, parts))
            if None in found:
                found = [x or self._fallback(p) for x, p in zip(found, parts, strict=True)]
            got = (",".join([i for i, _ in found]), b"".join([d for _, d in found])) if len(found) != 1 else found[0]
        if len(text) <= 64:
            if len(self.recent) >= MEMORY:
                self.older, self.recent = self.recent, {}
            self.recent[text] = got
        return got

    def _fallback(self, char: str) -> tuple[str, bytes]:
        """A character without a piece: the ids of its bytes."""
        raw = char.encode()
        got = self.known[char] = ",".join([str(self.bytes[b]) for b in raw]), raw
        return got

    def units(self, text: str) -> list[tuple[str, bytes]]:
        """For each unit of a text its ids as text and what they decode to."""
        if not text:
            return []
        cut = self.cut(self.prefix + text.replace(" ", MARK))
        out = list(map(self.recent.get, cut))
        if None in out:
            for at in [i for i, x in enumerate(out) if x is None]:
                out[at] = self.recent.get(cut[at]) or self.unit(cut[at])  # it may have come up meanwhile
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.units(text) for i in ids.split(",")]

    def _decoded(self, ids: list[int]) -> str:
        """The text of ids, with the leading space: runs of bytes are UTF-8, where a byte that does not fit is a replacement character."""
        out, run = [], []
        for i in ids:
            if (value := self.values.get(i)) is not None:
                run.append(value)
                continue
            if run:
                out.append(b"".join(run).decode("utf-8", "tracelark-each-byte"))
                run = []
            text, kind = self.pieces[i]
            out.append("" if kind == CONTROL else self.surface if kind == UNKNOWN else text.replace(MARK, " "))
        out.append(b"".join(run).decode("utf-8", "tracelark-each-byte"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding puts before a text is taken off again."""
        text = self._decoded(ids)
        first = next((i for i in ids if self.pieces[i][1] != CONTROL), None)
        leading = self.prefix and first is not None and self.pieces[first][1] == NORMAL and self.pieces[first][0].startswith(MARK)
        return text[1:] if leading else text


_CODECS: dict[str, Codec] = {}


def codec(model: bytes) -> Codec:
    """The codec of a model file's content; built once in each Python worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


@contextmanager
def _task(model) -> Iterator[Codec]:
    """The codec for one task: what it remembers holds no cycles and is freed at the end."""
    own, was = codec(model.value), gc.isenabled()
    gc.disable()
    try:
        yield own
    finally:
        own.forget()
        if was:
            gc.enable()


def _model(spark: SparkSession, path: str):
    small_batches(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # the size of one model file


def _ids(model) -> Callable:
    def ids(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with _task(model) as own:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.encode(t.as_py() or "") for t in batch.column(1)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return ids


def _digests(model) -> Callable:
    def digests(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with _task(model) as own:
            for batch in batches:
                counts, ids_sha, decoded_sha = [], [], []
                for text in batch.column(1):
                    units = own.units(text.as_py() or "")
                    ids = ",".join([i for i, _ in units])
                    counts.append(ids.count(",") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    decoded = hashlib.sha256()
                    skip = 1 if units and own.prefix and units[0][1].startswith(b" ") else 0
                    for at in range(0, len(units), 4096):
                        decoded.update(b"".join([d for _, d in units[at : at + 4096]])[0 if at else skip :])
                    decoded_sha.append(decoded.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digests


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the ids of every text, without begin and end."""
    return docs.select("doc_id", "text").mapInArrow(_ids(_model(docs.sparkSession, path)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids)."""
    model = _model(encoded.sparkSession, path)

    def texts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = codec(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(texts, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of what they decode to."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_digests(_model(docs.sparkSession, path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
