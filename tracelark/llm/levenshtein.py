"""A lexicon trie intersected with Levenshtein automata of distance 1, as one table, and its walk over many words at once.

A state of the product is a set of (trie node, edits so far); determinised, it is a row of a table with a column for each class
of letters. All words of a slice of texts advance together, one letter a step, and those that can no longer match drop out.
Swapping two neighbours counts as one edit.
"""

from __future__ import annotations

import numpy as np

#: Terms shorter than this match exactly only.
FUZZY_FROM = 5
#: Digits read as the letters they stand in for.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
SEPARATOR, OTHER = 0, 1
#: States of a table at most; a lexicon that needs more is split over several tables.
STATES = 200_000
#: Terms that are tried in one table.
PART = 200


class TooLarge(ValueError):
    pass


class Lexicon:
    """terms: (text, whole); a whole term matches a word, another matches the words that begin with it."""

    def __init__(self, terms: list[tuple[str, bool]], letters: list[str] | None = None):
        self.terms = terms
        letters = letters or sorted({c for t, _ in terms for c in t})
        self.letter = {c: i + 2 for i, c in enumerate(letters)}
        self.n_classes = len(letters) + 2
        children: list[dict[int, int]] = [{}]
        ends: list[int | None] = [None]
        for k, (text, _) in enumerate(terms):
            node = 0
            for c in text:
                c = self.letter[c]
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(None)
                node = children[node][c]
            ends[node] = k if ends[node] is None else ends[node]
        self.children, self.ends = children, ends
        self._determinise()

    def _close(self, items: set) -> frozenset:
        """Adds missing letters (no input) and the stems that are complete."""
        out = set(items)
        for item in items:
            if item[0] == "at" and item[2] == 0:
                out.update(("at", x, 1) for x in self.children[item[1]].values())
        for item in list(out):
            if item[0] == "at" and (k := self.ends[item[1]]) is not None and not self.terms[k][1] and (item[2] == 0 or len(self.terms[k][0]) >= FUZZY_FROM):
                out.add(("hit", k, item[2]))
        exact = [x for x in out if x[0] == "hit" and x[2] == 0]
        return frozenset({min(exact)}) if exact else frozenset(out)

    def _step(self, state: frozenset, c: int) -> frozenset:
        out = set()
        for item in state:
            if item[0] == "hit":
                out.add(item)
            elif item[0] == "swap":
                if item[2] == c:
                    out.add(("at", item[1], 1))
            else:
                _, node, edits = item
                kids = self.children[node]
                if c in kids:
                    out.add(("at", kids[c], edits))
                if edits == 0:
                    out.add(("at", node, 1))
                    for x, child in kids.items():
                        if x != c:
                            out.add(("at", child, 1))
                            if c in self.children[child]:
                                out.add(("swap", self.children[child][c], x))
        return self._close(out)

    def _found(self, state: frozenset) -> int:
        """The match of a word that ends here: 2 * term + edits, or -1."""
        best = [(x[2], x[1]) for x in state if x[0] == "hit"]
        for x in state:
            if x[0] == "at" and (k := self.ends[x[1]]) is not None and (x[2] == 0 or len(self.terms[k][0]) >= FUZZY_FROM):
                best.append((x[2], k))
        return 2 * min(best)[1] + min(best)[0] if best else -1

    def _determinise(self) -> None:
        start = self._close({("at", 0, 0)})
        number, todo, rows = {frozenset(): 0, start: 1}, [frozenset(), start], []
        at = 0
        while at < len(todo):
            state, row = todo[at], [0] * self.n_classes
            at += 1
            if state:
                for c in range(1, self.n_classes):
                    to = self._step(state, c)
                    if to not in number:
                        if len(number) >= STATES:
                            raise TooLarge("the lexicon is too large for one table")
                        number[to] = len(todo)
                        todo.append(to)
                    row[c] = number[to]
            rows.append(row)
        self.table = np.array(rows, dtype=np.int32)
        self.found = np.array([self._found(s) for s in todo], dtype=np.int32)


class Tables:
    """A lexicon of any size, as tables over one set of letter classes, each of a run of its terms."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        letters = sorted({c for t, _ in terms for c in t})
        self.letter = {c: i + 2 for i, c in enumerate(letters)}
        self.parts: list[tuple[int, np.ndarray, np.ndarray]] = []  # first term, table, found
        todo = [(at, min(len(terms), at + PART)) for at in range(0, len(terms), PART)]
        while todo:
            low, high = todo.pop(0)
            try:
                part = Lexicon(terms[low:high], letters)
            except TooLarge:
                if high - low == 1:
                    raise
                todo[:0] = [(low, (low + high) // 2), ((low + high) // 2, high)]
                continue
            self.parts.append((low, part.table, part.found))

    def walk(self, own: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The match of every word: 2 * term + edits, of the fewest edits and then the first term, or -1."""
        best = np.full(len(starts), -1, np.int32)
        for low, table, found in self.parts:
            got = walk(table, found, own, starts, ends)
            got[got >= 0] += 2 * low
            better = (got >= 0) & ((best < 0) | (got % 2 < best % 2))
            best[better] = got[better]
        return best


_CLASSES: dict[str, np.ndarray] = {}


def classes(letter: dict[str, int]) -> np.ndarray:
    """Class of every code point: separator, a letter that no term has, or a letter of the lexicon; upper case as lower."""
    if "base" not in _CLASSES:
        base = np.zeros(0x110000, np.uint16)
        for cp in range(0x20000):
            c = chr(cp)
            if c.isalnum():
                base[cp] = OTHER
        base[0x20000:0x40000] = OTHER
        for low, high in ((0x300, 0x370), (0x1AB0, 0x1B00), (0x20D0, 0x2100)):  # combining marks belong to their word
            base[low:high] = OTHER
        _CLASSES["base"] = base
    out = _CLASSES["base"].copy()
    for c, k in letter.items():
        out[ord(c)] = k
        if len(c.upper()) == 1:
            out[ord(c.upper())] = k
    for digit, c in LEET.items():
        out[ord(digit)] = letter.get(c, OTHER)
    return out


def walk(lexicon_table: np.ndarray, found: np.ndarray, own: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The match of every word own[starts[i]:ends[i]] (classes), or -1."""
    out = np.full(len(starts), -1, np.int32)
    alive = np.arange(len(starts))
    state = np.ones(len(starts), np.int32)
    at, stop = starts.copy(), ends
    while len(alive):
        state = lexicon_table[state, own[at]]
        at = at + 1
        over = at == stop
        if over.any():
            out[alive[over]] = found[state[over]]
        go = ~over & (state > 0)
        alive, state, at, stop = alive[go], state[go], at[go], stop[go]
    return out
