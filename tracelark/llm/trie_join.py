"""Join of one block of sets by a prefix tree.

The sets, sorted in one global order of their elements, form a compressed trie. One walk of the trie matches each set against all sets
before it: at a node it carries the sets that may still reach the threshold with one below, with their overlaps so far (shared by all
below the node), as arrays, and drops a set as soon as the elements still to come cannot lift any below to the threshold. Since only
connected groups are wanted, a set is also dropped where all below lie in its own group already.
"""

from __future__ import annotations

import numpy as np

#: An element that one in DENSE sets has is counted by rows over all sets (at most DENSE cells for each element of the block), a rarer one by a list.
DENSE = 8


class _Node:
    __slots__ = ("children", "depth", "hi", "least", "lo", "most")

    def __init__(self, depth: int, lo: int):
        self.depth, self.lo, self.hi = depth, lo, lo + 1
        self.children: list[_Node] = []


def _tree(sets: list[np.ndarray]) -> _Node:
    """The compressed trie of distinct, lexicographically sorted sets."""
    root = _Node(0, 0)
    path = [root]
    for i, x in enumerate(sets):
        if i:
            y = sets[i - 1]
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            common = int(differ[0]) if len(differ) else m
            last = None
            while path[-1].depth > common:
                last = path.pop()
                last.hi = i
            if path[-1].depth < common:  # split the edge
                mid = _Node(common, last.lo)
                path[-1].children[-1] = mid
                mid.children.append(last)
                path.append(mid)
            elif path[-1].depth and not path[-1].children:  # the set before is a prefix of this one: it gets an empty edge
                mid = _Node(common, path[-1].lo)
                mid.children.append(path[-1])
                path[-2].children[-1] = mid
                path[-1].hi = i
                path[-1] = mid
        leaf = _Node(len(x), i)
        path[-1].children.append(leaf)
        path.append(leaf)
    for node in path:
        node.hi = len(sets)
    return root


def _sizes(root: _Node, sizes: np.ndarray) -> None:
    """The least and the largest size of a set below each node."""
    stack = [root]
    while stack:
        node = stack.pop()
        own = sizes[node.lo : node.hi]
        node.least, node.most = int(own.min()), int(own.max())
        stack.extend(node.children)


def _in_order(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets as sorted ranks of one order: elements that more sets have come first.

    Near copies then share long paths and part late, and what many other sets have in common is a path that is walked once.
    """
    every, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(every), np.uint32)
    rank[np.lexsort((every, -count))] = np.arange(len(every), dtype=np.uint32)
    ends = np.cumsum([len(x) for x in sets])[:-1]
    return [np.sort(x) for x in np.split(rank[place], ends)]


class _Overlaps:
    """How many elements of a stretch of one set each set has, and how many up to an element."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        n = len(sets)
        every, owner = np.concatenate(sets).astype(np.int64), np.repeat(np.arange(n), sizes)
        self.n, self.ends = n, np.concatenate([[0], np.cumsum(sizes)])
        self.width = int(every.max()) + 1
        self.flat = owner * self.width + every  # in order of set and element
        count = np.bincount(every)
        common = np.minimum.accumulate(count) >= max(2, n / DENSE)  # the first ranks; equal sets, counted once here, may stand out of order
        self.dense, self.shared = int(common.sum()), int(np.flatnonzero(count > 1)[-1:].sum()) + 1
        self.has = np.zeros((self.dense, n), np.uint8)
        at = every < self.dense
        self.has[every[at], owner[at]] = 1
        self.upto = np.zeros((self.dense + 1, n), np.int32)
        np.cumsum(self.has, axis=0, dtype=np.int32, out=self.upto[1:])
        rare = np.flatnonzero((every >= self.dense) & (every < self.shared))
        rare = rare[np.argsort(every[rare], kind="stable")]
        self.owners = owner[rare]
        self.first = np.searchsorted(every[rare], np.arange(self.dense, max(self.dense, self.shared) + 1))

    def _rows(self, elements: np.ndarray, who: np.ndarray) -> np.ndarray:
        if len(who) * 8 < self.n:
            return self.has[elements[:, None], who].sum(0, dtype=np.int32)
        return self.has[elements].sum(0, dtype=np.int32)[who]

    def holders(self, stretch: np.ndarray) -> np.ndarray:
        """The sets that have rare elements of the stretch, as often as they do."""
        at = stretch[np.searchsorted(stretch, self.dense) : np.searchsorted(stretch, self.shared)] - self.dense
        if not len(at):
            return self.owners[:0]
        start, size = self.first[at], self.first[at + 1] - self.first[at]
        return self.owners[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]

    def of(self, stretch: np.ndarray, who: np.ndarray) -> np.ndarray:
        """For each of who the number of elements of the stretch, which is sorted."""
        common = stretch[: np.searchsorted(stretch, self.dense)]
        out = np.zeros(len(who), np.int32)
        if len(common):
            a, b = int(common[0]), int(common[-1]) + 1
            if b - a < 2 * len(common):  # more of the ranks between are there than not: those that are not are taken off
                gaps = np.ones(b - a, bool)
                gaps[common - a] = False
                out = self.upto[b, who] - self.upto[a, who]
                if gaps.any():
                    out -= self._rows(np.flatnonzero(gaps) + a, who)
            else:
                out = self._rows(common, who)
        held = self.holders(stretch)
        return out + np.bincount(held, minlength=self.n)[who] if len(held) else out

    def used(self, last: int, who: np.ndarray) -> np.ndarray:
        """For each of who the number of elements up to last."""
        if last < self.dense:
            return self.upto[last + 1, who]
        return np.searchsorted(self.flat, who * self.width + last, side="right") - self.ends[who]


def groups(sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """For each set the position of one set that stands for its group: sets are linked when
    den * |intersection| >= num * |union|. Sets must be sorted arrays, none empty; equal sets are one group."""
    sets = _in_order(sets)
    ranked: list[np.ndarray] = []
    origin: list[int] = []
    place = np.zeros(len(sets), np.int64)
    for i in sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes()):
        if not (ranked and len(ranked[-1]) == len(sets[i]) and (ranked[-1] == sets[i]).all()):
            ranked.append(sets[i])
            origin.append(i)
        place[i] = len(ranked) - 1
    label = np.arange(len(ranked))
    if len(ranked) > 1:
        _walk(ranked, label, num, den)
    return np.array(origin)[label[place]].tolist()


def _walk(ranked: list[np.ndarray], label: np.ndarray, num: int, den: int) -> None:
    """Gives linked sets, of distinct sets in order, one label: the smallest place in the group."""
    both, sizes = num + den, np.array([len(x) for x in ranked])
    root, overlaps = _tree(ranked), _Overlaps(ranked, sizes)
    _sizes(root, sizes)
    every = np.arange(len(ranked))
    stack = [(root, iter(root.children), every, np.zeros(len(ranked), np.int32), sizes)]
    while stack:
        node, rest, who, overlap, left = stack[-1]
        c = next(rest, None)
        if c is None:
            stack.pop()
            continue
        if c is node.children[-1]:
            stack.pop()  # nothing comes after it: the arrays can go
        # sets before the last below the child, unless all below are in their group, that can reach the threshold if all that comes is shared
        own = label[c.lo : c.hi]
        n = np.searchsorted(who, c.hi - 1)
        able = label[who[:n]] != own[0] if (own == own[0]).all() else np.ones(n, bool)
        stretch = ranked[c.lo][node.depth : c.depth].astype(np.int64)
        sure = c.most - -(-num * c.most // den) + 1  # of so many elements a linked set has one at least
        if len(stretch) >= sure and stretch[0] >= overlaps.dense:
            some = np.zeros(len(ranked), bool)
            some[overlaps.holders(stretch[:sure])] = True
            able &= some[who[:n]]
        at = np.flatnonzero(able)
        at = at[_reach(overlap[at], left[at], sizes[who[at]], node.depth, c, num, both)]
        if not len(at):
            continue
        who, overlap = who[at], overlap[at]
        if len(stretch):
            overlap = overlap + overlaps.of(stretch, who)
        if not c.children:
            linked = who[both * overlap.astype(np.int64) >= num * (sizes[who] + c.depth)]
            if len(linked):
                same = np.zeros(len(ranked), bool)
                same[label[linked]] = same[label[c.lo]] = True
                label[same[label]] = np.flatnonzero(same)[0]
            continue
        left = sizes[who] - overlaps.used(int(stretch[-1]), who) if len(stretch) else left[at]
        at = _reach(overlap, left, sizes[who], c.depth, c, num, both)
        if at.any():
            stack.append((c, iter(c.children), who[at], overlap[at], left[at]))


def _reach(overlap: np.ndarray, left: np.ndarray, sizes: np.ndarray, depth: int, c: _Node, num: int, both: int) -> np.ndarray:
    """True for each set of those sizes that can be linked with a set below c, with so much overlap up to a depth and so many elements left."""
    size = np.clip(depth + left.astype(np.int64), c.least, c.most)
    return both * (overlap + np.minimum(left, size - depth)) >= num * (sizes + size)
