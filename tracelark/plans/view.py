"""What part of the data a plot shows: spans of time and value, moved, scaled and cut. Shares of height count from the top."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, replace

#: Least extent of a span, least share of a box either way, and how far apart equal bounds may be (fixed values).
LEAST, LEAST_BOX, NEAR = 1e-9, 0.005, 1e-6
#: Ticks of an axis (fixed value).
TICKS = 5


@dataclass(frozen=True)
class Span:
    low: float
    high: float

    @property
    def size(self) -> float:
        return self.high - self.low

    def moved(self, by: float) -> Span:
        return Span(self.low + by, self.high + by)

    def scaled(self, factor: float, share: float) -> Span:
        """Scaled around the value that stands at a share of the extent, counted from below."""
        size = max(LEAST, self.size * factor)
        low = self.low + share * self.size - share * size
        return Span(low, low + size)

    def part(self, a: float, b: float) -> Span:
        return Span(self.low + a * self.size, self.low + b * self.size)

    def at_height(self, share: float) -> float:
        return self.high - share * self.size

    def height_of(self, value: float) -> float:
        return (self.high - value) / self.size if self.size else 0.5

    def near(self, other: Span) -> bool:
        return all(abs(a - b) <= NEAR * max(1.0, abs(a), abs(b)) for a, b in ((self.low, other.low), (self.high, other.high)))


@dataclass(frozen=True)
class Heights:
    """The part of every axis that is shown, as shares of its whole range."""

    top: float = 0.0
    bottom: float = 1.0

    def of(self, whole: Span) -> Span:
        return Span(whole.at_height(self.bottom), whole.at_height(self.top))

    def followed(self, before: Span, after: Span) -> Heights:
        """The shares after a step from one shown span to another."""
        if not before.size > 0:
            return self
        size = self.bottom - self.top
        return Heights(self.top + before.height_of(after.high) * size, self.top + before.height_of(after.low) * size)


@dataclass(frozen=True)
class View:
    x: Span
    y: Span

    def centre(self) -> tuple[float, float]:
        return self.x.low + self.x.size / 2, self.y.low + self.y.size / 2

    def point(self, right: float, down: float) -> tuple[float, float]:
        return self.x.low + right * self.x.size, self.y.at_height(down)

    def panned(self, right: float, down: float, width: float, height: float) -> View:
        """After a drag by so many pixels over a plot of that size; a side without extent stays."""
        dx = -right / width * self.x.size if width > 0 else 0.0
        dy = down / height * self.y.size if height > 0 else 0.0
        return View(self.x.moved(dx), self.y.moved(dy))

    def zoomed(self, factor: float, right: float, down: float, x: bool = True, y: bool = True) -> View:
        if not (math.isfinite(factor) and factor > 0):
            return self
        return View(self.x.scaled(factor, right) if x else self.x, self.y.scaled(factor, 1 - down) if y else self.y)

    def boxed(self, start: tuple[float, float], end: tuple[float, float]) -> View | None:
        """The box between two points (shares from the left and from the top); None if it is too small to be meant."""
        (left, right), (top, bottom) = sorted((start[0], end[0])), sorted((start[1], end[1]))
        if right - left < LEAST_BOX or bottom - top < LEAST_BOX:
            return None
        return View(self.x.part(left, right), Heights(top, bottom).of(self.y))

    def near(self, other: View | None) -> bool:
        return other is not None and self.x.near(other.x) and self.y.near(other.y)


def shown(whole: View | None, x: Span | None, heights: Heights) -> View | None:
    """All of it, or the chosen times with the chosen part of the heights."""
    return whole if whole is None or x is None else replace(whole, x=x, y=heights.of(whole.y))


def ticks(span: Span | None, count: int = TICKS) -> list[tuple[float, float]]:
    """(share from the top, value) of round values within the span, from above; about ``count`` of them."""
    if span is None or count < 1:
        return []
    if not span.size > 0 or count == 1:
        return [(0.5, (span.low + span.high) / 2)]
    rough = span.size / (count - 1)
    scale = 10.0 ** math.floor(math.log10(rough))
    step = scale * min((1, 2, 5, 10), key=lambda m: abs(math.log(m * scale / rough)))
    values = [k * step for k in range(math.ceil(span.low / step - NEAR), math.floor(span.high / step + NEAR) + 1)]
    return [(span.height_of(v), v) for v in reversed(values)]


def ticks_at(span: Span | None, shares: Iterable[float]) -> list[tuple[float, float]]:
    return [] if span is None else [(s, span.at_height(s)) for s in shares]


def first_free(taken: Iterable[int]) -> int:
    """The smallest whole number that is not taken."""
    used = set(taken)
    return next(i for i in range(len(used) + 1) if i not in used)
