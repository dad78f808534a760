"""Bit layouts as data: fields in the order of a format's syntax table, with conditions and repeats, and one reader."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

Values = dict[str, int]
UNSIGNED, SIGNED = "ue", "se"  # variable-length (Exp-Golomb) numbers


@dataclass(frozen=True)
class When:
    """A part that is present if ``test`` holds for the fields before it."""

    test: Callable[[Values], object]
    part: tuple


@dataclass(frozen=True)
class Repeat:
    """A part that is present ``count`` times."""

    count: Callable[[Values], int]
    part: tuple


@dataclass(frozen=True)
class While:
    """A part that is read once, and again as long as ``test`` holds after it."""

    test: Callable[[Values], object]
    part: tuple


@dataclass(frozen=True)
class Derive:
    """A value that follows from others and takes no bits."""

    name: str
    value: Callable[[Values], int]


@dataclass(frozen=True)
class Require:
    """What has to hold for the data to be in this format."""

    test: Callable[[Values], object]


def fields(text: str) -> tuple:
    """``"sync:12 id:1 size:ue"`` as a layout; a name that occurs again takes the later value."""
    pairs = [part.split(":") for part in text.split()]
    return tuple((name, kind if kind in (UNSIGNED, SIGNED) else int(kind)) for name, kind in pairs)


class _Source:
    def __init__(self, data: bytes):
        self.bits, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def number(self, kind: int | str) -> int | None:
        """The next number; None behind the end."""
        if isinstance(kind, int):
            if kind > self.left:
                return None
            self.left -= kind
            return self.bits >> self.left & ((1 << kind) - 1)
        rest = self.bits & ((1 << self.left) - 1)
        zeros = self.left - rest.bit_length()
        code = self.number(2 * zeros + 1) if rest else None
        if code is None or kind == UNSIGNED:
            return None if code is None else code - 1
        return code // 2 if code % 2 == 0 else -(code // 2)


def read(layout: Iterable, data: bytes) -> Values | None:
    """Fields of ``data`` and ``left``, the bits behind them; None if it is too short or a requirement fails."""
    source, values = _Source(data), {}
    return values | {"left": source.left} if _fill(layout, source, values) else None


def _fill(layout: Iterable, source: _Source, values: Values) -> bool:
    for item in layout:
        if isinstance(item, tuple):
            name, kind = item
            values[name] = source.number(kind)
            if values[name] is None:
                return False
        elif isinstance(item, Derive):
            values[item.name] = item.value(values)
        elif isinstance(item, Require):
            if not item.test(values):
                return False
        elif isinstance(item, When):
            if item.test(values) and not _fill(item.part, source, values):
                return False
        elif isinstance(item, Repeat):
            if not all(_fill(item.part, source, values) for _ in range(item.count(values))):
                return False
        else:
            going = True
            while going:
                if not _fill(item.part, source, values):
                    return False
                going = item.test(values)
    return True
