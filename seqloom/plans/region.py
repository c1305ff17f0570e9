"""Regions of a concatenated sequence: ``ID``, ``START-END`` or ``ID:START-END``, 0-based, half-open."""

from __future__ import annotations

import re
from dataclasses import dataclass

from seqloom.errors import InvalidInput

_NUMBER = re.compile(r"\+?[0-9]+")


@dataclass(frozen=True)
class Region:
    """``id`` and/or ``start``-``end``; which of them are set tells the kind."""

    id: str | None = None
    start: int | None = None
    end: int | None = None

    def __post_init__(self) -> None:
        if (self.start is None) != (self.end is None):
            raise InvalidInput("a region needs both ends or neither")
        if self.id is None and self.start is None:
            raise InvalidInput("a region needs an id or an interval")
        if self.id == "":
            raise InvalidInput("a region's id is empty")
        if self.start is not None and self.start >= self.end:
            raise InvalidInput("a region's interval is empty")

    @property
    def kind(self) -> str:
        return "slice" if self.id is None else "id" if self.start is None else "id_slice"

    def pretty(self) -> str:
        """Label with thousands separators."""
        return _label(self.id, ":", f"{self.start:,}-{self.end:,}" if self.start is not None else None)

    def file_label(self) -> str:
        return _label(self.id, "_", f"{self.start}-{self.end}" if self.start is not None else None)


def _label(name: str | None, sep: str, span: str | None) -> str:
    return sep.join(p for p in (name, span) if p is not None)


def _interval(text: str) -> tuple[int, int] | None:
    left, dash, right = text.rpartition("-")
    if dash and _NUMBER.fullmatch(left) and _NUMBER.fullmatch(right) and int(left) < int(right):
        return int(left), int(right)
    return None


def parse_region(text: str) -> Region | None:
    """The region that a text names, None where it names none.

    The last colon parts id and interval; without a valid interval behind it the whole text is an id.
    """
    head, colon, tail = text.rpartition(":")
    span = _interval(tail if colon else text)
    if span is None:
        return Region(id=text) if head or (not colon and text) else None
    if colon:
        return Region(head, *span) if head else None
    return Region(None, *span)
