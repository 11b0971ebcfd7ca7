"""Ropes over units: text as a balanced tree that is split and joined without copying it.

A unit is a run of ASCII letters or any other single code point. Leaves hold
some thousand code points and end where a unit ends, so the units of a rope
are the units of its leaves. Each node caches how many units and code points
lie below it, and both numbers lead down to a place in logarithmic steps.
Nodes never change: a split shares all subtrees that it doesn't cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

LEAF_CHARS = 2_048
_RUN_END = re.compile(r"[A-Za-z]*")


def _unit_starts(text: str) -> np.ndarray:
    """For each code point, whether a unit starts there."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((code | 32) - ord("a")) < 26
    starts = ~letter
    starts[:1] = True
    starts[1:] |= letter[1:] & ~letter[:-1]
    return starts


@dataclass(frozen=True, slots=True)
class Leaf:
    text: str
    units: int
    chars: int
    height: int = 0


@dataclass(frozen=True, slots=True)
class Node:
    left: Leaf | Node
    right: Leaf | Node
    units: int
    chars: int
    height: int


Rope = Leaf | Node
EMPTY = Leaf("", 0, 0)


def leaf(text: str) -> Leaf:
    return Leaf(text, int(_unit_starts(text).sum()), len(text)) if text else EMPTY


def _node(left: Rope, right: Rope) -> Node:
    return Node(left, right, left.units + right.units, left.chars + right.chars, 1 + max(left.height, right.height))


def _level(left: Rope, right: Rope) -> Rope:
    """A node of two ropes whose heights differ by two at most, turned so that those of its children differ by one at most."""
    if left.height > right.height + 1:
        if left.left.height < left.right.height:
            left = _node(_node(left.left, left.right.left), left.right.right)
        return _node(left.left, _node(left.right, right))
    if right.height > left.height + 1:
        if right.right.height < right.left.height:
            right = _node(right.left.left, _node(right.left.right, right.right))
        return _node(_node(left, right.left), right.right)
    return _node(left, right)


def concat(left: Rope, right: Rope) -> Rope:
    """Both ropes one after the other; goes down the taller one's edge to where the other fits.

    A run of letters that would go on from the left rope into the right one
    stays two units, so join only where a unit ends.
    """
    if not left.chars:
        return right
    if not right.chars:
        return left
    if left.height > right.height + 1:
        return _level(left.left, concat(left.right, right))
    if right.height > left.height + 1:
        return _level(concat(left, right.left), right.right)
    return _node(left, right)


def split(rope: Rope, units: int) -> tuple[Rope, Rope]:
    """The first so many units of a rope, and the rest."""
    if units <= 0:
        return EMPTY, rope
    if units >= rope.units:
        return rope, EMPTY
    if isinstance(rope, Leaf):
        at = int(np.flatnonzero(_unit_starts(rope.text))[units])
        return Leaf(rope.text[:at], units, at), Leaf(rope.text[at:], rope.units - units, rope.chars - at)
    if units <= rope.left.units:
        a, b = split(rope.left, units)
        return a, concat(b, rope.right)
    a, b = split(rope.right, units - rope.left.units)
    return concat(rope.left, a), b


def unit_of(rope: Rope, char: int) -> int:
    """How many units start before a code point's place."""
    before = 0
    while isinstance(rope, Node):
        if char < rope.left.chars:
            rope = rope.left
        else:
            char, before, rope = char - rope.left.chars, before + rope.left.units, rope.right
    return before + int(_unit_starts(rope.text)[:char].sum()) if char else before


def leaves(rope: Rope) -> Iterator[Leaf]:
    todo = [rope]
    while todo:
        r = todo.pop()
        if isinstance(r, Leaf):
            yield r
        else:
            todo += [r.right, r.left]


def _balanced(row: list[Leaf]) -> Rope:
    if len(row) < 2:
        return row[0] if row else EMPTY
    half = (len(row) + 1) // 2
    return _node(_balanced(row[:half]), _balanced(row[half:]))


def build(text: str, width: int = LEAF_CHARS) -> Rope:
    """A balanced rope of a text. A run of letters longer than a leaf stays in one leaf."""
    row: list[Leaf] = []
    at = 0
    while at < len(text):
        end = min(at + width, len(text))
        if text[end - 1].isascii() and text[end - 1].isalpha():
            end = _RUN_END.match(text, end).end()
        row.append(leaf(text[at:end]))
        at = end
    return _balanced(row)


def text_of(rope: Rope) -> str:
    return "".join(x.text for x in leaves(rope))


def find(rope: Rope, mark: str) -> int:
    """The place of the first ``mark`` in code points, -1 if there is none; leaves are searched one by one, ends carried over."""
    at, carried = 0, ""
    for x in leaves(rope):
        here = carried + x.text
        hit = here.find(mark)
        if hit >= 0:
            return at - len(carried) + hit
        at += x.chars
        carried = here[-(len(mark) - 1) :] if len(mark) > 1 else ""
    return -1


def sha256(rope: Rope) -> str:
    h = hashlib.sha256()
    for x in leaves(rope):
        h.update(x.text.encode("utf-8", "surrogatepass"))
    return h.hexdigest()
