"""Patterns in a form that one pass without backtracking can try on text as it is, before it is folded: RE2's, by pyarrow.

They are written from the parsed patterns, so that none can be left out. What RE2 doesn't know is dropped, so that they match more, never
less: looking ahead, words' ends and possessive repetition. Anything else that isn't known here is an error.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable
from functools import cache
from re import _constants as op
from re import _parser

Fold = Callable[[str], str]
_CATEGORIES = {op.CATEGORY_DIGIT: r"\d", op.CATEGORY_WORD: r"\w", op.CATEGORY_SPACE: r"\s\x0b"}
_REPEATS = (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT)
#: Python's parser has no Unicode properties; these stand for them while it reads
_PROPERTIES = {r"\p{L}": "\ue000", r"\p{Ll}": "\ue001", r"\p{Lu}": "\ue002", r"\p{N}": "\ue003"}


@cache
def _origins(fold: Fold) -> dict[str, str]:
    """For each character of ASCII all characters that fold() makes it of."""
    out: dict[str, str] = {}
    for c in map(chr, range(sys.maxunicode + 1)):
        if len(f := fold(c)) == 1 and f < "\x80":
            out[f] = out.get(f, "") + c
    return out


def _listed(chars: Iterable[str]) -> str:
    named = {v: k for k, v in _PROPERTIES.items()}
    return "".join(named.get(c, c if c.isalnum() else f"\\x{{{ord(c):x}}}") for c in sorted(set(chars)))


def _members(parts: Iterable[tuple], fold: Fold | None) -> str:
    """A class of the given parts and of all that folds to one of them."""
    known, sign, out = _origins(fold) if fold else {}, "", ""
    for kind, value in parts:
        if kind is op.NEGATE:
            sign = "^"
        elif kind is op.LITERAL:
            out += _listed(known.get(chr(value), "") + chr(value))
        elif kind is op.RANGE:
            out += f"\\x{{{value[0]:x}}}-\\x{{{value[1]:x}}}" + _listed(c for f, cs in known.items() if value[0] <= ord(f) <= value[1] for c in cs)
        elif kind is op.CATEGORY:
            out += _CATEGORIES[value] + _listed(c for f, cs in known.items() if re.fullmatch(f"[{_CATEGORIES[value]}]", f, re.A) for c in cs)
        else:
            raise ValueError(f"{kind} in a class")
    if sign and fold:
        raise ValueError("the complement of a class in a folded pattern")
    return f"[{sign}{out}]"


def _written(nodes: Iterable[tuple], fold: Fold | None, top: bool = False) -> str:
    out = ""
    for node in nodes:
        kind, value = node
        if fold and node == (op.LITERAL, ord(" ")):
            out += r"[\s\x0b]+"
        elif kind is op.LITERAL:
            out += _members([node], fold)
        elif kind is op.NOT_LITERAL and not fold:
            out += _members([(op.NEGATE, None), (op.LITERAL, value)], fold)
        elif kind is op.ANY:
            out += "."
        elif kind is op.IN:
            out += _members(value, fold)
        elif kind is op.BRANCH:
            out += f"(?:{'|'.join(_written(b, fold, top and not out) for b in value[1])})"
        elif kind is op.SUBPATTERN:
            out += f"(?{'i' if value[1] & re.I else ''}:{_written(value[3], fold)})"
        elif kind in _REPEATS:
            low, high, part = value
            out += f"(?:{_written(part, fold)}){{{low},{'' if high is op.MAXREPEAT else high}}}"
        elif kind is op.ASSERT and value[0] < 0 and top:
            out = _written(value[1], fold)  # what stands before is left out instead
        elif kind not in (op.ASSERT, op.ASSERT_NOT) and not (kind is op.AT and value in (op.AT_END, op.AT_BOUNDARY)):
            raise ValueError(f"{kind} in a pattern")
    return out


def unfolded(patterns: Iterable[str], fold: Fold | None = None) -> str:
    """A pattern that matches text at least wherever one of the given ones matches it folded, if every character is folded by itself.
    A space in folded patterns, outside brackets, stands for several. Without fold() the text is compared as it is."""
    out = []
    for p in patterns:
        for name, stand_in in _PROPERTIES.items():
            p = p.replace(name, stand_in)
        out.append(_written(_parser.parse(p), fold, True))
    return f"(?:{'|'.join(out)})"
