"""Lines in visual order: the implicit part of the Unicode reordering, for lines that are Arabic enough."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text as T

#: Least share of Arabic among a line's letters.
LEAST = 0.1
#: Pairs that look the other way from right to left.
MIRRORED = dict(zip("()[]{}<>«»‹›≤≥", ")(][}{><»«›‹≥≤"))
#: Marks of explicit direction are left out.
EXPLICIT = {"LRE", "RLE", "LRO", "RLO", "PDF", "LRI", "RLI", "FSI", "PDI", "BN"}


def _weak(kinds: list[str], base: str) -> list[str]:
    """Numbers, separators and marks take a strong, a number's or a neutral kind (rules W1 to W7)."""
    out, before, strong = [], base, base
    for kind in kinds:
        kind = before if kind == "NSM" else kind
        before = kind
        if kind in ("L", "R", "AL"):
            strong = kind
        out.append("AN" if kind == "EN" and strong == "AL" else kind)
    out = ["R" if k == "AL" else k for k in out]
    for i in range(1, len(out) - 1):
        around = {out[i - 1], out[i + 1]}
        if (out[i] in ("ES", "CS") and around == {"EN"}) or (out[i] == "CS" and around == {"AN"}):
            out[i] = out[i - 1]
    start = 0
    while start < len(out):
        end = start
        while end < len(out) and out[end] == "ET":
            end += 1
        if end > start and ((start and out[start - 1] == "EN") or (end < len(out) and out[end] == "EN")):
            out[start:end] = ["EN"] * (end - start)
        start = max(end, start + 1)
    strong = base
    for i, kind in enumerate(out):
        kind = "ON" if kind in ("ES", "ET", "CS") else kind
        strong = kind if kind in ("L", "R") else strong
        out[i] = "L" if kind == "EN" and strong == "L" else kind
    return out


def _neutral(kinds: list[str], base: str) -> list[str]:
    """Neutrals between equal directions take it, others the line's (rules N1, N2); numbers count as right to left."""
    out, start = list(kinds), 0
    side = lambda k: "R" if k in ("EN", "AN", "R") else "L"
    while start < len(out):
        end = start
        while end < len(out) and kinds[end] not in ("L", "R", "EN", "AN"):
            end += 1
        if end > start:
            left = side(kinds[start - 1]) if start else base
            right = side(kinds[end]) if end < len(out) else base
            out[start:end] = [left if left == right else base] * (end - start)
        start = max(end, start + 1)
    return out


def visual(line: str) -> str:
    """One line in visual order; its direction is that of its first letter, without one from left to right.

    Brackets are mirrored where they stand from right to left. Marks of explicit
    direction are dropped and have no other effect; pairs of brackets are not matched.
    """
    chars = [c for c in line if unicodedata.bidirectional(c) not in EXPLICIT]
    kinds = [unicodedata.bidirectional(c) or "L" for c in chars]
    base = next(("L" if k == "L" else "R" for k in kinds if k in ("L", "R", "AL")), "L")
    solved = _neutral(_weak(kinds, base), base)
    even = base == "L"
    levels = [{"L": 0, "R": 1, "AN": 2, "EN": 2}[k] if even else {"R": 1, "L": 2, "AN": 2, "EN": 2}[k] for k in solved]
    # white space at the end and separators go with the line
    trailing = True
    for i in range(len(chars) - 1, -1, -1):
        trailing = trailing and kinds[i] in ("WS", "S", "B") or kinds[i] in ("S", "B")
        levels[i] = int(not even) if trailing else levels[i]
    shown = [(MIRRORED.get(c, c) if n % 2 else c, n) for c, n in zip(chars, levels)]
    for level in range(max(levels, default=0), 0, -1):
        start = 0
        while start < len(shown):
            end = start
            while end < len(shown) and shown[end][1] >= level:
                end += 1
            shown[start:end] = shown[start:end][::-1]
            start = max(end, start + 1)
    return "".join(c for c, _ in shown)


@F.pandas_udf(StringType())
def _visual(texts: pd.Series, turned: pd.Series) -> pd.Series:
    line = lambda x, turn: visual(x) if turn else x
    return pd.Series([None if t is None else "\n".join(map(line, t.split("\n"), own)) for t, own in zip(texts, turned)])


def visual_lines(text: Column, least: float = LEAST) -> Column:
    """``text`` with each line whose share of Arabic is above ``least`` in visual order, all others as they are; null stays null.

    Which lines are turned is settled in the JVM; only texts that have one go to Python.
    """
    turned = F.transform(F.split(text, "\n", -1), lambda x: T.arabic_ratio(x) > least)
    some = F.when(F.exists(turned, lambda x: x), text)
    return F.coalesce(_visual(some, F.when(some.isNotNull(), turned)), text)
