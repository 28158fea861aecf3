"""All phrases of all rules found in one pass over a text, and rules over phrases as rows.

The phrases of a rule set are compiled into one automaton, which goes with the function
to every task; a text is folded once and read once, however many phrases and rules there
are. What comes back are the numbers of the phrases that it holds; conditions on them are
column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType

from . import text as T

_WORD = regex.compile(rf"[\p{{Alphabetic}}\p{{M}}\p{{Nd}}\p{{Pc}}‌‍ '{T.ARABIC}]")
_MARK = regex.compile(r"\p{M}")


# names of this module's own, since functions that go to workers take whole modules with them
_FROM, _TO = T.MARKED + "`’" + T.WHITE, T.PLAIN + "''" + " " * len(T.WHITE)


class _Table(dict):
    """What each code point of a lower-case text becomes, as in ``fold`` or, without punctuation, in ``normalize_query``."""

    def __init__(self, punctuation: bool) -> None:
        super().__init__({ord(a): b for a, b in zip(_FROM, _TO)})
        self.punctuation = punctuation

    def __missing__(self, point: int) -> str:
        ch = chr(point)
        out = "" if _MARK.match(ch) else ch if self.punctuation or _WORD.match(ch) else " "
        self[point] = out
        return out


@lru_cache(maxsize=2)
def _table(punctuation: bool) -> _Table:
    return _Table(punctuation)


def folded(text: str, punctuation: bool = True) -> str:
    """``text.fold``, or without punctuation ``text.normalize_query``, of a Python string."""
    plain = text.lower().translate(_table(punctuation))
    return " ".join(x for x in plain.split(" ") if x)


@lru_cache(maxsize=64)
def _automaton(phrases: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrase in dict.fromkeys(phrases):
        if phrase:
            out.add_word(phrase, [k for k, x in enumerate(phrases) if x == phrase])
    if len(out):
        out.make_automaton()
    return out


def held(text: str, phrases: tuple[str, ...]) -> list[int]:
    """The numbers of the phrases that a folded text contains; the empty one is in every text."""
    found = {k for k, x in enumerate(phrases) if not x}
    machine = _automaton(phrases)
    if len(machine):
        for _, numbers in machine.iter(text):
            found.update(numbers)
    return sorted(found)


def phrases_in(text: Column, phrases: Iterable[str], punctuation: bool = True) -> Column:
    """Which of the phrases, by number, the folded text contains anywhere; null for a null text."""
    own = tuple(folded(x, punctuation) for x in phrases)

    @F.pandas_udf(ArrayType(IntegerType()))
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else held(folded(x, punctuation), own))

    return find(text)


@F.pandas_udf(StringType())
def normalized(text: pd.Series) -> pd.Series:
    """``text.normalize_query`` in Arrow batches, without its regular expressions."""
    return text.map(lambda x: None if x is None else folded(x, False))


@dataclass(frozen=True)
class Verdict:
    """One row of a rule table: if all that it states holds, ``good`` is the answer for ``field``.

    ``any_of``: of each group a phrase is there; ``forbid``: none of these is; ``counts``:
    (phrases, least, most) of how many are there; ``starts``: one of these is the text's
    beginning; ``shown``, ``lacks``: names of patterns that the text matches, or one of which
    it does not; the field is null for rows that hold for all.
    """

    field: str | None
    good: bool
    any_of: tuple[tuple[str, ...], ...] = ()
    forbid: tuple[str, ...] = ()
    counts: tuple[tuple[tuple[str, ...], int, int], ...] = ()
    starts: tuple[str, ...] = ()
    shown: tuple[str, ...] = ()
    lacks: tuple[str, ...] = ()

    def phrases(self) -> list[str]:
        return [*(x for g in self.any_of for x in g), *self.forbid, *(x for c in self.counts for x in c[0])]


def _holds(r: Verdict, have: set[str], plain: str, low: str, patterns: dict) -> bool:
    # a text holds few phrases, a row names many
    return (
        not any(have.isdisjoint(group) for group in r.any_of)
        and have.isdisjoint(r.forbid)
        and all(least <= sum(x in have for x in words) <= most for words, least, most in r.counts)
        and (not r.starts or low.startswith(r.starts))
        and (not r.shown or any(patterns[x](plain, low) for x in r.shown))
        and not any(patterns[x](plain, low) for x in r.lacks)
    )


def _phrases_of(rows: list[Verdict]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The phrases of all rows, and how they stand in a folded text."""
    own = tuple(dict.fromkeys(x for r in rows for x in r.phrases()))
    return own, tuple(folded(x) if x.strip() == x else x for x in own)


def _searches(patterns: dict[str, tuple[str, bool]]) -> dict:
    return {name: (lambda plain, low, p=re.compile(p), f=f: p.search(low if f else plain) is not None) for name, (p, f) in patterns.items()}


def _rows_for(field: str, rows: list[Verdict]) -> list[Verdict]:
    """The rows that are looked at for a field, their phrases as sets."""
    return [replace(r, any_of=tuple(map(frozenset, r.any_of)), forbid=frozenset(r.forbid)) for r in rows if r.field in (None, field)]


def fields_judged(text: Column, fields: list[str], rows: list[Verdict], patterns: dict[str, tuple[str, bool]]) -> Column:
    """Which of the fields a text is good for, each as ``judged``; a text is folded and read once for all of them."""
    own, kept = _phrases_of(rows)

    @F.pandas_udf(ArrayType(StringType()))
    def decide(texts: pd.Series) -> pd.Series:
        ready, by_field, out = _searches(patterns), {f: _rows_for(f, rows) for f in fields}, []
        for plain in texts.fillna(""):
            low = folded(plain)
            have = {own[k] for k in held(low, kept)}
            out.append([f for f in fields if next((r.good for r in by_field[f] if _holds(r, have, plain, low, ready)), True)])
        return pd.Series(out, dtype=object)

    return decide(text)


def judged(field: Column, text: Column, rows: list[Verdict], patterns: dict[str, tuple[str, bool]]) -> Column:
    """The first row of the field that holds decides; without one the text is good.

    ``patterns``: name -> (regular expression, whether it reads the folded text). A null text
    counts as empty. Only the rows of a text's own field are looked at.
    """
    own, kept = _phrases_of(rows)

    @F.pandas_udf(BooleanType())
    def decide(fields: pd.Series, texts: pd.Series) -> pd.Series:
        ready = _searches(patterns)
        by_field = {f: _rows_for(f, rows) for f in fields.unique()}
        last, have, low, out = None, set(), "", []
        for f, plain in zip(fields, texts.fillna("")):
            if plain != last:
                last, low = plain, folded(plain)
                have = {own[k] for k in held(low, kept)}
            out.append(next((r.good for r in by_field[f] if _holds(r, have, plain, low, ready)), True))
        return pd.Series(out, dtype=bool)

    return decide(field, text)
