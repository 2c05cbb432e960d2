"""Which of many words and phrases a text has, by its words: one cut into words, then lookups; patterns only where a phrase may begin."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions import text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An alternative that any word ending so is: letters, then one of these.
ENDINGS = "[a-z]+(?:ed|es|ing|s)"


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, outside of its parentheses."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            out.append(pattern[start:k])
            start = k + 1
    return [*out, pattern[start:]]


def first_words(alternative: str) -> list[str] | None:
    """The words that a phrase may begin with, or None if they cannot be listed. ``x?`` is with and without x."""
    head = re.match(r"(?:[a-z0-9]\??)+(?=\s|\\s|%| )", alternative)
    if not head:
        return None
    letters = re.findall(r"([a-z0-9])(\??)", head.group())
    return ["".join(p) for p in product(*[(c, "") if o else (c,) for c, o in letters])]


@dataclass
class Phrases:
    """A set of alternatives between word borders, without case: words, and phrases with what they begin with."""

    words: set[str] = field(default_factory=set)
    first: set[str] = field(default_factory=set)
    guarded: list[str] = field(default_factory=list)
    numbered: list[str] = field(default_factory=list)  # begin with a digit
    free: list[str] = field(default_factory=list)
    endings: bool = False

    @classmethod
    def of(cls, pattern: str) -> Phrases:
        out = cls()
        for a in alternatives(pattern):
            heads = first_words(a)
            if re.fullmatch("[a-z0-9]+", a):
                out.words.add(a)
            elif a == ENDINGS:
                out.endings = True
            elif heads:
                out.first.update(heads)
                out.guarded.append(a)
            elif re.match(r"\\d|\(\?:\d+\|\d+\)\\d", a):
                out.numbered.append(a)
            else:
                out.free.append(a)
        return out

    def found(self, s: Column, words: Column, known: Column, digits: Column) -> Column:
        """Whether the text has one. ``words``: its words; ``known``: those of any set; ``digits``: whether it has one."""
        has = lambda ws: F.exists(known, lambda w: w.isin(*sorted(ws)))
        out = has(self.words) if self.words else F.lit(False)
        if self.endings:
            out = out | F.exists(words, lambda w: (w.endswith("s") | w.endswith("ed") | w.endswith("ing")) & w.rlike(f"^{ENDINGS}$"))
        if self.guarded:
            out = out | (has(self.first) & s.rlike(text.whole("|".join(self.guarded))))
        if self.numbered:
            out = out | (digits & s.rlike(text.whole("|".join(self.numbered))))
        if self.free:
            out = out | s.rlike(text.whole("|".join(self.free)))
        return out


def words_of(s: Column) -> Column:
    """Words of a text with A-Z lower-cased: runs of letters, digits and underscores."""
    # F.lower is far faster, and the same but for the two letters beyond A-Z that become ASCII
    low = F.when(s.rlike("[\u0130\u212a]"), F.translate(s, UPPER, LOWER)).otherwise(F.lower(s))
    return F.split(low, f"[^{text.W}]+")


def vocabulary(sets: dict[str, Phrases]) -> list[str]:
    return sorted(set().union(*[p.words | p.first for p in sets.values()]))


def known(words: Column, sets: dict[str, Phrases]) -> Column:
    """The distinct words of a text that any of the sets asks for."""
    every = vocabulary(sets)
    return F.array_distinct(F.filter(words, lambda w: w.isin(*every)))
