"""Devanagari of romanised Hindi words by rule: how the built-in lexicon is made."""

from __future__ import annotations

import re

# Letters.
CONSONANTS = {
    "chh": "छ", "kh": "ख", "gh": "घ", "ch": "च", "jh": "झ", "th": "थ", "dh": "ध", "ph": "फ", "bh": "भ", "sh": "श", "k": "क", "g": "ग", "j": "ज", "t": "त", "d": "द", "n": "न", "p": "प", "b": "ब", "m": "म",
    "y": "य", "r": "र", "l": "ल", "v": "व", "w": "व", "s": "स", "h": "ह", "f": "फ", "z": "ज़", "q": "क",
}
#: Each vowel as a sign after a consonant and as a letter of its own.
VOWELS = {"aa": ("ा", "आ"), "ai": ("ै", "ऐ"), "au": ("ौ", "औ"), "ee": ("ी", "ई"), "ii": ("ी", "ई"), "oo": ("ू", "ऊ"), "uu": ("ू", "ऊ"), "a": ("", "अ"), "i": ("ि", "इ"), "u": ("ु", "उ"), "e": ("े", "ए"), "o": ("ो", "ओ")}
#: At a word's end these are long.
FINAL = {"a": "aa", "i": "ee", "u": "oo"}
_UNIT = re.compile("|".join(sorted([*CONSONANTS, *VOWELS], key=len, reverse=True)))
_JOINED = {"y", "r", "v", "w"}


def by_rule(word: str) -> str:
    """The longest letters first; a consonant keeps its vowel sign, joins a following y, r or v and its own like, and n
    before another consonant, or at the end after ai, ei, oo, o or hi, is a nasal dot."""
    units = _UNIT.findall(word.lower())
    out, after = "", ""
    for k, u in enumerate(units):
        last = k == len(units) - 1
        following = None if last else units[k + 1]
        if u in VOWELS:
            v = FINAL.get(u, u) if last else u
            out += VOWELS[v][0 if after in CONSONANTS else 1]
        elif u == "n" and after in VOWELS and (following in CONSONANTS and following not in (*_JOINED, "n", "h") or last and (after in ("ai", "oo", "o") or word.endswith(("ein", "hin", "kyun", "hun")))):
            out += "ं"
        else:
            joined = following in _JOINED and u not in ("r", "y", "h", "n") or following is not None and following in CONSONANTS and (following == u or following.startswith(u) and u == "ch")
            out += CONSONANTS[u] + ("्" if joined and following in CONSONANTS else "")
        after = u
    return out


def table(words: str, exceptions: dict[str, str]) -> dict[str, str]:
    """{roman: Devanagari} of a list of words, by rule unless an exception says otherwise."""
    return {w: exceptions.get(w) or by_rule(w) for w in words.split()}
