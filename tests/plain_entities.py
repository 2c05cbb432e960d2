"""Entities and times of one sentence in plain Python: what the column expressions are compared with."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterable

from claimloom.functions import vocab as V

_I = re.IGNORECASE
_ABSOLUTE = re.compile(V.DATES, _I)
_RELATIVE, _RECURRING = re.compile(rf"\b(?:{V.RELATIVE})\b", _I), re.compile(rf"\b(?:{V.RECURRING})\b", _I)
_NAME = re.compile(V.NAMES)
_ORG, _TITLE = re.compile(rf"\b(?:{V.ORGANISATIONS})\b"), re.compile(rf"(?:{V.TITLES})\.?\s*$")
_FINITE = re.compile(rf"\s+(?:\w+\s+)?(?:{V.FINITE})\b")
_FIRST = re.compile(r"^\s*(?:\w+:\s*)?$")
_PLACES, _NOT_NAMES = frozenset(V.PLACES.split()), frozenset(V.NOT_NAMES.split())


def entity_id(label: str, text: str) -> str:
    return "ent_" + hashlib.sha1(f"{label}|{text.lower()}".encode()).hexdigest()[:12]


def money(text: str) -> str | None:
    """Currency and whole amount: the first unit named multiplies."""
    t = text.lower().replace(",", "").replace(" ", "")
    number = re.search(r"\d+(?:\.\d+)?", t)
    if not number:
        return None
    times = next((m for unit, m in V.MONEY_UNITS if unit in t), None)
    if times is None or (t.endswith("cr") and "crore" not in t):
        times = 10_000_000 if t.endswith("cr") else 1000 if times is None and re.search(r"\d+k$", t) else times or 1
    currency = "USD" if any(x in t for x in ("$", "usd", "dollar")) else "EUR" if "€" in t else "INR"
    return f"{currency} {float(number.group()) * times:.0f}"


def absolute_date(text: str, today: dt.date) -> str | None:
    """ISO date by the first format that fits, day first; without a year that of ``today``."""
    t = re.sub(r"(\d)(?:st|nd|rd|th)", r"\1", text).replace(",", "").replace(".", "")
    t = " ".join(t.split())
    for value, formats in ((t, V.DATE_FORMATS), (f"{t} {today.year}", [f"{f} %Y" for f in V.DAY_MONTH_FORMATS])):
        for f in formats:
            try:
                return dt.datetime.strptime(value, f).date().isoformat()
            except ValueError:
                pass
    return None


def relative_date(text: str, today: dt.date) -> str | None:
    """Months count 30 days and years 365; phrases that name no day have none."""
    t = " ".join(text.lower().split())
    fixed = {"today": 0, "aaj": 0, "tonight": 0, "abhi": 0, "just now": 0, "yesterday": 1, "tomorrow": -1}
    if t in fixed:
        return (today - dt.timedelta(days=fixed[t])).isoformat()
    if m := re.match(r"(\d+) (day|week|month|year|hour)s? ago", t):
        days = {"hour": 0, "day": 1, "week": 7, "month": 30, "year": 365}[m[2]] * int(m[1])
        try:
            return (today - dt.timedelta(days=days)).isoformat()
        except OverflowError:
            return None
    return None


class Spans:
    """Spans taken so far: one that touches an earlier one is refused."""

    def __init__(self, taken: Iterable[tuple[int, int]] = ()):
        self.taken = list(taken)

    def free(self, a: int, b: int) -> bool:
        return not any(a < e and b > s for s, e in self.taken)

    def take(self, a: int, b: int) -> bool:
        if free := self.free(a, b):
            self.taken.append((a, b))
        return free


_PATTERNED: tuple[tuple[str, re.Pattern, Callable[[str, dt.date], str | None]], ...] = (
    ("URL", re.compile(V.URL, _I), lambda t, _: t.lower()),
    ("UPI", re.compile(V.UPI, _I), lambda t, _: t.lower()),
    ("PHONE", re.compile(V.PHONE), lambda t, _: re.sub(r"\D", "", t)[-10:]),
    ("HASHTAG", re.compile(V.HASHTAG), lambda t, _: t.lower()),
    ("MONEY", re.compile(V.MONEY, _I), lambda t, _: money(t)),
    ("PERCENT", re.compile(V.PERCENT, _I), lambda t, _: re.sub(r"[^\d.]", "", t) + "%"),
    ("DATE", _ABSOLUTE, absolute_date),
    ("NUMBER", re.compile(V.NUMBER, _I), lambda t, _: t.replace(",", "").lower()),
)


def _is_name(word: str, sentence: str, start: int) -> bool:
    """Whether a lone capitalised first word is a name for another reason than its place."""
    rest = sentence[start + len(word) :]
    return bool(
        word.isupper() or _ORG.search(word) or word.lower() in _PLACES or _TITLE.search(sentence[max(0, start - 20) : start])
        or re.search(rf"\b{re.escape(word)}\b", rest) or _FINITE.match(rest)
    )


def _label(name: str, before: str) -> str:
    words = name.split()
    if _ORG.search(name):
        return "ORG"
    if any(w.lower() in _PLACES for w in words):
        return "GPE"
    if len(words) > 1 or _TITLE.search(before):
        return "PERSON"
    return "ORG" if name.isupper() else "PROPER"


def entities_of(sentence: str, today: dt.date) -> list[tuple]:
    """(id, text, label, normalized, start, end) by start. Patterns come in order of precedence, names last."""
    spans, out = Spans(), []
    for label, pattern, normal in _PATTERNED:
        for m in pattern.finditer(sentence):
            if spans.take(*m.span()):
                text = m.group().strip()
                value = normal(m.group(), today)
                out.append((entity_id(label, value or text), text, label, value, *m.span()))
    for m in _NAME.finditer(sentence):
        words, start = m.group().split(), m.start()
        while words and words[0].lower() in _NOT_NAMES:
            start += len(words.pop(0)) + 1
        name = " ".join(words)
        if len(name) < 3 or not spans.free(start, start + len(name)):
            continue
        if len(words) == 1 and _FIRST.match(sentence[:start]) and not _is_name(name, sentence, start):
            continue
        spans.take(start, start + len(name))
        label = _label(name, sentence[max(0, start - 20) : start])
        out.append((entity_id(label, name), name, label, name.lower(), start, start + len(name)))
    return sorted(out, key=lambda e: e[4])


def times_of(sentence: str, today: dt.date, entities: list[tuple] = ()) -> list[tuple]:
    """(text, kind, normalized, start, end) by start; spans of money, shares, phones and addresses are no times."""
    spans = Spans((e[4], e[5]) for e in entities if e[2] in ("MONEY", "PERCENT", "PHONE", "UPI", "URL"))
    out = []
    for kind, pattern, normal in (("absolute", _ABSOLUTE, absolute_date), ("relative", _RELATIVE, relative_date), ("recurring", _RECURRING, lambda *_: None)):
        out += [(m.group(), kind, normal(m.group(), today), *m.span()) for m in pattern.finditer(sentence) if spans.take(*m.span())]
    return sorted(out, key=lambda r: r[3])


def merge(first: list[tuple], second: list[tuple]) -> list[tuple]:
    """Entities of patterns and of a model: patterned ones stay, the model's fill gaps, guessed names what is left."""
    names = ("PERSON", "ORG", "GPE", "PROPER")
    spans, out = Spans(), []
    for group in ([e for e in first if e[2] not in names], second, [e for e in first if e[2] in names]):
        out += [e for e in group if spans.take(e[4], e[5])]
    return sorted(out, key=lambda e: e[4])


def anchored(sentence: str, found: list[tuple[str, str]]) -> list[tuple]:
    """A model's (text, label) pairs put where the sentence has them, without case; absent ones go."""
    low, out = sentence.lower(), []
    for text, label in found:
        at = low.find(text.lower())
        if text and at >= 0:
            out.append((entity_id(label, text), sentence[at : at + len(text)], label, text.lower(), at, at + len(text)))
    return out
