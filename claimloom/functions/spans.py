"""Spans of a text as arrays: all matches of a pattern with their places, and which of overlapping spans stay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A character of a word, in look-arounds.
_W = r"[\p{L}\p{N}_]"
_BORDER = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
#: Marks that stand before and after a match while it is cut out; a text's own are blanked first, which moves nothing.
_OPEN, _CLOSE = "\ue000", "\ue001"
SPAN = "struct<text:string,start:int,end:int>"


def unicode(pattern: str) -> str:
    """A pattern whose word characters and borders are those of all scripts."""
    out = pattern.replace(r"[\w.\-]", r"[\p{L}\p{N}_.\-]").replace(r"[\w.]", r"[\p{L}\p{N}_.]")
    return out.replace(r"\w", _W).replace(r"\b", _BORDER)


def ascii_digits(text: Column) -> Column:
    return F.translate(text, "०१२३४५६७८९", "0123456789")


def matches(text: Column, pattern: str) -> Column:
    """array<struct<text, start, end>>: all matches from left to right, none overlapping; places count from 0, end exclusive.

    The matches are marked and the text cut at the marks, so that every other piece is a match and places are running
    sums of lengths. Devanagari digits match as digits. Null has none. A text without a match costs one search.
    """
    odd = text.rlike(f"[{_OPEN}{_CLOSE}०-९]")
    bare = F.when(odd, F.translate(text, f"०१२३४५६७८९{_OPEN}{_CLOSE}", "0123456789  ")).otherwise(text)
    none = F.array().cast(f"array<{SPAN}>")
    empty = F.struct(none.alias("out"), F.lit(0).alias("at"), F.lit(False).alias("inside"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        span = F.struct(F.substr(text, acc["at"] + 1, F.length(piece)).alias("text"), acc["at"].alias("start"), end.alias("end"))
        return F.struct(F.when(acc["inside"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"), end.alias("at"), (~acc["inside"]).alias("inside"))

    marked = F.array(F.coalesce(F.regexp_replace(bare, pattern, f"{_OPEN}$0{_CLOSE}"), F.lit("")))
    return F.transform(marked, lambda m: F.when(F.contains(m, F.lit(_OPEN)), F.aggregate(F.split(m, f"[{_OPEN}{_CLOSE}]"), empty, step)["out"]).otherwise(none))[0]


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def resolved(spans: Column, kind: str, taken: Column | None = None) -> Column:
    """Of spans in order of precedence, those that overlap no earlier one that stays, nor one of ``taken``; by start.

    ``kind`` is the spans' type. Empty spans overlap what they lie inside of.
    """
    def step(kept: Column, x: Column) -> Column:
        clash = F.exists(kept, lambda k: overlap(k, x))
        if taken is not None:
            clash = clash | F.exists(taken, lambda t: overlap(t, x))
        return F.when(clash, kept).otherwise(F.array_append(kept, x))

    kept = F.aggregate(spans, F.array().cast(f"array<{kind}>"), step)
    by_start = lambda k: F.array_sort(k, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    return F.transform(F.array(kept), lambda k: F.when(F.size(k) < 2, k).otherwise(by_start(k)))[0]
