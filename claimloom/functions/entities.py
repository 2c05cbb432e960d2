"""Entities and times of a sentence as column expressions: patterns in order of precedence, then names, then a model's."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions import ids, phrases, spans
from claimloom.functions import vocab as V

ENTITIES = "array<struct<id:string,text:string,label:string,normalized:string,start:int,end:int>>"
TIMES = "array<struct<text:string,kind:string,normalized:string,start:int,end:int>>"

_KIND = ENTITIES.removeprefix("array<").removesuffix(">")
_TIME = TIMES.removeprefix("array<").removesuffix(">")
_I = "(?iu)"
_DATE = _I + spans.unicode(V.DATES)
#: What every relative and every recurring time has, in small letters.
_RELATIVE_HINT = "ago|today|yesterday|to(?:morrow|night)|(?:last|next|this)\\s|aaj|kal|parso|abhi|recently|just now"
_RECURRING_HINT = "every\\s|daily|(?:week|month)ly|annually"
#: Twice each month, in full and short.
_MONTHS = "january jan february feb march mar april apr may may june jun july jul august aug september sep october oct november nov december dec"


def _bound(value: Column, read) -> Column:
    """``read`` of a value that is made once, where written out it would be made at each place it stands."""
    return F.transform(F.array(value), read)[0]


def money(text: Column) -> Column:
    """Currency and whole amount: the first unit named multiplies."""
    return _bound(spans.ascii_digits(F.translate(F.lower(text), ", ", "")), _money)


def _money(t: Column) -> Column:
    number = F.nullif(F.regexp_extract(t, r"\d+(?:\.\d+)?", 0), F.lit("")).cast("double")
    named = F
    for unit, m in V.MONEY_UNITS:
        named = named.when(F.contains(t, F.lit(unit)), F.lit(m))
    named = named.otherwise(F.lit(None).cast("int"))
    cr = t.endswith("cr") & ~F.contains(t, F.lit("crore"))
    times = F.when(cr, 10_000_000).when(named.isNull() & t.rlike(r"\d+k$"), 1000).otherwise(F.coalesce(named, F.lit(1)))
    has = lambda *xs: F.exists(F.array(*[F.lit(x) for x in xs]), lambda x: F.contains(t, x))
    currency = F.when(has("$", "usd", "dollar"), "USD").when(has("€"), "EUR").otherwise("INR")
    return F.when(number.isNotNull(), F.concat(currency, F.lit(" "), F.bround(number * times.cast("double"), 0).cast("decimal(38,0)").cast("string")))


def _iso(year: Column, month: Column, day: Column) -> Column:
    made = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month.cast("string"), day.cast("string")), "yyyy-M-d")
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull() & (year.cast("int") >= 1), F.date_format(made, "yyyy-MM-dd"))


def absolute_date(text: Column, today: dt.date) -> Column:
    """ISO date by the first form that fits, day first; without a year that of ``today``."""
    t = F.trim(F.regexp_replace(F.translate(F.regexp_replace(spans.ascii_digits(text), r"(\d)(?:st|nd|rd|th)", "$1"), ",.", ""), r"\s+", " "))
    return _bound(t, lambda t: _absolute_date(t, today))


def _absolute_date(t: Column, today: dt.date) -> Column:
    get = lambda pattern, k: F.nullif(F.regexp_extract(t, pattern, k), F.lit(""))
    num = lambda pattern, k: get(pattern, k).cast("int")
    place = lambda word: F.array_position(F.split(F.lit(_MONTHS), " "), F.lower(word))
    name = lambda pattern, k: F.nullif(F.floor((place(get(pattern, k)) + 1) / 2), F.lit(0)).cast("int")
    one = F.lit(1)
    dmy, mdy, my = r"^(\d{1,2}) ([A-Za-z]+) (\d{4})$", r"^([A-Za-z]+) (\d{1,2}) (\d{4})$", r"^([A-Za-z]+) (\d{4})$"
    long_, short, iso, year = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})$", r"^(\d{1,2})([/-])(\d{1,2})\2(\d{2})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{4})$"
    dm, md = r"^(\d{1,2}) ([A-Za-z]+)$", r"^([A-Za-z]+) (\d{1,2})$"
    two = num(short, 4)
    this = F.lit(today.year)
    return F.coalesce(
        _iso(num(dmy, 3), name(dmy, 2), num(dmy, 1)), _iso(num(mdy, 3), name(mdy, 1), num(mdy, 2)), _iso(num(long_, 4), num(long_, 3), num(long_, 1)),
        _iso(F.when(two >= 69, two + 1900).otherwise(two + 2000), num(short, 3), num(short, 1)), _iso(num(iso, 1), num(iso, 2), num(iso, 3)), _iso(num(my, 2), name(my, 1), one), _iso(num(year, 1), one, one),
        _iso(this, name(dm, 2), num(dm, 1)), _iso(this, name(md, 1), num(md, 2)),
    )


def relative_date(text: Column, today: dt.date) -> Column:
    """Months count 30 days and years 365; phrases that name no day, and days outside the calendar, have none."""
    t = F.trim(F.regexp_replace(spans.ascii_digits(F.lower(text)), r"\s+", " "))
    day = lambda n: (today + dt.timedelta(days=n)).isoformat()
    ago = r"^(\d+) (day|week|month|year|hour)s? ago"
    n = F.try_to_number(F.regexp_extract(t, ago, 1), F.lit("999999999999999999")).cast("double")
    per = F.element_at(F.create_map(*[F.lit(x) for p in {"hour": 0, "day": 1, "week": 7, "month": 30, "year": 365}.items() for x in p]), F.nullif(F.regexp_extract(t, ago, 2), F.lit("")))
    back = n * per
    known = back.between(0, (today - dt.date(1, 1, 1)).days)
    then = F.date_format(F.date_sub(F.lit(today), F.when(known, back).cast("int")), "yyyy-MM-dd")
    return F.when(t.isin("today", "aaj", "tonight", "abhi", "just now"), day(0)).when(t == "yesterday", day(-1)).when(t == "tomorrow", day(1)).when(known, then)


def _entity(label: Column | str, text: Column, normalized: Column, start: Column, end: Column) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    return F.struct(ids.entity_id(label, F.coalesce(normalized, text)).alias("id"), text.alias("text"), label.alias("label"), normalized.alias("normalized"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def _patterned(s: Column, today: dt.date) -> list[Column]:
    """Spans by pattern, in order of precedence; each pattern is searched only where a character it needs occurs."""
    digits = r"\p{Nd}"
    rules = [
        ("URL", V.URL, _I, r"(?i)://|www", lambda t: F.lower(t)), ("UPI", V.UPI, _I, "@", lambda t: F.lower(t)), ("PHONE", V.PHONE, "", digits, lambda t: F.right(F.regexp_replace(t, r"[^\p{Nd}]", ""), F.lit(10))), ("HASHTAG", V.HASHTAG, "", "#", lambda t: F.lower(t)),
        ("MONEY", V.MONEY, _I, digits, money), ("PERCENT", V.PERCENT, _I, digits, lambda t: F.concat(F.regexp_replace(t, r"[^\p{Nd}.]", ""), F.lit("%"))),
        ("DATE", V.DATES, _I, digits, lambda t: absolute_date(t, today)), ("NUMBER", V.NUMBER, _I, digits, lambda t: F.lower(F.translate(t, ",", ""))),
    ]
    none = F.array().cast(f"array<{_KIND}>")

    def found(label: str, pattern: str, normal) -> Column:
        read = F.transform(spans.matches(s, pattern), lambda m: F.struct(m["text"].alias("text"), normal(m["text"]).alias("normalized"), m["start"].alias("start"), m["end"].alias("end")))
        return F.transform(read, lambda m: _entity(label, F.trim(m["text"]), m["normalized"], m["start"], m["end"]))

    return [F.when(s.rlike(needs), found(label, flags + spans.unicode(pattern), normal)).otherwise(none) for label, pattern, flags, needs, normal in rules]


def _names(s: Column) -> Column:
    """Capitalised runs without leading function words; a lone first word only if something else shows that it is a name."""
    ends, titles, finite = spans.unicode(rf"\b(?:{V.ORGANISATIONS})\b"), rf"(?:{V.TITLES})\.?\s*$", "^" + spans.unicode(rf"\s+(?:\w+\s+)?(?:{V.FINITE})\b")
    not_names, places = V.NOT_NAMES.split(), V.PLACES.split()

    def trimmed(m: Column) -> Column:
        words = F.filter(F.split(m["text"], r"\s+"), lambda w: w != "")
        lead = lambda ws: F.aggregate(ws, F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit(True).alias("on")), lambda a, w: F.when(a["on"] & F.lower(w).isin(*not_names), F.struct((a["n"] + 1).alias("n"), (a["at"] + F.length(w) + 1).alias("at"), F.lit(True).alias("on"))).otherwise(F.struct(a["n"].alias("n"), a["at"].alias("at"), F.lit(False).alias("on"))))
        left = lambda ws, a: F.struct(F.slice(ws, a["n"] + 1, F.size(ws)).alias("words"), (m["start"] + a["at"]).alias("start"))
        named = lambda k: F.struct(F.array_join(k["words"], " ").alias("text"), F.size(k["words"]).alias("n"), k["start"].alias("start"))
        placed = lambda k: F.struct(k["text"].alias("text"), k["n"].alias("n"), k["start"].alias("start"), (k["start"] + F.length(k["text"])).alias("end"))
        return _bound(words, lambda ws: _bound(lead(ws), lambda a: _bound(left(ws, a), lambda k: _bound(named(k), placed))))

    before = lambda m: F.substr(s, F.greatest(m["start"] - 20, F.lit(0)) + 1, F.least(m["start"], F.lit(20)))
    rest = lambda m: F.substr(s, m["end"] + 1, F.greatest(F.length(s) - m["end"], F.lit(0)))
    place = lambda m: F.exists(F.split(m["text"], " "), lambda w: F.lower(w).isin(*places))
    capitals = lambda m: (m["text"] == F.upper(m["text"])) & m["text"].rlike(r"\p{L}")

    def shown(m: Column) -> Column:
        again = F.contains(rest(m), m["text"]) & F.regexp_like(rest(m), F.concat(F.lit(rf"(?<!{spans._W})\Q"), m["text"], F.lit(rf"\E(?!{spans._W})")))
        return capitals(m) | m["text"].rlike(ends) | place(m) | before(m).rlike(titles) | rest(m).rlike(finite) | again

    def label(m: Column) -> Column:
        return F.when(m["text"].rlike(ends), "ORG").when(place(m), "GPE").when((m["n"] > 1) | before(m).rlike(titles), "PERSON").when(capitals(m), "ORG").otherwise("PROPER")

    # a run ends the pattern, so it takes all it can and keeps it ("+"): with ways back Java goes one call deeper a word, and some 2,000 end the stack and the executor with it
    found = F.filter(F.transform(spans.matches(s, spans.unicode(V.NAMES + "+")), trimmed), lambda m: F.length(m["text"]) >= 3)
    first = lambda m: F.substr(s, F.lit(1), m["start"]).rlike(spans.unicode(r"^\s*(?:\w+:\s*)?$"))
    kept = F.filter(found, lambda m: (m["n"] > 1) | ~first(m) | shown(m))
    return F.transform(kept, lambda m: _bound(label(m), lambda x: _entity(x, m["text"], F.lower(m["text"]), m["start"], m["end"])))


def model_entities(sentence: Column, hits: Column) -> Column:
    """A tagger's spans: known kinds of enough score and two characters or more, at their places.

    ``hits`` is array<struct<entity_group, score, start, end>>, places counted from 0; null is none.
    """
    labels = F.create_map(*[F.lit(x) for p in V.TAGGED.items() for x in p])
    text = lambda h: F.trim(F.substr(sentence, h["start"] + 1, F.greatest(h["end"] - h["start"], F.lit(0))))
    good = F.filter(hits, lambda h: F.element_at(labels, h["entity_group"]).isNotNull() & (h["score"] >= V.TAGGED_SCORE) & (F.length(text(h)) >= 2))
    found = F.transform(good, lambda h: _entity(F.element_at(labels, h["entity_group"]), text(h), F.lower(text(h)), h["start"], h["start"] + F.length(text(h))))
    return F.coalesce(found, F.array().cast(f"array<{_KIND}>"))


def anchored(sentence: Column, named: Column) -> Column:
    """A model's (text, label) pairs put where the sentence has them first, without case; absent and empty ones go.

    ``named`` is array<struct<text, label>>; null is none.
    """
    at = lambda e: F.instr(F.lower(sentence), F.lower(e["text"]))
    there = F.filter(named, lambda e: (F.coalesce(e["text"], F.lit("")) != "") & (at(e) > 0))
    found = F.transform(there, lambda e: _entity(e["label"], F.substr(sentence, at(e), F.length(e["text"])), F.lower(e["text"]), at(e) - 1, at(e) - 1 + F.length(e["text"])))
    return F.coalesce(found, F.array().cast(f"array<{_KIND}>"))


def merged(first: Column, second: Column) -> Column:
    """Entities of two readings: those of the first stay, those of the second fill gaps."""
    return spans.resolved(F.concat(first, second), _KIND)


def entities(sentence: Column, today: dt.date, model: Column | None = None, names: bool = True) -> Column:
    """array<struct<id, text, label, normalized, start, end>> by start.

    Precedence: patterns (addresses, payment ids, phones, hashtags, amounts, shares, dates, numbers), then a model's
    spans if there are any, then names by their capitals. Null and empty sentences have none. Without ``names`` the
    others are the same, as names come last.
    """
    s = F.coalesce(sentence, F.lit(""))
    parts = [*_patterned(s, today), *([] if model is None else [model]), *([_names(s)] if names else [])]
    return spans.resolved(F.concat(*parts), _KIND)


def times(sentence: Column, today: dt.date, found: Column | None = None) -> Column:
    """array<struct<text, kind, normalized, start, end>> by start: absolute, then relative, then recurring times.

    Spans of amounts, shares, phones, payment ids and addresses among ``found`` entities are no times.
    """
    s = F.coalesce(sentence, F.lit(""))
    words = _I + spans.unicode(rf"\b(?:{V.RELATIVE})\b"), _I + spans.unicode(rf"\b(?:{V.RECURRING})\b")
    kinds = [("absolute", _DATE, lambda t: absolute_date(t, today)), ("relative", words[0], lambda t: relative_date(t, today)), ("recurring", words[1], lambda t: F.lit(None).cast("string"))]

    def read(kind: str, pattern: str, normal) -> Column:
        return F.transform(spans.matches(s, pattern), lambda m: F.struct(m["text"].alias("text"), F.lit(kind).alias("kind"), normal(m["text"]).alias("normalized"), m["start"].cast("int").alias("start"), m["end"].cast("int").alias("end")))

    # a pattern is searched only where a character or word is that it needs; these stand for others without case
    low = F.translate(s, phrases.UPPER + "\u017f\u212a\u0131\u0130", phrases.LOWER + "skii")
    maybe = F.array(F.struct(s.rlike(r"\p{Nd}").alias("absolute"), low.rlike(_RELATIVE_HINT).alias("relative"), low.rlike(_RECURRING_HINT).alias("recurring")))
    none = F.array().cast(f"array<{_TIME}>")
    only = lambda k: F.transform(maybe, lambda m: F.when(m[k[0]], read(*k)).otherwise(none))[0]
    parts = [only(k) for k in kinds]
    masked = None if found is None else F.filter(found, lambda e: e["label"].isin("MONEY", "PERCENT", "PHONE", "UPI", "URL"))
    return spans.resolved(F.concat(*parts), _TIME, masked)


def iso_date(text: Column, exif: bool = True) -> Column:
    """DATE of a source's date text: ISO, day-month-year, month-day-year, year-month or year at its start.

    ``exif``: dates written 2020:05:17 are read as such; without it they are January 1 of their year.
    """
    t = F.replace(F.trim(text), F.lit("/"), F.lit("-"))
    if exif:
        t = F.regexp_replace(t, r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3")
    head = F.substring(t, 1, 10)
    tries = [F.try_to_date(F.when(head.rlike(p), head), f) for p, f in ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"))]
    month = F.try_to_date(F.regexp_extract(t, r"^(\d{4}-\d{1,2})(?:$|[^\d-])", 1), "yyyy-M")
    year = F.try_to_date(F.concat(F.regexp_extract(t, r"^(\d{4})", 1), F.lit("-01-01")), "yyyy-MM-dd")
    return F.coalesce(*tries, month, year)


def result_date(text: Column) -> Column:
    """DATE in free text: ISO, ``5 May 2020`` or ``May 5, 2020``."""
    day = F.try_to_date(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    a = F.concat_ws(" ", F.regexp_extract(text, r"(\d{1,2}) ([A-Z][a-z]{2})[a-z]*\.? (\d{4})", 1), F.regexp_extract(text, r"(\d{1,2}) ([A-Z][a-z]{2})[a-z]*\.? (\d{4})", 2), F.regexp_extract(text, r"(\d{1,2}) ([A-Z][a-z]{2})[a-z]*\.? (\d{4})", 3))
    b = F.concat_ws(" ", F.regexp_extract(text, r"([A-Z][a-z]{2})[a-z]*\.? (\d{1,2}), (\d{4})", 2), F.regexp_extract(text, r"([A-Z][a-z]{2})[a-z]*\.? (\d{1,2}), (\d{4})", 1), F.regexp_extract(text, r"([A-Z][a-z]{2})[a-z]*\.? (\d{1,2}), (\d{4})", 3))
    return F.coalesce(day, F.try_to_date(a, "d MMM yyyy"), F.try_to_date(b, "d MMM yyyy"))
