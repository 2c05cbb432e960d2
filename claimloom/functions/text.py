"""Text functions: cleaning, sentences, terms, passages, languages and spellings, all as Catalyst expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import hindi
from claimloom.functions import vocab as V

#: A character of a word.
W = r"\p{L}\p{N}_"
#: What the patterns' ``\s`` is.
SPACE = " \t\n\x0b\f\r"


def whole(alternatives: str) -> str:
    """A pattern for any of the alternatives between word borders, without case and without look-around."""
    return f"(?i)(?:^|[^{W}])(?:{alternatives})(?:$|[^{W}])"


def leading(alternatives: str) -> str:
    return rf"(?i)^\s*(?:{alternatives})(?:$|[^{W}])"


def by_first_letter(words: str) -> str:
    """The same alternatives, those of one first letter together."""
    tails: dict[str, list[str]] = {}
    for w in words.split("|"):
        tails.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(t)})" for c, t in tails.items())


def clean(text: Column) -> Column:
    """CR to LF, blanks and tabs squeezed, trimmed; null becomes empty."""
    t = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("\n")), r"[ \t]{2,}|\t", " ")
    return F.trim(t, F.lit(SPACE))


#: What ends in a long look-behind begins with short looks, as it is tried at every character.
_HELD = rf"(?i)(?=\s)(?<=\.)(?<=(?:^|[^{W}])(?:{V.ABBREVIATIONS})\.)\s+"


def sentences(text: Column) -> Column:
    """Sentences of a text: after ``.!?`` or danda and white space, or at line ends; an abbreviation holds on to what follows."""
    parts = F.split(F.regexp_replace(text, _HELD, "\u0001"), r"(?=\s)(?:(?<=[.!?।])\s+|\n+)", -1)
    tidy = F.transform(parts, lambda p: F.replace(F.trim(p, F.lit(SPACE)), F.lit("\u0001"), F.lit(" ")))
    return F.filter(tidy, lambda p: p != "")


def sentence_spans(text: Column) -> Column:
    """array<struct<text, start, end>>: sentences with their places (from 0) in the text; each is looked for after the one before."""
    found = sentences(text)
    return F.transform(F.arrays_zip(found.alias("text"), F.pandas_udf(_places, "array<struct<start:int,end:int>>")(text, found).alias("at")), lambda s: F.struct(s["text"].alias("text"), s["at"]["start"].alias("start"), s["at"]["end"].alias("end")))


def _places(texts: pd.Series, found: pd.Series) -> pd.Series:
    """Where each sentence stands: one pass over a text, in place of a copy of its rest for each sentence."""

    def of(text, sentences_):
        at, out = 0, []
        for s in sentences_:
            # white space inside may differ where an abbreviation was held, so only the first 20 characters are looked for
            start = max(text.find(s[:20], at), at)
            at = min(start + len(s), len(text))
            out.append({"start": start, "end": at})
        return out

    return pd.Series([None if t is None else of(t, s) for t, s in zip(texts, found)])


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s{2,}|[\t\n\x0b\f\r]", " "))


def tokens(text: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def n_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def normalize(text: Column) -> Column:
    """Lower case, what is no word character to blanks (combining marks too), squeezed."""
    return F.trim(F.regexp_replace(F.lower(text), rf"[^{W}]{{2,}}|[^{W} ]", " "))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalize(text), " "), lambda t: t != ""))


def overlap_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[{W}]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(V.OVERLAP_STOP.split())))


def _cut(w: Column, suffix: str, keep: int) -> Column:
    return w.endswith(suffix) & (F.length(w) - len(suffix) >= keep)


def _less(w: Column, n: int) -> Column:
    return F.substr(w, F.lit(1), F.length(w) - n)


def _singular(w: Column) -> Column:
    return F.when(_cut(w, "ies", 3), F.concat(_less(w, 3), F.lit("y"))).when(_cut(w, "sses", 3), _less(w, 2)).when(_cut(w, "s", 3) & ~w.endswith("ss"), _less(w, 1)).otherwise(w)


def _bare(w: Column) -> Column:
    return F.when(_cut(w, "ing", 4), _less(w, 3)).when(_cut(w, "ed", 4), _less(w, 2)).otherwise(w)


def _short(w: Column) -> Column:
    return F.when(_cut(w, "e", 4), _less(w, 1)).otherwise(w)


def stems(words: Column) -> Column:
    """Plural, then ing or ed, then a final e, each only where enough of the word is left. One pass a step keeps the expression small."""
    return F.transform(F.transform(F.transform(words, _singular), _bare), _short)


def stem(word: Column) -> Column:
    return stems(F.array(word))[0]


def content_terms(text: Column) -> Column:
    """Distinct stems of the words that are longer than one character and no stop word; Devanagari words keep their marks."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[ऀ-ॣ०-ॿ]+|[{W}]+"), F.lit(0))
    kept = F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(V.STOP.split()))
    return F.array_distinct(stems(kept))


def is_devanagari(text: Column) -> Column:
    return F.coalesce(text.rlike("[ऀ-ॿ]"), F.lit(False))


def hinglish_hits(text: Column) -> Column:
    """Hint words of a text."""
    return F.regexp_count(text, F.lit(rf"(?i)(?<![{W}])(?:{by_first_letter(V.HINGLISH)})(?![{W}])"))


def language(text: Column) -> Column:
    share = hinglish_hits(text).cast("double") / F.greatest(n_tokens(text), F.lit(1))
    return F.when(is_devanagari(text), "hi").when(share >= V.HINGLISH_SHARE, "hinglish").otherwise("en")


def fold_spelling(word: Column) -> Column:
    """One key for the spellings of a romanised word: runs of three, long vowels, doubles, then z, w and q."""
    w = F.regexp_replace(F.lower(word), r"(.)\1{2,}", "$1")
    for a, b in (("ee", "i"), ("oo", "u"), ("aa", "a"), ("ii", "i"), ("uu", "u")):
        w = F.replace(w, F.lit(a), F.lit(b))
    return F.translate(F.regexp_replace(w, r"(.)\1+", "$1"), "zwq", "jvk")


class Lexicon:
    """Romanised Hindi. ``native`` opens the gate, ``loan`` and the ambiguous words are only rewritten; all are {roman: Devanagari}."""

    def __init__(self, native: dict[str, str] | None = None, loan: dict[str, str] | None = None, ambiguous: dict[str, str] | None = None):
        ambiguous = V.AMBIGUOUS if ambiguous is None else ambiguous
        self.native = {self.fold(k): v for k, v in (native or {}).items()}
        self.all = {self.fold(k): v for k, v in (loan or {}).items()} | {self.fold(k): v for k, v in ambiguous.items()} | self.native
        self.roman: dict[str, str] = {}
        for k, v in self.all.items():
            self.roman.setdefault(v, k)

    @classmethod
    def hindi(cls) -> Lexicon:
        """The built-in words, spelled by rule (``hindi.by_rule``) but for listed exceptions."""
        return cls(hindi.table(V.HINDI_WORDS, V.HINDI_SPELLED), V.HINDI_LOANS)

    @classmethod
    def of_table(cls, words: DataFrame, version: int | None = None, most: int = 20_000) -> Lexicon:
        """A version (the latest, if none is named) of a table (roman, devanagari, kind native, loan or ambiguous, version).

        Its words become literals of every plan, so a version of more than ``most`` words is an error. Rows without a
        spelling are left out; of several spellings of one word the first by code point counts.
        """
        rows = words.where("roman IS NOT NULL AND devanagari IS NOT NULL")
        rows = rows.where(F.col("version") == version) if version is not None else rows.join(rows.agg(F.max("version").alias("version")), "version", "left_semi")
        found = rows.groupBy("kind", "roman").agg(F.min("devanagari").alias("devanagari")).orderBy("kind", "roman").limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"a lexicon of more than {most} words")
        of = lambda kind: {r["roman"]: r["devanagari"] for r in found if r["kind"] == kind}
        return cls(of("native"), of("loan"), of("ambiguous"))

    @staticmethod
    def fold(word: str) -> str:
        import re

        w = re.sub(r"(.)\1{2,}", r"\1", word.lower())
        for a, b in (("ee", "i"), ("oo", "u"), ("aa", "a"), ("ii", "i"), ("uu", "u")):
            w = w.replace(a, b)
        return re.sub(r"(.)\1+", r"\1", w).translate(str.maketrans("zwq", "jvk"))

    @staticmethod
    def _map(d: dict[str, str]) -> Column:
        pairs = [x for k, v in d.items() for x in (F.lit(k), F.lit(v))]
        return F.create_map(*pairs) if pairs else F.create_map(F.lit(""), F.lit(""))

    def hits(self, text: Column) -> Column:
        # what is no letter becomes blank, and then folding the text folds each of its words
        letters = F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z ]+", " ")
        words = F.filter(F.split(fold_spelling(letters), " "), lambda w: w != "")
        found = lambda ws: F.size(F.filter(ws, lambda w: w.isin(*self.native))) if self.native else F.lit(0)
        return F.transform(F.array(words), lambda ws: F.struct(found(ws).alias("hits"), F.size(ws).alias("words")))[0]

    def looks_romanised(self, text: Column) -> Column:
        if not self.native:  # nothing opens the gate
            return F.when(text.isNotNull(), F.lit(False))
        enough = lambda h: (h["hits"] >= V.HINDI_LEAST) & (h["hits"].cast("double") / F.greatest(h["words"], F.lit(1)) >= V.HINDI_SHARE)
        return ~is_devanagari(text) & F.transform(F.array(self.hits(text)), enough)[0]

    def script(self, text: Column) -> Column:
        return F.when(is_devanagari(text), "deva").when(self.looks_romanised(text), "hinglish").otherwise("latin")

    @staticmethod
    def _pieces(text: Column, letters: str) -> Column:
        """A text as words and what stands between them."""
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[{letters}]+|[^{letters}]+"), F.lit(0))

    def transliterate(self, text: Column) -> Column:
        """Every known romanised word in Devanagari; words in capitals and all others stay."""
        table = self._map(self.all)

        def one(w: Column) -> Column:
            capitals = (F.length(w) > 1) & w.rlike("^[A-Z]+$")
            known = w.rlike("^[A-Za-z]") & ~capitals & fold_spelling(w).isin(*self.all) if self.all else F.lit(False)  # the map is searched only for what it has
            return F.when(known, F.element_at(table, fold_spelling(w))).otherwise(w)

        return F.array_join(F.transform(self._pieces(text, "A-Za-z"), one), "")

    def devanagari(self, text: Column) -> Column:
        out = self.transliterate(text)
        return F.when(self.looks_romanised(text) & is_devanagari(out), out)

    def romanised(self, text: Column) -> Column:
        """Known Devanagari words in Latin letters; null where nothing is known."""
        table = self._map(self.roman)
        out = F.array_join(F.transform(self._pieces(text, "ऀ-ॣ०-ॿ"), lambda w: F.coalesce(F.element_at(table, w), w)), "")
        return F.when(is_devanagari(text) & (out != text), out)

    def variants(self, text: Column) -> Column:
        """The spellings to embed: the text, and its Devanagari."""
        t = F.trim(F.coalesce(text, F.lit("")))
        return F.when(t == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(t, self.devanagari(t))))

    def spellings(self, text: Column) -> Column:
        """The spellings to read: the text, and its Devanagari or else its romanisation."""
        t = F.trim(F.coalesce(text, F.lit("")))
        return F.when(t == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(t, F.coalesce(self.devanagari(t), self.romanised(t)))))


def without_addresses(text: Column) -> Column:
    return squeezed(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)https?://\S+|www\.\S+|\S+@\S+", " "))


def truncated(text: Column, limit: int) -> Column:
    """Cut at the last blank before the limit; with no blank, at the limit."""
    head = F.substring(text, 1, limit)
    at_word = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    return F.when(F.length(text) <= limit, text).when(F.contains(head, F.lit(" ")), at_word).otherwise(head)


def body(title: Column, snippet: Column, text: Column) -> Column:
    """Title, snippet and text by lines, without a part that a later part contains or that came before."""
    t, s, x = (F.coalesce(c, F.lit("")) for c in (title, snippet, text))
    keep_t = (t != "") & ~(F.contains(s, t) | F.contains(x, t))
    keep_s = (s != "") & ~F.contains(x, s)
    return F.concat_ws("\n", F.when(keep_t, t), F.when(keep_s, s), F.when(x != "", x))


def _split_long(sentence: Column, limit: int) -> Column:
    """A sentence beyond the limit in pieces of whole words, each as long as fits."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def step(acc: Column, w: Column) -> Column:
        full = (acc["now"] != "") & (F.length(acc["now"]) + 1 + F.length(w) > limit)
        now = F.when(full | (acc["now"] == ""), w).otherwise(F.concat(acc["now"], F.lit(" "), w))
        return F.struct(F.when(full, F.array_append(acc["out"], acc["now"])).otherwise(acc["out"]).alias("out"), now.alias("now"))

    def finish(acc: Column) -> Column:
        return F.when(acc["now"] != "", F.array_append(acc["out"], acc["now"])).otherwise(acc["out"])

    return F.when(F.length(sentence) <= limit, F.array(sentence)).otherwise(F.aggregate(tokens(sentence), empty, step, finish))


def passages(text: Column, size: int = 3, least: int = 2, limit: int = 800) -> Column:
    """Runs of ``size`` sentences; a last one below ``least`` takes the sentence before it."""
    parts = F.flatten(F.transform(sentences(clean(text)), lambda s: _split_long(s, limit)))
    return F.transform(F.array(parts), lambda p: _grouped(p, size, least))[0]


def _grouped(p: Column, size: int, least: int) -> Column:
    n = F.size(p)
    groups = F.ceil(n / size).cast("int")
    short = (n > size) & ((n % size) > 0) & ((n % size) < least)
    lack = F.when(short, least - n % size).otherwise(F.lit(0))

    def one(i: Column) -> Column:
        start = F.when(i == groups - 1, i * size - lack).otherwise(i * size)
        end = F.when(i == groups - 2, (i + 1) * size - lack).when(i == groups - 1, n).otherwise((i + 1) * size)
        return F.array_join(F.slice(p, start + 1, end - start), " ")

    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(groups - 1, F.lit(0))), one))


def rating_group(raw: Column, groups=V.RATING_GROUPS, other: str | None = "unknown") -> Column:
    """The first group that a pattern in the lower-cased rating belongs to."""
    t = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    out = F
    for name, patterns in groups:
        found = t.rlike(patterns)
        out = F.when(found, name) if out is F else out.when(found, name)
    return out.otherwise(F.lit(other))


def rating_stance(raw: Column) -> Column:
    return rating_group(raw, V.RATING_STANCES, None)


def at_most(text: Column, n: int | None) -> Column:
    """The first ``n`` characters, or all where no limit is given."""
    return text if n is None else F.substring(text, 1, n)


def stance_alias(stance: Column) -> Column:
    """supports, refutes or neutral; null is neutral, anything unknown is an error."""
    s = F.lower(F.trim(F.coalesce(stance, F.lit("neutral"))))
    return F.when(s.isin("support", "supports"), "supports").when(s.isin("refute", "refutes"), "refutes").when(s == "neutral", "neutral").otherwise(F.raise_error(F.concat(F.lit("unknown stance "), s)))


def html_text(html: Column) -> Column:
    """Visible text: without scripts, styles, navigation, comments and tags; a few entities resolved."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style|nav|head|footer)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n"), r"^\s+|\s+$", "")
