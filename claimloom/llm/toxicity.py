"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import frames
from claimloom.llm.frames import Memo, crc_remainder, map_slices, word_list

#: The classifier is fitted on at most so many labelled documents of each class (the first by a hash of the id).
TOXIC_ROWS, CLEAN_ROWS = 700, 1400
#: Lengths of character n-grams, within words marked at both ends; n-grams of fewer documents are left out.
LENGTHS, LEAST_DOCUMENTS = (3, 4, 5), 3
#: Of a longer word the n-grams are read in pieces, by where they begin.
LONGEST = 64
#: What the toxic rows of the sample weigh in all, however many there are, so that scores are alike at every size.
TOXIC_SHARE = 1 / 3
#: Slots in which n-grams are counted before any is held by name; n-grams of fewer documents than asked for are left out.
SLOTS = 1 << 22
#: Words whose sums a task holds twice over (see ``Memo``).
WORDS_HELD = 250_000
#: Documents that a step of the fit takes at a time (all are taken in each step).
ROWS_AT_ONCE = 128


def pieces(word: bytes) -> list[tuple[str, int]]:
    """A word between border marks in pieces: the characters, and from how many of them n-grams begin."""
    text = f"<{word.decode('utf-8', 'replace')}>"
    if len(text) <= LONGEST:
        return [(text, len(text))]
    return [(text[at : at + LONGEST + max(LENGTHS) - 1], LONGEST) for at in range(0, len(text), LONGEST)]


def grams(word: bytes) -> Iterator[set[str]]:
    """The n-grams of a word, in sets of bounded size."""
    for part, starts in pieces(word):
        yield {part[k : k + n] for n in LENGTHS for k in range(min(starts, len(part) - n + 1))}


@dataclass
class Model:
    """A document's score: the sum of its different words' ``gain`` over the root of the sum of their ``norm``, plus bias."""

    index: dict[str, int]
    ratio: np.ndarray
    weight: np.ndarray
    bias: float

    def scorer(self):
        number, gain, norm = self.index.get, (self.ratio * self.weight).tolist(), (self.ratio**2).tolist()

        def of(word: bytes) -> tuple[float, float]:
            found: set[int] = set()
            for part, starts in pieces(word):
                for k in range(min(starts, len(part) - LENGTHS[0] + 1)):
                    for n in LENGTHS:  # a longer one is in no more documents; what the end cuts off is found again
                        if (at := number(part[k : k + n])) is None:
                            break
                        found.add(at)
            return sum(map(gain.__getitem__, found)), sum(map(norm.__getitem__, found))

        memo = Memo(of, limit=WORDS_HELD)

        def score(text: bytes | None) -> float:
            total = size = 0.0
            for a, b in map(memo.__getitem__, sorted(set(word_list(text)))):
                total += a
                size += b
            z = self.bias + (total / size**0.5 if size > 0 else 0.0)
            return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))

        return score


def fit(documents: Iterable[list[bytes]], labels: list[int], steps: int = 60, decay: float = 1e-4) -> Model:
    """Log-count ratios from the documents' different words, then logistic regression (Adam, full batches) on scaled counts.

    The toxic rows weigh ``TOXIC_SHARE`` in all. N-grams are first counted in slots; only those whose slot reached
    ``LEAST_DOCUMENTS`` are held by name and counted exactly.
    """
    y = np.array(labels, float)
    number: dict[bytes, int] = {}
    rows = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)) for words in documents]
    slots = [np.unique(np.fromiter((zlib.crc32(g.encode()) & (SLOTS - 1) for some in grams(w) for g in some), np.uint32)) for w in number]
    often = np.zeros(SLOTS, np.uint16)
    none = [np.empty(0, np.uint32)]
    for words in rows:
        often[np.unique(np.concatenate(none + [slots[w] for w in words]))] += 1
    del slots
    seen: dict[str, int] = {}
    of_word = []
    for w in number:
        found: set[int] = set()
        for some in grams(w):
            found.update(seen.setdefault(g, len(seen)) for g in sorted(some) if often[zlib.crc32(g.encode()) & (SLOTS - 1)] >= LEAST_DOCUMENTS)
        of_word.append(np.fromiter(found, np.int32, len(found)))
    cols, counts, none = [], [], [np.empty(0, np.int32)]
    for words in rows:
        c, n = np.unique(np.concatenate(none + [of_word[w] for w in words]), return_counts=True)
        cols.append(c)
        counts.append(n.astype(np.float32))
    del number, of_word
    ends = np.cumsum([0] + [len(c) for c in cols])
    col = np.concatenate([np.empty(0, np.int32)] + cols)
    del cols
    held = np.bincount(col, minlength=len(seen)) >= LEAST_DOCUMENTS
    renamed = np.cumsum(held, dtype=np.int32) - 1
    index = {g: int(renamed[k]) for g, k in seen.items() if held[k]}
    keep = held[col]
    ends = np.append(0, np.cumsum(keep))[ends]
    col, x = renamed[col[keep]], np.concatenate([np.empty(0, np.float32)] + counts)[keep]
    del seen, counts, keep
    n, width = len(y), len(index)
    share = np.where(y > 0, TOXIC_SHARE / max(1.0, y.sum()), (1 - TOXIC_SHARE) / max(1.0, n - y.sum()))
    # documents are taken a few at a time: start and end, their columns, and the row of each of these within the part
    parts = [(k, min(n, k + ROWS_AT_ONCE)) for k in range(0, n, ROWS_AT_ONCE)]
    parts = [(a, b, slice(ends[a], ends[b]), np.repeat(np.arange(b - a, dtype=np.int16), np.diff(ends[a : b + 1]))) for a, b in parts]
    pos, neg = np.ones(width), np.ones(width)
    for a, _, at, row in parts:
        toxic = y[a:][row] > 0
        pos += np.bincount(col[at][toxic], minlength=width)
        neg += np.bincount(col[at][~toxic], minlength=width)
    ratio = np.log(pos / (y.sum() + 2)) - np.log(neg / (n - y.sum() + 2))
    for a, b, at, row in parts:
        r = ratio[col[at]]
        norm = np.bincount(row, weights=x[at] * r**2, minlength=b - a)
        x[at] *= r / np.sqrt(np.maximum(norm, 1e-12))[row]
    w, bias = np.zeros(width), 0.0
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        g = np.append(decay * w, 0.0)
        for a, b, at, row in parts:
            z = np.bincount(row, weights=x[at] * w[col[at]], minlength=b - a) + bias
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[a:b]) * share[a:b]
            g[:-1] += np.bincount(col[at], weights=x[at] * e[row], minlength=width)
            g[-1] += e.sum()
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = 0.05 * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model(index, ratio, w, float(bias))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: int = 0, folds: int = 5) -> Model:
    """A model from labelled rows whose crc32 remainder is not ``fold``. Ids labelled more than once count as toxic if one label says so; null labels don't count. Without rows of both classes the model knows one answer."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_remainder(id_col, folds) != fold))
    marked = marked.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    ids = [marked.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(k) for y, k in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    sample = df.sparkSession.createDataFrame([r for x in ids for r in x.collect()], "__id long, __y int")

    def make():
        return lambda columns: ((doc, y, b"\n".join(sorted(set(word_list(text))))) for doc, y, text in zip(*columns))

    rows = df.select(F.col(id_col), F.col(text_col).cast("binary").alias("__t")).join(F.broadcast(sample), F.col(id_col) == F.col("__id")).select("__id", "__y", "__t")
    held = sorted((r["id"], r["y"], bytes(r["words"])) for r in map_slices(rows, make, "id long, y int, words binary").collect())
    y = [r[1] for r in held]
    frames.rest(df.sparkSession)  # fitting takes more than all before
    if len(set(y)) < 2:
        return Model({}, np.empty(0), np.empty(0), {0: -30.0, 1: 30.0, None: -30.0}[y[0] if y else None])
    return fit((r[2].split() for r in held), y)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", fold: int = 0, folds: int = 5, carry: list[str] | None = None) -> DataFrame:
    """id, held_out, score (0 to 1) and predicted (1 from 0.5) of each row's whole text, then the columns of ``carry``.

    Null and empty texts get the score of no words; repeated rows and null ids stay. Other columns are left out and
    no input. Nothing is shuffled; the model's size is bound by the sample it was fitted on.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        scored = held.value.scorer()

        def step(columns):
            for doc, out, text, *rest in zip(*columns):
                s = scored(text)
                yield doc, out, s, int(s >= 0.5), *rest

        return step

    rows = df.select(F.col(id_col), (crc_remainder(id_col, folds) == fold).alias("__h"), F.col(text_col).cast("binary").alias("__t"), *[F.col(c).alias(f"__c_{c}") for c in carry or []])
    kinds = "".join(f", `__c_{c}` {df.schema[c].dataType.simpleString()}" for c in carry or [])
    out = map_slices(rows, make, f"__id {df.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int{kinds}")
    return out.select(F.col("__id").alias(id_col), "held_out", "score", "predicted", *[F.col(f"__c_{c}").alias(c) for c in carry or [] if c != id_col])
