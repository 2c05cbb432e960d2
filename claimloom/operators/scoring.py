"""Scores of text pairs by a model: distinct pairs, batches of like length, a model loaded once a worker."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A model: premises and hypotheses to one row of label probabilities each, in order.
Scorer = Callable[[list[str], list[str]], Sequence[Sequence[float]]]
LABELS = ("supports", "neutral", "refutes")
#: Pairs, and characters, that a task holds to sort by length before it packs batches.
HELD_PAIRS, HELD_CHARS = 4096, 1 << 23

_LOADED: dict[str, Scorer] = {}


def loaded(name: str, load: Callable[[], Scorer]) -> Scorer:
    """The model of this name, loaded if this worker has not yet."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def packed(sizes: list[int], batch: int) -> list[list[int]]:
    """Places of pairs in batches: longest first, so that those of a batch are alike and the largest batch fails first."""
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    return [order[k : k + batch] for k in range(0, len(order), batch)]


def _scores(scorer: Scorer, premises: list[str], hypotheses: list[str], n: int) -> tuple[list[list[float] | None], str | None]:
    """The rows of a batch, or for each pair alone if the batch fails; what fails alone has none."""
    try:
        got = [[float(x) for x in row] for row in scorer(premises, hypotheses)]
        if len(got) != len(premises):
            raise ValueError("a short batch")
        if any(len(row) != n or not all(map(math.isfinite, row)) for row in got):
            raise ValueError(f"a row is not {n} finite numbers")
        return got, None
    except Exception as error:  # a model that fails leaves its pairs unscored
        return [None] * len(premises), f"{type(error).__name__}: {error}"[:300]


def score_pairs(pairs: DataFrame, load: Callable[[], Scorer], name: str, keys: list[str], premise: str = "premise", hypothesis: str = "hypothesis", batch: int = 8, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """The rows of ``pairs`` (keys, premise, hypothesis) with ``scores`` map<label, probability> and ``error``.

    Equal pairs are scored once, however often they occur, and the scores meet them again by digest. A task holds some
    thousand pairs, sorts them by length and gives the model ``batch`` at a time. A batch that raises, comes back
    short, or has numbers that are not finite is tried pair by pair; a pair that fails then has null scores and the
    error. Pairs with a null or blank text are not scored and have no error. ``name`` tells models apart: each worker
    loads a name once; a model that cannot be loaded is every pair's error.
    """
    key = F.sha2(F.concat(F.coalesce(premise, F.lit("")), F.lit("\x1f"), F.coalesce(hypothesis, F.lit(""))), 256)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    rows = pairs.withColumn("__key", F.when(~blank(premise) & ~blank(hypothesis), key))
    distinct = rows.where("__key IS NOT NULL").groupBy("__key").agg(F.min(premise).alias("p"), F.min(hypothesis).alias("h"))
    n = len(labels)

    def flush(held: list[tuple[str, str, str]]) -> tuple[list, list, list]:
        out_keys, out_scores, out_errors = [], [], []
        try:
            scorer = loaded(name, load)
        except Exception as error:  # the model is not there
            return [k for k, _, _ in held], [None] * len(held), [f"{type(error).__name__}: {error}"[:300]] * len(held)
        for places in packed([len(p) + len(h) for _, p, h in held], batch):
            part = [held[k] for k in places]
            got, error = _scores(scorer, [p for _, p, _ in part], [h for _, _, h in part], n)
            errors: list[str | None] = [None] * len(part)
            if error is not None:
                for k, (_, p, h) in enumerate(part):
                    (got[k],), errors[k] = _scores(scorer, [p], [h], n)
            out_keys += [k for k, _, _ in part]
            out_scores += got
            out_errors += errors
        return out_keys, out_scores, out_errors

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, chars = [], 0

        def table() -> pa.RecordBatch:
            k, s, e = flush(held)
            return pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(s, pa.list_(pa.float64())), pa.array(e, pa.string())], names=["__key", "values", "error"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held.append(row)
                chars += len(row[1]) + len(row[2])
                if len(held) >= HELD_PAIRS or chars >= HELD_CHARS:
                    yield table()
                    held, chars = [], 0
        if held:
            yield table()

    scored = distinct.mapInArrow(run, "__key string, values array<double>, error string")
    names = F.array(*[F.lit(x) for x in labels])
    # rows without a key keep none: they are spread by their own keys, not sent to one task
    spread = F.coalesce("__key", F.concat(F.lit("-"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys])))
    met = rows.withColumn("__key", spread).join(scored, "__key", "left").drop("__key")
    return met.withColumn("scores", F.when(F.col("values").isNotNull(), F.map_from_arrays(names, "values"))).drop("values")


def votes(scored: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``stance`` and ``score``: the likeliest label (the first of equal ones) and its probability to four places; null where a pair has no scores."""
    top = F.greatest(*[F.col("scores")[x] for x in labels])
    stance = F
    for x in labels:
        stance = stance.when(F.col("scores")[x] == top, x)
    return scored.withColumns({"stance": F.when(F.col("scores").isNotNull(), stance), "score": F.when(F.col("scores").isNotNull(), F.round(top, 4))})


def word_overlap() -> Scorer:
    """The scorer where no model is given: of all words of both texts, those of both speak for, those of the hypothesis alone against."""
    import re

    words = lambda t: set(re.findall(r"[a-z]+", t.lower()))

    def score(premises: list[str], hypotheses: list[str]) -> list[tuple[float, float, float]]:
        out = []
        for p, h in zip(premises, hypotheses):
            a, b = words(p), words(h)
            n = max(1, len(a | b))
            out.append((len(a & b) / n, len(a - b) / n, len(b - a) / n))
        return out

    return score
