"""Which filter removes what in which order: every order of the filters run as a path of one trie of survivor tables."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.components import checkpoint_folder

SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A text that more than one in so many rows have is joined from a broadcast table, which so has fewer rows than this.
HEAVY = 1000


def text_filters(text: Column) -> Column:
    """struct<A, B, C, D>: true where a text fails. Null is empty: that fails A alone."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return F.transform(
        F.array(words),
        lambda w: F.struct(
            (F.size(w) < 200).alias("A"), (100 * F.size(F.array_distinct(w)) < 50 * F.size(w)).alias("B"), (100 * capitals.cast("long") > 2 * F.length(text)).alias("C"), text.rlike(r"[#$%&*|]").alias("D"),
        ),
    )[0]


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of each row of ``docs``.

    A: fewer than 200 words; B: fewer than half of the words distinct; C: over 2 in 100 characters are capitals; D: has
    one of ``#$%&*|``; E: some smaller id has the same text, whatever becomes of that row. Null texts are empty, a null
    part is the empty string. Null ids come after all others and have no labels; rows of one id are no copies of each
    other. An id with several labels is good, or toxic, if one of them says so.

    Texts are compared by SHA-256. Texts that over a thousandth of all rows have are joined from a broadcast table of
    fewer than a thousand rows, the others by a shuffle in which none is frequent.
    """
    checkpoint_folder(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("h"), text_filters(text).alias("x"))
    rows = rows.select("id", "part", "h", "x.*").checkpoint()
    total = rows.count()
    firsts = rows.groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    heavy = firsts.where(F.col("n") * HEAVY > total).select(F.col("h").alias("heavy_h"), F.col("first").alias("heavy_first"))
    light = firsts.where(F.col("n") * HEAVY <= total).select(F.col("h").alias("key"), F.col("first").alias("light_first"))
    rows = rows.join(F.broadcast(heavy), F.col("h") == F.col("heavy_h"), "left")
    apart = F.concat("h", F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"), F.lit("!").cast("binary"))  # longer than any key
    rows = rows.withColumn("key", F.when(F.col("heavy_first").isNull(), F.col("h")).otherwise(apart)).join(light, "key", "left")
    first = F.coalesce("heavy_first", "light_first")
    copy = first.isNotNull() & (F.col("id").isNull() | (F.col("id") > first))
    yes = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("label_id")).agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    label_id = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("\0"), F.hex("h")))  # null ids meet no label, and not in one task
    rows = rows.withColumns({"E": F.coalesce(copy, F.lit(False)), "label_id": label_id}).join(known, "label_id", "left")
    return rows.select("part", "A", "B", "C", "D", "E", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]).checkpoint()


def _edges(alive: DataFrame, state: frozenset[str], rest: list[str], lost: list[str]) -> DataFrame:
    """(part, state, filter, alive, removed, <lost>_lost) for each filter that may come next; summed before and after the shuffle."""
    cells = [F.struct(F.lit(f).alias("filter"), F.count_if(F.col(f)).alias("removed"), *[F.count_if(F.col(f) & F.col(x)).alias(f"{x}_lost") for x in lost]) for f in rest]
    out = alive.groupBy("part").agg(F.count("*").alias("alive"), F.array(*cells).alias("cells"))
    return out.select("part", F.lit("".join(sorted(state))).alias("state"), "alive", F.inline("cells"))


def trie(rows: DataFrame, filters: list[str], lost: list[str]) -> tuple[DataFrame, dict]:
    """The counts at every edge of the trie, and how many survivor tables each unordered state was made into (one).

    Depth first: the rows that survive a state are persisted, counted once for all filters that may follow, and then
    filtered into each following state that no other order has reached before; so at most one table a level is held.
    Counts are checkpointed, a row for each part and edge, so that what reads them all knows nothing of the tables.
    """
    checkpoint_folder(rows)
    seen: dict[frozenset[str], int] = {}
    counted: list[DataFrame] = []

    def visit(alive: DataFrame, state: frozenset[str]) -> None:
        alive = alive.persist(StorageLevel.MEMORY_AND_DISK)
        rest = [f for f in filters if f not in state]
        counted.append(_edges(alive, state, rest, lost).checkpoint())
        seen[state] = seen.get(state, 0) + 1
        for f in rest:
            after = state | {f}
            if after not in seen and len(after) < len(filters):
                visit(alive.where(~F.col(f)), after)
        alive.unpersist()

    visit(rows, frozenset())
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out, seen


def audit(rows: DataFrame, filters: str = "ABCDE", lost: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <lost>_lost, shapley): one row per part, order of the filters and step.

    ``rows`` has ``part``, a boolean column for each filter (a letter; true fails, null passes) and one for each of
    ``lost``. kept and removed are counted where the trie's path takes the step; redundant fail the step's filter but
    went earlier, unique_fails fail no other filter, shapley sums the filter's removals over all orders. Parts without
    survivors have zeros; a table without rows has none. Other columns play no part.

    A part has one group of one count for each edge (80 for five filters), into which all its steps look.
    """
    letters, n, lost = list(filters), len(filters), list(lost)
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in (*letters, *lost)]
    edges, _ = trie(rows.select(F.coalesce("part", F.lit("")).alias("part"), *flags), letters, lost)
    through = F.lit(0).cast("long")  # orders that take an edge: those of what is before it, times those of what is after
    for k in range(n):
        through = F.when(F.length("state") == k, factorial(k) * factorial(n - 1 - k)).otherwise(through)
    cell = F.struct(F.concat("state", F.lit(">"), "filter"), F.struct("alive", "removed", *[f"{x}_lost" for x in lost]))
    sums = [F.coalesce(F.sum(F.when(F.col("filter") == f, F.col("removed") * through)), F.lit(0)) for f in letters]
    parts = edges.groupBy("part").agg(F.map_from_entries(F.collect_list(cell)).alias("edges"), F.map_from_arrays(F.array(*[F.lit(f) for f in letters]), F.array(*sums)).alias("shapley"))
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(letters))), ",")
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    sort = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    own = F.substr("filter_order", F.col("step"), F.lit(1))
    steps = steps.withColumns({"own": own, "before": F.when(F.col("step") > 1, sort(F.substr(F.col("filter_order"), F.lit(1), F.col("step") - 1))).otherwise(""), "others": sort(F.replace(F.lit(filters), own, F.lit("")))})
    at = lambda state, field: F.coalesce(F.element_at("edges", F.concat(state, F.lit(">"), F.col("own")))[field], F.lit(0))
    before, removed = F.col("before"), at(F.col("before"), "removed")
    return steps.select(
        "part", "filter_order", "step", (at(before, "alive") - removed).alias("kept"), removed.alias("removed"), (at(F.lit(""), "removed") - removed).alias("redundant"), at(F.col("others"), "removed").alias("unique_fails"),
        *[at(before, f"{x}_lost").alias(f"{x}_lost") for x in lost], F.element_at("shapley", F.col("own")).alias("shapley"),
    )
