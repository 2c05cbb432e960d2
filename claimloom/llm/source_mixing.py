"""Mixing sources to target weights by capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word, for sizes.
WORD = r"[^\x20\x09-\x0D]+"
#: Parts of the seeded order in which each source's documents are summed before the exact place is looked up in one part.
ORDER_PARTS = 4096


def fill(sizes: dict, weights: dict, epochs: int = 3) -> dict:
    """Targets that share the sum of all sizes by weight, none above ``epochs`` times its size.

    What a source at its limit leaves goes to the others by weight, again and again until none is above. Exact
    fractions. If all sources reach their limits, the rest of the total stays unused.
    """
    room = {s: Fraction(epochs * n) for s, n in sizes.items()}
    rest, open_, out = Fraction(sum(sizes.values())), {s: Fraction(weights[s]) for s in sizes}, {}
    while open_:
        per = rest / sum(open_.values())
        over = [s for s, w in open_.items() if w * per > room[s]]
        if not over:
            return out | {s: w * per for s, w in open_.items()}
        for s in over:
            out[s] = room[s]
            rest -= room[s]
            del open_[s]
    return out


def cycle_weights(sources: list, pattern: tuple[int, ...] = (5, 2, 1)) -> dict:
    """The pattern's weights in turn for the sources by code point, null last."""
    return {s: pattern[k % len(pattern)] for k, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict | None = None, pattern: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: int = 17, carry: list[str] | None = None) -> DataFrame:
    """id, source, size, source_size, target, taken, text of each row, then the columns of ``carry``; ``taken`` are the words the mix takes of it.

    Size is the number of words, 0 for null and empty texts. Every row of a source is taken whole as often as its
    target holds the source. Then rows follow in a seeded order once more while they fit into what is left; the one
    that crosses the target is taken in part. So a source's taken words are its target, rounded down. Rows of the
    same id and text have the same place in the order and share a part evenly (rounded down). Null ids and sources
    are values like others (null sorts last). Empty tables and sources without words take nothing.

    Per-source sums reach the driver, one row a source: sources are named in a configuration and so few. Everything
    else stays distributed: the order is summed in ``ORDER_PARTS`` parts a source with map-side sums, so a source
    with a third of all rows is no single task's, and only the part that crosses the target is looked at by row.
    """
    place = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))
    rows = df.select(F.col(id_col), F.col(text_col).alias("__text"), F.col(source_col).cast("string").alias("__source"), words(text_col).alias("size"), place.alias("__u"), *[F.col(c).alias(f"__c_{c}") for c in carry or []])
    part = F.pmod(F.shiftrightunsigned("__u", 40), F.lit(ORDER_PARTS)).cast("int")
    at = rows.select("__source", "size", "__u", part.alias("__part"))
    parts = at.groupBy("__source", "__part").agg(F.sum("size").alias("n"))
    running = Window.partitionBy("__source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0))).persist()
    spark = df.sparkSession
    sizes = {r["__source"]: r["n"] for r in parts.groupBy("__source").agg(F.sum("n").alias("n")).collect()}
    targets = fill(sizes, weights or cycle_weights(list(sizes), pattern), epochs) if sizes else {}
    whole = {s: int(targets[s] // n) if n else 0 for s, n in sizes.items()}
    left = {s: int(targets[s]) - whole[s] * n for s, n in sizes.items()}
    lefts = F.broadcast(spark.createDataFrame(list(left.items()), "__s string, __rest long"))  # one row a source
    cells = parts.join(lefts, F.col("__source").eqNullSafe(F.col("__s"))).where((F.col("before") <= F.col("__rest")) & (F.col("__rest") < F.col("before") + F.col("n")))
    cell = {r["__s"]: (r["__part"], r["__rest"] - r["before"]) for r in cells.collect()}
    parts.unpersist()
    plan = [(s, n, float(targets[s]), whole[s], *cell.get(s, (ORDER_PARTS, 0))) for s, n in sizes.items()]
    plan_df = spark.createDataFrame(plan, "__s string, source_size long, target double, __whole long, __at int, __left long")
    small = F.broadcast(plan_df)  # one row a source
    crossing = at.join(small, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__part") == F.col("__at")))
    ties = crossing.groupBy("__s", "__u", "__left").agg(F.sum("size").alias("n"), F.count("*").alias("k"))
    order = Window.partitionBy("__s").orderBy("__u").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    ties = ties.where((F.col("before") <= F.col("__left")) & (F.col("__left") < F.col("before") + F.col("n")))
    edge = {r["__s"]: (r["__u"], (r["__left"] - r["before"]) // r["k"]) for r in ties.collect()}
    full = [(*p[:5], *edge.get(p[0], (None, 0))) for p in plan]
    plan_df = spark.createDataFrame(full, "__s string, source_size long, target double, __whole long, __at int, __edge long, __some long")
    out = rows.withColumn("__part", part).join(F.broadcast(plan_df), F.col("__source").eqNullSafe(F.col("__s")))
    first = (F.col("__part") < F.col("__at")) & (F.col("__at") < ORDER_PARTS)
    extra = F.when(first | ((F.col("__part") == F.col("__at")) & (F.col("__u") < F.col("__edge"))), F.col("size")).when((F.col("__part") == F.col("__at")) & (F.col("__u") == F.col("__edge")), F.col("__some")).otherwise(F.lit(0))
    return out.select(F.col(id_col), F.col("__source").alias("source"), "size", "source_size", "target", (F.col("__whole") * F.col("size") + extra).cast("long").alias("taken"), F.col("__text").alias("text"), *[F.col(f"__c_{c}").alias(c) for c in carry or []])


def repeat(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix written out: a row for each whole repetition, and one with a text's first words for the rest of ``taken``."""
    size, taken = F.col("size"), F.col("taken")
    rest = F.when(size > 0, taken % size).otherwise(F.lit(0))
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(F.lit(0)).cast("int")
    counts = F.when(whole > 0, F.array_repeat(F.lit(-1).cast("long"), whole)).otherwise(F.array().cast("array<bigint>"))
    with_rest = F.concat(counts, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    rows = mixed.withColumn("__take", F.explode(with_rest))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), 1, F.greatest(F.col("__take"), F.lit(1)).cast("int")), " ")
    return rows.withColumn(text_col, F.when(F.col("__take") < 0, F.col(text_col)).otherwise(head)).drop("__take")
