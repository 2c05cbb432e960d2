"""Asking many sources at once: each batch of queries and each source is a task's own work, and one that fails costs nothing else."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooLong

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from claimloom.sources.folders import checkpointing

#: What a source answers to a batch of queries: dicts with ``claim_id`` and any of these.
FOUND = "claim_id string, url string, title string, snippet string, text string, publisher string, domain string, published_date string, rating_raw string, score double, language string, item_id string, demo boolean"
_NAMES = [c.split()[0] for c in FOUND.split(", ")]
Service = Callable[[list[dict]], Iterable[dict]]
Table = Callable[[DataFrame, DataFrame], DataFrame]


def batch_of(key: Column, batches: int) -> Column:
    """Which batch a claim's queries are in: by its id's digest, so the same in every run."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % batches).cast("int")


def _answer(service: Service, asked: list[dict], tries: int, wait_s: float, limit_s: float | None) -> tuple[list[dict], int, str | None]:
    """What a source found, after how many tries, and the last error if none succeeded. A call beyond ``limit_s`` is given up."""
    error = None
    for k in range(1, tries + 1):
        try:
            if limit_s is None:
                return [dict(x) for x in service(asked)], k, None
            pool = ThreadPoolExecutor(1)
            try:
                return pool.submit(lambda: [dict(x) for x in service(asked)]).result(limit_s), k, None
            finally:
                pool.shutdown(wait=False, cancel_futures=True)
        except TooLong:
            error = f"no answer in {limit_s} s"
        except Exception as e:  # a source that fails contributes nothing
            error = f"{type(e).__name__}: {e}"[:300]
        if k < tries:
            time.sleep(wait_s * 2 ** (k - 1))
    return [], tries, error


def ask(queries: DataFrame, services: dict[str, Service], batch: int = 16, tries: int = 2, wait_s: float = 0.0, limit_s: float | None = None) -> DataFrame:
    """(source, batch, claim_ids, tries, error, found): one row for each source and batch of ``queries`` (claim_id, rank, text, and any others).

    A batch has about ``batch`` queries, with all of a claim's together, by its id's digest; it is one group, and one
    call. ``found`` are the source's candidates; with an error it is empty. The result is checkpointed, so no source is
    asked again when it is read twice.
    """
    spark = queries.sparkSession
    checkpointing(spark)
    batches = max(1, -(-queries.count() // batch))
    rows = queries.withColumn("batch", batch_of(F.col("claim_id"), batches))
    asked = rows.select("batch", F.struct(*queries.columns).alias("q"), F.explode(F.array(*[F.lit(n) for n in services])).alias("source"))
    schema = f"source string, batch int, claim_ids array<string>, tries int, error string, found array<struct<{FOUND.replace(' ', ':').replace(',:', ',')}>>"

    target = to_arrow_schema(StructType.fromDDL(schema))

    def one(table):
        import pyarrow as pa

        source, batch_, held = table["source"][0].as_py(), table["batch"][0].as_py(), sorted(table["q"].to_pylist(), key=lambda q: (str(q["claim_id"]), q.get("rank") or 0))
        for q in held:
            q["claim_id"] = str(q["claim_id"])
        found, k, error = _answer(services[source], held, tries, wait_s, limit_s)
        row = {"source": source, "batch": batch_, "claim_ids": sorted({q["claim_id"] for q in held}), "tries": k, "error": error, "found": [{n: x.get(n) for n in _NAMES} for x in found]}
        try:
            return pa.Table.from_pylist([row], target)
        except (pa.ArrowInvalid, pa.ArrowTypeError) as e:  # an answer of other types than FOUND is a failure of its source
            return pa.Table.from_pylist([row | {"error": f"{type(e).__name__}: {e}"[:300], "found": []}], target)

    return asked.groupBy("source", "batch").applyInArrow(one, schema).checkpoint()


def look_up(name: str, table: Table, claims: DataFrame, queries: DataFrame, tries: int = 2) -> tuple[DataFrame | None, int, str | None]:
    """What a source that is a plan finds, checkpointed, so that its failure ends here: after how many tries, and the last error."""
    checkpointing(queries.sparkSession)
    error = None
    for k in range(1, tries + 1):
        try:
            found = table(claims, queries)
            have = set(found.columns)
            kinds = dict(c.split() for c in FOUND.split(", "))
            out = found.select(F.lit(name).alias("source"), *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
            return out.checkpoint(), k, None
        except Exception as e:  # a plan that cannot be run contributes nothing
            error = f"{type(e).__name__}: {e}".split("\n")[0][:300]
    return None, tries, error


def collect(claims: DataFrame, queries: DataFrame, services: dict[str, Service] | None = None, tables: dict[str, Table] | None = None, batch: int = 16, tries: int = 2, wait_s: float = 0.0, limit_s: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, failures) of all sources.

    candidates: source, then the columns of FOUND. failures, the dead letters: source, batch (null where a whole table
    failed), claim_ids (null then), tries, error. A service that fails on one batch still answers the others.
    """
    spark = queries.sparkSession
    kinds = f"source string, {FOUND}"
    found, failed = spark.createDataFrame([], kinds), spark.createDataFrame([], "source string, batch int, claim_ids array<string>, tries int, error string")
    if services:
        got = ask(queries, services, batch, tries, wait_s, limit_s)
        found = found.unionByName(got.select("source", F.inline("found")).select(found.columns))
        failed = failed.unionByName(got.where("error IS NOT NULL").select(failed.columns))
    for name, table in (tables or {}).items():
        out, k, error = look_up(name, table, claims, queries, tries)
        if out is not None:
            found = found.unionByName(out.select(found.columns))
        else:
            failed = failed.unionByName(spark.createDataFrame([(name, None, None, k, error)], failed.schema))
    return found.where("claim_id IS NOT NULL"), failed


def again(failures: DataFrame, queries: DataFrame, services: dict[str, Service], **how) -> tuple[DataFrame, DataFrame]:
    """(candidates, failures) of asking once more only what failed: each service's failed claims."""
    found, failed = collect(queries, queries.limit(0), services, **how)
    lost = failures.where("claim_ids IS NOT NULL").select("source", F.explode("claim_ids").alias("__id")).distinct()
    for name, service in services.items():
        mine = queries.join(lost.where(F.col("source") == name), F.col("claim_id").cast("string") == F.col("__id"), "left_semi")
        a, b = collect(queries, mine, {name: service}, **how)
        found, failed = found.unionByName(a), failed.unionByName(b)
    return found, failed


def report(found: DataFrame, failed: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """source, candidates, claims with any, failed batches, claims lost; a source that found nothing and never failed has no row."""
    a = found.groupBy("source").agg(F.count("*").alias("candidates"), F.count_distinct("claim_id").alias("claims"))
    b = failed.groupBy("source").agg(F.count("*").alias("failures"), F.sum(F.coalesce(F.size("claim_ids"), F.lit(0))).alias("lost"))
    return a.join(b, "source", "full").fillna(0)
