"""What the operators of this subpackage share: bounded Arrow slices and word rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Python holds as objects at a time, whatever the Arrow batch has.
SLICE_ROWS = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_slices(df: DataFrame, make: Callable[[], Callable[[list], Iterable[tuple]]], schema: str) -> DataFrame:
    """Each slice of rows (one list per column) through a function made once per task; its tuples are rows of ``schema``.

    ``make`` may return an object with ``finish()``, whose tuples follow after the last slice.
    """
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                yield from _pack(step([c.to_pylist() for c in part.columns]), target)
        if finish := getattr(step, "finish", None):
            yield from _pack(finish(), target)
        del step, finish
        give_back()

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _pack(rows: Iterable[tuple], target: pa.Schema, at_once: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= at_once:
            yield _batch(held, target)
            held = []
    if held:
        yield _batch(held, target)


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), target)], schema=target)


def word_list(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: what bytes.lower and bytes.split do on UTF-8."""
    return text.lower().split() if text else []


def crc_remainder(id_col: str, divisor: int = 5) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def give_back() -> None:
    """What the worker no longer holds goes back to the system: the next task may be another operator's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def rest(spark: SparkSession) -> None:
    """What steps that are done had on the driver goes: their models and plans, and with them their broadcasts and shuffles.

    The driver's heap shrinks to a multiple of what is still in use. Between steps that plan much it would else grow on
    what the last ones left.
    """
    gc.collect()
    spark._jvm.System.gc()
    give_back()


class Memo(dict):
    """A dict that computes what it lacks. Beyond ``limit`` entries it forgets those that it was not asked for since the last time it was full."""

    def __init__(self, compute: Callable, limit: int = 300_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest, self.before = compute, limit, longest, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.before = {}
