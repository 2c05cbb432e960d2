"""Line dedup by sharded cuckoo filters backed by exact reference-count tables; insertions and deletions of documents are reversible."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.components import checkpoint_folder
from claimloom.llm.frames import map_slices

#: A key counts from this many code points on.
LEAST_CHARS = 10
#: Filters are broadcast up to this many bytes together; beyond that each line goes to the exact table unfiltered.
FILTER_BYTES = 32 << 20
SLOTS = 4
#: Repeated keys of a shard when an index is built.
SHARD_KEYS = 1 << 16
#: Keys of at least this many documents, and of at least this share of all references, have their owners sent to all
#: tasks: at most ``1 / HOT_SHARE`` keys. They are no task's own in the join with the exact counts.
HOT_REFS, HOT_SHARE = 1024, 2**-16


def line_key(line: bytes) -> bytes:
    """The line with ASCII white space stripped at both ends and A-Z lower-cased."""
    return line.strip().lower()


def key_hash(line: bytes) -> bytes | None:
    """16 bytes that stand for the key; None for one that is too short."""
    key = line_key(line)
    if len(key) < LEAST_CHARS or len(key) < 4 * LEAST_CHARS and len(key.decode("utf-8", "replace")) < LEAST_CHARS:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Sets of 16-byte hashes with deletion: 16-bit marks, four to a bucket; grows by further tables of twice the size.

    ``add`` must be told each key once; ``remove`` takes back what ``add`` put. ``in`` may be wrongly true (about 8 in
    65,536 for each table), never wrongly false.
    """

    def __init__(self, blob: bytes | None = None, capacity: int = 64):
        self.tables: list[list] = []  # [buckets, entries, marks]
        at = 0
        while blob and at < len(blob):
            buckets, entries = struct.unpack_from("<QQ", blob, at)
            size = buckets * SLOTS * 2
            self.tables.append([buckets, entries, memoryview(bytearray(blob[at + 16 : at + 16 + size])).cast("H")])
            at += 16 + size
        if not self.tables:
            self._grow(capacity)

    def _grow(self, capacity: int) -> None:
        buckets = 1
        while buckets * SLOTS * 0.9 < capacity:
            buckets *= 2
        self.tables.append([buckets, 0, memoryview(bytearray(buckets * SLOTS * 2)).cast("H")])

    def blob(self) -> bytes:
        return b"".join(struct.pack("<QQ", b, n) + m.tobytes() for b, n, m in self.tables)

    @staticmethod
    def _mark(key: bytes) -> tuple[int, int]:
        return int.from_bytes(key[8:10], "little") or 1, int.from_bytes(key[:8], "little")

    @staticmethod
    def _other(bucket: int, mark: int, buckets: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (buckets - 1)

    def __contains__(self, key: bytes) -> bool:
        mark, place = self._mark(key)
        for buckets, _, marks in self.tables:
            a = place & (buckets - 1)
            b = self._other(a, mark, buckets)
            if mark in marks[a * SLOTS : a * SLOTS + SLOTS].tolist() or mark in marks[b * SLOTS : b * SLOTS + SLOTS].tolist():
                return True
        return False

    def _put(self, table: list, bucket: int, mark: int) -> bool:
        marks = table[2]
        for k in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not marks[k]:
                marks[k] = mark
                table[1] += 1
                return True
        return False

    def add(self, key: bytes) -> None:
        mark, place = self._mark(key)
        table = self.tables[-1]
        if table[1] < table[0] * SLOTS * 0.9:
            bucket = place & (table[0] - 1)
            if self._put(table, bucket, mark) or self._put(table, self._other(bucket, mark, table[0]), mark):
                return
            moved = []
            for turn in range(200):  # make room by moving marks to their other buckets
                k = bucket * SLOTS + (mark + turn) % SLOTS
                moved.append((k, table[2][k]))
                mark, table[2][k] = table[2][k], mark
                bucket = self._other(bucket, mark, table[0])
                if self._put(table, bucket, mark):
                    return
            for k, old in reversed(moved):
                table[2][k] = old
        self._grow(2 * int(table[0] * SLOTS * 0.9))
        self.add(key)

    def remove(self, key: bytes) -> None:
        mark, place = self._mark(key)
        for table in self.tables:
            a = place & (table[0] - 1)
            for bucket in (a, self._other(a, mark, table[0])):
                for k in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                    if table[2][k] == mark:
                        table[2][k] = 0
                        table[1] -= 1
                        return
        raise KeyError(key)


@dataclass
class LineIndex:
    """refs: (key, id), one row for each key of each document. counts: (key, refs, owner, ...) exactly, owner the smallest id.
    filters: (shard, blob) of the keys that at least two documents hold. All three are kept in the shared folder."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int


def _kind(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def line_refs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id), each key once for each row; lines are split at \\n."""
    return _refs(df, id_col, text_col, None)


def _refs(df: DataFrame, id_col: str, text_col: str, known) -> DataFrame:
    """(key, id) as in ``line_refs``. known: a broadcast of filters by shard (or None), their number, and owners of hot
    keys; then (key, id, sure) of lines that the filters may hold, sure if the owner is known to be another document."""

    def make():
        filters, shards, hot = known.value if known is not None else (None, 0, {})
        held = {s: CuckooFilter(b) for s, b in filters.items()} if filters is not None else None

        def keys_of(text):
            return {h for line in (text or b"").split(b"\n") if (h := key_hash(line))}

        def plain(columns):
            return ((key, doc) for doc, text in zip(*columns) for key in keys_of(text))

        def step(columns):
            for doc, text in zip(*columns):
                for key in keys_of(text):
                    if (owner := hot.get(key)) is not None:
                        if owner != doc:
                            yield key, doc, True
                    elif held is None or (f := held.get(shard_of(key, shards))) is not None and key in f:
                        yield key, doc, False

        return plain if known is None else step

    return map_slices(df.select(F.col(id_col), F.col(text_col).cast("binary").alias("__t")), make, f"key binary, id {_kind(df, id_col)}" + ", sure boolean" * (known is not None))


def shard_of(key: bytes, shards: int) -> int:
    return int.from_bytes(key[10:15], "big") % shards


def _shard(shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("key", 11, 5)), 16, 10).cast("long"), F.lit(shards)).cast("int").alias("shard")


def _counted(refs: DataFrame) -> DataFrame:
    """Exact counts; partial sums meet, so a key that a third of all documents hold is a row a task. A null id counts as one more document, after all others."""
    return refs.groupBy("key").agg(F.count("id").alias("refs"), F.min("id").alias("owner"), F.max("id").alias("last"), F.max(F.col("id").isNull()).alias("of_null"))


def repeated() -> Column:
    """Of a row of counts: at least two documents hold the key (rows of one id are one document)."""
    return (F.col("owner") != F.col("last")) | (F.col("of_null") & F.col("owner").isNotNull())


def _updated(filters: DataFrame | None, changes: DataFrame, shards: int) -> DataFrame:
    """The shards' filters after changes (key, add): each shard in a task of its own. A filter of several tables cannot
    tell which holds a key, so where one is taken from such a filter, its blob is null and it must be made anew."""
    import pandas as pd

    def run(shard, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter(old["blob"].iloc[0] if len(old) else None, capacity=max(64, len(new)))
        gone = new.loc[~new["add"], "key"]
        if len(gone) and len(f.tables) > 1:
            return pd.DataFrame({"shard": [shard[0]], "blob": [None]})
        for key in gone:
            f.remove(key)
        for key in new.loc[new["add"], "key"]:
            f.add(key)
        return pd.DataFrame({"shard": [shard[0]], "blob": [f.blob()]})

    changes = changes.select("key", "add", _shard(shards))
    if filters is None:
        filters = changes.sparkSession.createDataFrame([], "shard int, blob binary")
    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(run, "shard int, blob binary")


def build(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> LineIndex:
    """An index of all lines of a table; ``shards`` is by the number of repeated keys."""
    checkpoint_folder(df)
    refs = line_refs(df, id_col, text_col).checkpoint()
    counts = _counted(refs).checkpoint()
    many = counts.where(repeated()).select("key", F.lit(True).alias("add"))
    shards = shards or -(-many.count() // SHARD_KEYS) or 1
    return LineIndex(refs, counts, _updated(None, many, shards).checkpoint(), shards)


def _changed(index: LineIndex, refs: DataFrame, keys: DataFrame, counts: DataFrame) -> LineIndex:
    """The index with other refs and the given counts of ``keys``; other keys' counts and shards without a change stay as they are."""
    was = index.counts.join(keys, "key", "left_semi").where(repeated()).select("key")
    now = counts.where(repeated()).select("key")
    changes = now.join(was, "key", "left_anti").withColumn("add", F.lit(True)).unionByName(was.join(now, "key", "left_anti").withColumn("add", F.lit(False))).checkpoint()
    touched = changes.select(_shard(index.shards)).distinct()
    new = _updated(index.filters.join(touched, "shard", "left_semi"), changes, index.shards).checkpoint()
    counts = index.counts.join(keys, "key", "left_anti").unionByName(counts).checkpoint()
    stale = new.where("blob IS NULL").select("shard")
    filters = index.filters.join(touched, "shard", "left_anti").unionByName(new.where("blob IS NOT NULL"))
    if not stale.isEmpty():
        keys = counts.where(repeated()).select("key", F.lit(True).alias("add"), _shard(index.shards)).join(stale, "shard", "left_semi").drop("shard")
        filters = filters.unionByName(_updated(None, keys, index.shards))
    return LineIndex(refs, counts, filters.checkpoint(), index.shards)


def insert(index: LineIndex, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """The index with further documents. Texts of earlier ones are not read, and counts are summed for the new ones' keys only."""
    new = line_refs(df, id_col, text_col).checkpoint()
    keys = new.select("key").distinct()
    both = index.counts.join(keys, "key", "left_semi").unionByName(_counted(new))
    both = both.groupBy("key").agg(F.sum("refs").alias("refs"), F.min("owner").alias("owner"), F.max("last").alias("last"), F.max("of_null").alias("of_null")).checkpoint()
    return _changed(index, index.refs.unionByName(new), keys, both)


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without the documents of ``ids`` (one column): as if they had never been inserted. Only keys that these held are counted again."""
    gone = ids.select(F.col(ids.columns[0]).alias("__gone")).distinct()
    same = F.col("id").eqNullSafe(F.col("__gone"))
    keys = index.refs.join(gone, same, "left_semi").select("key").distinct().checkpoint()
    refs = index.refs.join(gone, same, "left_anti").checkpoint()
    return _changed(index, refs, keys, _counted(refs.join(keys, "key", "left_semi")).checkpoint())


def drops(index: LineIndex, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keys): the repeated keys of each document that another document owns; documents without any are absent.

    Where the filters together stay below ``FILTER_BYTES``, they go to all tasks, and only lines that they may hold
    are looked up in the exact counts; else every line is. Either way the exact counts decide.
    """
    size, total = index.filters.agg(F.sum(F.length("blob"))).first()[0] or 0, index.counts.agg(F.sum("refs")).first()[0] or 0
    many = index.counts.where(repeated())
    hot = F.col("refs") >= max(HOT_REFS, int(total * HOT_SHARE) + 1)
    owners = {bytes(r["key"]): r["owner"] for r in many.where(hot).collect()}
    filters = {r["shard"]: bytes(r["blob"]) for r in index.filters.collect()} if size <= FILTER_BYTES else None
    sent = df.sparkSession.sparkContext.broadcast((filters, index.shards, owners))
    found = _refs(df, id_col, text_col, sent).checkpoint()
    sent.destroy()
    rest = found.where("NOT sure").join(many.where(~hot).select("key", "owner"), "key").where(~F.col("id").eqNullSafe(F.col("owner")))
    return found.where("sure").select("key", "id").unionByName(rest.select("key", "id")).groupBy("id").agg(F.collect_set("key").alias("keys"))


def kept(index: LineIndex, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """id, n_lines, n_dropped, kept (text) of each row, then the columns of ``carry``.

    Lines whose key (at least ``LEAST_CHARS`` code points) occurs in two documents or more go, all of them, except in
    the document of the smallest id that holds it. The others stay as they are, joined by \\n. Null and empty texts are
    one empty line. Rows of one id are one document; a null id is a document after all others. Other columns are left
    out. Texts move once, to their document's list of keys.
    """

    def make():
        def step(columns):
            for doc, text, keys, *rest in zip(*columns):
                lines = (text or b"").split(b"\n")
                if keys:
                    gone = set(keys)
                    stay = [x for x in lines if key_hash(x) not in gone]
                else:
                    stay = lines
                yield doc, len(lines), len(lines) - len(stay), b"\n".join(stay), *rest

        return step

    rows = df.select(F.col(id_col), F.col(text_col).cast("binary").alias("__t"), *[F.col(c).alias(f"__c_{c}") for c in carry or []])
    keys = drops(index, df, id_col, text_col)
    rows = rows.join(keys.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("id")), "left").select(id_col, "__t", "keys", *[f"__c_{c}" for c in carry or []])
    kinds = "".join(f", `__c_{c}` {_kind(df, c)}" for c in carry or [])
    out = map_slices(rows, make, f"`{id_col}` {_kind(df, id_col)}, n_lines long, n_dropped long, kept binary{kinds}")
    return out.withColumn("kept", F.col("kept").cast("string")).withColumnsRenamed({f"__c_{c}": c for c in carry or []})
