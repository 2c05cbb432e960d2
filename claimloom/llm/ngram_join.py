"""N-gram Jaccard join by grouped prefixes, to the components of linked documents.

Documents of one set are one from the start. Of each set only the prefix is looked at: the shingles that come first in
one fixed order, the rarest first, so many that two sets of the wanted similarity must share one. A shingle that stands
in one set's prefix only meets nobody and is left out. Sets that agree in what is left of their prefixes and in size
form a group. Before groups are paired, each set is compared on whole sets with others of two of its lists, a stretch of
a list at a time; that makes most of a family of near copies one component. Then pairs of groups that still lie in
different components are filtered by size and by the number of prefix shingles that they share, and those left are
expanded to their members, which are verified on whole sets. So no link is lost, and a list whose members are one
component is done without its pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm import frames
from claimloom.llm.components import checkpoint_folder, components
from claimloom.llm.frames import map_slices

WORDS = 5
#: Similarity in hundredths.
SIMILAR = 80
#: The order puts shingles of many documents last. Counts over all documents of shingles that so many documents
#: hold (by the upper half of their hashes), the most frequent ones and at most ``HEAVY_MOST``, go to all tasks. This steers the order only: results are the
#: same whatever it holds.
HEAVY_LEAST, HEAVY_MOST = 3, 1 << 19
#: Shingles that a task counts before it hands them on, bytes of texts whose shingles meet in one group on average, and the
#: number of documents from which a shingle's list is dealt out by its sets.
CHUNK, BYTES_TOGETHER, HOT = 1 << 21, 1 << 23, 1 << 14
#: Bits of the map of shingles (by the first bits of their hashes) that are counted more than once.
REPEATED_BITS = 1 << 26
#: Bits of the map that says which sets are fetched (wrongly set bits only cost time), in pieces of 2 ** 15.
FETCH_BITS = 1 << 24
#: Members of a stretch of one list, and the bytes of sets that a task compares at a time.
STRETCH, HELD_BYTES = 256, 16 << 20
#: Columns of shared shingles that a product of matrices takes at a time.
COLUMNS = 4096


#: White space of words, a random value for each byte, and a multiplier with its inverse: words are hashed as polynomials.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_VALUE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_TIMES = 0x9E3779B97F4A7C15
_BACK = pow(_TIMES, -1, 1 << 64)
#: Bytes of a text that are hashed at a time.
PART = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Sets of shingles as sorted 64-bit hashes."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.up, self.down = _powers(_TIMES, 4096), _powers(_BACK, 4096)

    def _hashes(self, text: bytes) -> np.ndarray:
        """A hash of each word."""
        b = np.frombuffer(text, np.uint8)
        if len(b) >= len(self.up):
            n = 1 << (len(b) + 1).bit_length()
            self.up, self.down = _powers(_TIMES, n), _powers(_BACK, n)
        space = np.ones(len(b) + 2, bool)
        space[1:-1] = _SPACE[b]
        edges = np.flatnonzero(space[1:] != space[:-1])
        start, end = edges[::2], edges[1::2]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_VALUE[b] * self.up[: len(b)], out=sums[1:])
        return (sums[end] - sums[start]) * self.down[start]

    def __call__(self, text: bytes | None) -> np.ndarray:
        text = (text or b"").lower()
        if len(text) <= PART:
            w = self._hashes(text)
        else:
            parts, at = [], 0
            while at < len(text):
                end = min(len(text), at + PART)
                while end < len(text) and not _SPACE[text[end]]:
                    end += 1
                parts.append(self._hashes(text[at:end]))
                at = end
            w = np.concatenate(parts)
        if not len(w):
            return np.empty(0, np.int64)
        k = min(self.words, len(w))
        h = np.full(len(w) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (w[j : len(w) - k + 1 + j] ^ (w[j : len(w) - k + 1 + j] >> np.uint64(32)))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return np.unique((h ^ (h >> np.uint64(32))).view(np.int64))


def prefix_length(n: int, similar: int = SIMILAR) -> int:
    return n - -(-similar * n // 100) + 1


def linked(a: np.ndarray, b: np.ndarray, similar: int = SIMILAR) -> bool:
    """100 * intersection >= similar * union."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < similar * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= similar * (len(a) + len(b) - both)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The number of elements that each two sets share, as a matrix; elements of one set only are left out first."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(x) for x in sets])
    both = n > 1
    keep, named = both[at], np.cumsum(both) - 1
    row, col = row[keep], named[at[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for k in range(0, int(both.sum()), COLUMNS):
        a, b = np.searchsorted(col, [k, k + COLUMNS])
        x = np.zeros((m, COLUMNS), np.float32)
        x[row[a:b], col[a:b] - k] = 1
        out += x @ x.T
    return out


def local_components(sets: list[np.ndarray], ids: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
    """For each set the smallest id that links among these sets reach."""
    n = np.array([len(x) for x in sets], np.float32)
    shared = overlaps(sets)
    links = 100 * shared >= similar * (n[:, None] + n[None] - shared)
    links |= np.eye(len(sets), dtype=bool)
    least = ids.copy()
    while True:
        now = np.where(links, least[None], np.iinfo(np.int64).max).min(1)
        if (now == least).all():
            return least
        least = now


def _ranges(rows: DataFrame) -> int:
    """Ranges of hashes that meet in one row group each: in proportion to the texts."""
    total = rows.agg(F.sum(F.length("__t"))).first()[0] or 0
    return int(max(1, min(1 << 24, total // BYTES_TOGETHER)))


def _cuts(at: np.ndarray) -> zip:
    """(start, end) of each run of equal values."""
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return zip(first.tolist(), [*first[1:].tolist(), len(at)])


def heavy_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper halves of hashes (sorted) and counts of shingles that many documents hold, over all rows, however they are
    dealt out, and a bit map of those counted twice at least.

    Each task counts in chunks; a chunk's sorted values go out as differences, cut into the same ranges everywhere. Of a
    range far more than its share of the most frequent ones is kept.
    """
    ranges = _ranges(rows)
    most = 8 * HEAVY_MOST // ranges + 1024

    def make():
        shingle = Shingler(words)

        class Step:
            held, n = [], 0

            def __call__(self, columns):
                for text in columns[0]:
                    self.held.append((shingle(text).view(np.uint64) >> np.uint64(32)).astype(np.uint32))
                    self.n += len(self.held[-1])
                return self.finish() if self.n >= CHUNK else ()

            def finish(self):
                if not self.n:
                    return
                h, c = np.unique(np.concatenate(self.held), return_counts=True)
                self.held, self.n = [], 0
                at = ((h.astype(np.uint64) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
                for a, b in _cuts(at):
                    steps, n = np.diff(h[a:b]), c[a:b]
                    steps = steps.astype(np.uint16) if b - a == 1 or steps.max() < 1 << 16 else steps
                    yield int(at[a]), int(h[a]), b - a, steps.tobytes(), n.astype(np.uint8 if n.max() < 256 else np.uint32).tobytes()

        return Step()

    def meet(table: pa.Table) -> pa.Table:
        hs, cs = [], []
        for base, n, steps, c in zip(*(table[x].to_pylist() for x in ("base", "n", "steps", "c"))):
            h = np.full(n, base, np.uint32)
            h[1:] += np.cumsum(np.frombuffer(steps, np.uint16 if len(steps) == 2 * n - 2 else np.uint32), dtype=np.uint32)
            hs.append(h)
            cs.append(np.frombuffer(c, np.uint8 if len(c) == n else np.uint32).astype(np.int64))
        h, c = np.concatenate(hs), np.concatenate(cs)
        order = np.argsort(h)
        h, c = h[order], c[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        h, c = h[first], np.add.reduceat(c, first)
        bit = h[c > 1] >> np.uint32(6)
        start = (int(h[0]) >> 6) & ~7
        bits = np.zeros(-(-((int(h[-1]) >> 6) + 1 - start) // 8) * 8, bool)
        bits[bit - start] = True
        many = np.flatnonzero(c >= HEAVY_LEAST)
        if len(many) > most:
            many = many[np.argpartition(c[many], -most)[-most:]]
        h, c = np.append(h[many].astype(np.int64), start), np.append(c[many], 0)
        return pa.table({"h": h, "c": c, "bits": pa.array([None] * len(many) + [np.packbits(bits).tobytes()], pa.binary())})

    parts = map_slices(rows.select("__t"), make, "at int, base long, n int, steps binary, c binary")
    found = parts.groupBy("at").applyInArrow(meet, "h long, c long, bits binary").checkpoint()
    repeated = np.zeros(REPEATED_BITS // 8, np.uint8)
    for r in found.where("bits IS NOT NULL").select("h", "bits").collect():  # pieces of one map of fixed size
        repeated[r["h"] // 8 : r["h"] // 8 + len(r["bits"])] |= np.frombuffer(r["bits"], np.uint8)
    sums = found.where("bits IS NULL")
    bands = sorted(((r["b"], r["n"]) for r in sums.groupBy(F.floor(F.log2("c") * 4).alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = None, 0
    for band, n in bands:
        held += n
        if held > HEAVY_MOST:
            break
        least = band
    if least is None:
        return np.empty(0, np.uint32), np.empty(0, np.int64), repeated
    table = sums.where(F.floor(F.log2("c") * 4) >= least).toArrow()
    h, c = table["h"].to_numpy().astype(np.uint32), table["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order], repeated


def _counts(h: np.ndarray, heavy: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The counts of hashes; of those that are not among the heavy ones 1, or 2 for those in the map."""
    hot, count, repeated = heavy
    high = (h.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    c = 1 + (repeated[high >> 9] >> (7 - (high >> 6 & 7)).astype(np.uint8) & 1).astype(np.int64)
    if len(hot):
        some = np.flatnonzero(c > 1)
        high = high[some]
        at = np.searchsorted(hot, high)
        at[at == len(hot)] = 0
        c[some] = np.where(hot[at] == high, count[at], 2)
    return c


def _prefixes(rows: DataFrame, heavy, words: int, similar: int) -> DataFrame:
    """(id, tag, n, sig, key, prefix) of each row; sig stands for the set, key are its first bytes. Rows without words have null sig."""

    def make():
        shingle, known = Shingler(words), heavy.value

        def step(columns):
            for doc, text, tag in zip(*columns):
                h = shingle(text)
                n = len(h)
                if not n:
                    yield doc, tag, 0, None, None, None
                    continue
                sig = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                prefix = h[np.lexsort((h, _counts(h, known)))[: prefix_length(n, similar)]]
                yield doc, tag, n, sig, int.from_bytes(sig[:8], "little", signed=True), prefix.tobytes()

        return step

    return map_slices(rows, make, "id long, tag long, n long, sig binary, key long, prefix binary")


def _lists(sets: DataFrame, heavy, ranges: int) -> DataFrame:
    """(token, key, df): each shingle that stands in the prefixes of at least two sets, with each of these sets.

    Shingles are counted by ranges as in ``heavy_shingles``. One of at least ``HOT`` documents counts as shared without
    being counted, with its number of documents as df, and its sets are dealt out by key; so no range holds a long list.
    """

    def make():
        known = heavy.value

        class Step:
            tokens, keys, n = [], [], 0

            def __call__(self, columns):
                for key, prefix in zip(*columns):
                    self.tokens.append(np.frombuffer(prefix, np.int64))
                    self.keys.append(np.full(len(self.tokens[-1]), key, np.int64))
                    self.n += len(self.tokens[-1])
                return self.finish() if self.n >= CHUNK else ()

            def finish(self):
                if not self.n:
                    return
                t, k = np.concatenate(self.tokens), np.concatenate(self.keys)
                self.tokens, self.keys, self.n = [], [], 0
                c = _counts(t, known)
                hot = c >= HOT
                by = np.where(hot, k, t).view(np.uint64) >> np.uint64(32)
                at = ((by * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64) + np.where(hot, ranges, 0)
                order = np.lexsort((k, t, at))
                t, k, c, at = t[order], k[order], c[order], at[order]
                new = np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]))
                t, k, c, at = t[new], k[new], c[new], at[new]
                for a, b in _cuts(at):
                    yield int(at[a]), t[a:b].tobytes(), k[a:b].tobytes(), c[a:b].tobytes() if at[a] >= ranges else None

        return Step()

    def meet(table: pa.Table) -> pa.Table:
        hot = table["at"][0].as_py() >= ranges
        whole = lambda name: np.concatenate([np.frombuffer(x, np.int64) for x in table[name].to_pylist()])
        t, k = whole("t"), whole("k")
        c = whole("c") if hot else np.zeros(len(t), np.int64)
        order = np.lexsort((k, t))
        t, k, c = t[order], k[order], c[order]
        new = np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]))
        t, k, c = t[new], k[new], c[new]
        if not hot:
            first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            n = np.diff(np.append(first, len(t)))
            c = np.repeat(n, n)
            t, k, c = t[c > 1], k[c > 1], c[c > 1]
        return pa.table({"token": t, "key": k, "df": c})

    parts = map_slices(sets.where("n > 0 AND id IS NOT NULL").select("key", "prefix"), make, "at int, t binary, k binary, c binary")
    return parts.groupBy("at").applyInArrow(meet, "token long, key long, df long")


def _fetch(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, set) of the rows whose id may be in ``wanted`` (one column): a bit map of fixed size goes to all tasks, and only texts that it holds are read by Python."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FETCH_BITS))
    bits = wanted.select(F.col(wanted.columns[0]).alias("id")).select(bit.alias("b"))
    maps = bits.groupBy(F.shiftright("b", 15).alias("__k")).agg(F.bitmap_construct_agg(F.col("b").bitwiseAND(F.lit(32767))).alias("__m"))
    byte = F.conv(F.hex(F.substring(F.col("__m"), (F.shiftright(F.col("__b").bitwiseAND(F.lit(32767)), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    found = rows.select("id", "__t", bit.alias("__b")).join(F.broadcast(maps), F.shiftright("__b", 15) == F.col("__k"))  # at most FETCH_BITS / 8 bytes
    found = found.where(F.getbit(byte, F.col("__b").bitwiseAND(F.lit(7)).cast("int")) == 1)

    def make():
        shingle = Shingler(words)
        return lambda columns: ((key, shingle(text).tobytes()) for key, text in zip(*columns))

    return map_slices(found.select("id", "__t"), make, "id long, set binary")


def verify(pairs: DataFrame, rows: DataFrame, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, hub) of ids whose sets are linked. A hub's set comes first in its stretch, then members stream by."""
    pairs = pairs.checkpoint()
    frames.rest(rows.sparkSession)
    sets = _fetch(rows, pairs.select(F.explode(F.array("a", "hub")).alias("id")).distinct(), words)
    many = pairs.groupBy("hub").agg(F.ceil(F.count("*") / STRETCH).alias("k"))
    salted = pairs.join(many, "hub").select("a", "hub", F.pmod(F.xxhash64("a"), F.col("k")).alias("salt"))
    members = salted.join(sets.withColumnRenamed("id", "a"), "a").select("hub", "salt", F.lit(1).alias("kind"), "a", "set")
    hubs = many.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k").cast("long") - 1)).alias("salt"))
    hubs = hubs.join(sets.withColumnRenamed("id", "hub"), "hub").select("hub", "salt", F.lit(0).alias("kind"), F.col("hub").alias("a"), "set")
    both = members.unionByName(hubs).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind")
    target = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        at, held = None, []
        for batch in batches:
            found = []
            for hub, salt, kind, a, data in zip(*(c.to_pylist() for c in batch.columns)):
                mine = np.frombuffer(data, np.int64)
                if kind == 0:
                    held = [*held, mine] if at == (hub, salt) else [mine]
                    at = (hub, salt)
                elif at == (hub, salt) and any(linked(mine, h, similar) for h in held):
                    found.append((a, hub))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=target)

    return both.mapInArrow(run, "a long, b long").distinct().checkpoint()


def _values(column: pa.Array) -> list:
    """A column's values; of a column of lists, views of one array."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    whole, at = column.values.to_numpy(), column.offsets.to_numpy()
    return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _grouped(batches, keys: int, most: float = float("inf")):
    """(key, rows) of each stretch of sorted rows whose first ``keys`` columns agree; one whose last column is longer than ``most`` comes in parts."""
    at, held, size = None, [], 0
    for batch in batches:
        for row in zip(*map(_values, batch.columns)):
            if row[:keys] != at or size > most:
                if held:
                    yield at, held
                at, held, size = row[:keys], [], 0
            held.append(row[keys:])
            size += len(row[-1])
    if held:
        yield at, held


def _near_ones(members: DataFrame, rows: DataFrame, words: int, similar: int) -> DataFrame:
    """Links (a, b) found in stretches of each set's longest list and, if that has several stretches, of one by a hash."""
    homes = F.array(*(F.struct(F.lit(r).alias("turn"), F.col(f"home{r}.token").alias("token"), F.ceil(F.col(f"home{r}.df") / STRETCH).alias("k")) for r in (0, 1)))
    again = (F.col("x.turn") == 0) | (F.col("home0.df") > STRETCH)
    lists = members.select("rep", "home0", "home1", F.explode(homes).alias("x")).where(again).select("rep", "x.*")
    lists = lists.select("token", "turn", F.pmod(F.xxhash64("rep", "turn"), F.col("k")).alias("salt"), "rep")
    dealt = lists.join(_fetch(rows, members.select("rep"), words).withColumnRenamed("id", "rep"), "rep").select("token", "turn", "salt", "rep", "set")
    dealt = dealt.repartition("token", "turn", "salt").sortWithinPartitions("token", "turn", "salt", "rep")
    target = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for _, held in _grouped(batches, 3, HELD_BYTES):
            if len(held) > 1:
                ids = np.array([x[0] for x in held], np.int64)
                root = local_components([np.frombuffer(x[1], np.int64) for x in held], ids, similar)
                other = root != ids
                yield pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.array(root[other])], schema=target)

    return dealt.mapInArrow(run, "a long, b long").distinct().checkpoint()


def _pairs_apart(groups: DataFrame, similar: int) -> DataFrame:
    """Pairs (x, y) of groups that have members in different components and may link by size and shared prefix.

    In a list, the groups within its most frequent component need not meet each other: they are dealt out in stretches,
    and each other group comes to all of these and to all stretches of other groups. Of the lists that a pair shares,
    the one of the smallest shingle has it.
    """
    entries = groups.select("gid", "lo", "hi", F.explode("tokens").alias("token"))
    mixed = entries.groupBy("token").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).where("a <> b").select("token")
    entries = entries.join(mixed, "token").checkpoint()
    own = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    sizes = entries.groupBy("token", own.alias("own")).agg(F.count("*").alias("k"))
    sizes = sizes.groupBy("token").agg(F.max(F.when(F.col("own").isNotNull(), F.struct("k", "own"))).alias("big"), F.sum("k").alias("all"))
    most = F.coalesce("big.k", F.lit(0))
    sizes = sizes.select("token", F.col("big.own").alias("own"), F.ceil(most / STRETCH).cast("int").alias("kb"), F.ceil((F.col("all") - most) / STRETCH).cast("int").alias("ka"))
    rows = entries.join(sizes, "token").withColumn("of_big", F.coalesce((F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("own")), F.lit(False)))
    rows = rows.withColumn("s", F.pmod(F.xxhash64("gid"), F.when(F.col("of_big"), F.col("kb")).otherwise(F.col("ka"))).cast("int"))
    block = lambda i, j, side: F.struct(F.lit(i).cast("int").alias("i") if isinstance(i, int) else i.alias("i"), F.lit(j).cast("int").alias("j") if isinstance(j, int) else j.alias("j"), side.cast("int").alias("side"))
    to_big = F.transform(F.when(F.col("kb") > 0, F.sequence(F.lit(0), F.col("kb") - 1)).otherwise(F.array().cast("array<int>")), lambda t: block(t, -1, F.lit(1)))
    to_others = F.transform(F.sequence(F.lit(0), F.col("ka") - 1), lambda t: block(F.least(t, F.col("s")), F.greatest(t, F.col("s")), F.col("s") > t))
    blocks = F.when(F.col("of_big"), F.array(block(F.col("s"), -1, F.lit(0)))).otherwise(F.concat(to_big, to_others))
    dealt = rows.withColumn("__b", F.explode(blocks)).select("token", "__b.i", "__b.j", "__b.side", "gid", "lo", "hi")
    halves = groups.select("gid", "n", F.size("tokens").alias("q"), F.array_sort(F.array_distinct(F.transform("tokens", lambda t: F.shiftright(t, 32).cast("int")))).alias("tokens"))
    dealt = dealt.join(halves, "gid").select("token", "i", "j", "side", "gid", "n", "lo", "hi", "q", "tokens")
    dealt = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "side")
    target = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def run(batches):
        for (token, i, j), held in _grouped(batches, 3):
            side, gid, n, lo, hi, q = np.array([x[:6] for x in held], np.int64).T
            if len(held) == 1 or i != j and side[0] == side[-1]:
                continue
            tokens = [x[6] for x in held]
            alike = q - np.array([len(x) for x in tokens])  # shingles whose halves are the same
            small, large = np.minimum(n[:, None], n[None]), np.maximum(n[:, None], n[None])
            least = -(-similar * (small + large) // (100 + similar)) + (-similar * large // 100) + 1  # shingles that the prefixes must share
            may = (100 * small >= similar * large) & (np.minimum(q[:, None], q[None]) >= least)
            may &= ~((lo == hi)[:, None] & (lo == hi)[None] & (lo[:, None] == lo[None]))
            may = np.triu(may, 1) if i == j else may & (side[:, None] < side[None])
            if not may.any():
                continue
            may &= overlaps(tokens) + np.maximum(alike[:, None], alike[None]) >= least
            found = [(int(gid[a]), int(gid[b])) for a, b in np.argwhere(may) if np.intersect1d(tokens[a], tokens[b], assume_unique=True)[0] == token >> 32]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], schema=target)

    return dealt.mapInArrow(run, "x long, y long")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: int = SIMILAR, tag: Column | None = None) -> DataFrame:
    """id, n_shingles, component of each row, and what ``tag`` makes of the row (a long), if given.

    A row's set: distinct shingles of ``words`` words (A-Z lower-cased); with fewer words, the whole sequence as one.
    Two rows link when 100 * intersection >= ``similar`` * union; component is the smallest id that links reach.
    Rows without words (null, empty or blank texts) have 0 shingles and are their own component. Rows of equal sets are
    linked, repeated rows too. A null id takes no part (null component). Ids are integers; rows that share an id stay,
    and each gets the component of its text. Other columns are left out. Sets are compared by 64-bit hashes.

    Every text is shingled twice, to count and to find its prefix; after that only the texts of sets that share something.
    """
    checkpoint_folder(df)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("__t"))
    heavy = df.sparkSession.sparkContext.broadcast(heavy_shingles(rows, words))
    frames.rest(df.sparkSession)
    tagged = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("__t"), (F.lit(None) if tag is None else tag).cast("long").alias("tag"))
    sets = _prefixes(tagged, heavy, words, similar).checkpoint()
    reps = sets.where("n > 0 AND id IS NOT NULL").groupBy("sig").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("key").alias("key"))
    members = _lists(sets, heavy, _ranges(rows)).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("token", "df"))).alias("t")).join(reps, "key")
    members = members.select(
        "rep", "n", F.col("t.token").alias("tokens"), F.md5(F.concat_ws(",", F.col("n").cast("string"), F.col("t.token").cast("array<string>")).cast("binary")).alias("gkey"),
        F.array_max(F.transform("t", lambda x: F.struct(x["df"].alias("df"), x["token"].alias("token")))).alias("home0"),
        F.array_min(F.transform("t", lambda x: F.struct(F.xxhash64(x["token"]).alias("by"), x["df"].alias("df"), x["token"].alias("token")))).alias("home1"),
    ).checkpoint()
    heavy.destroy()  # what follows rests on the shared folder
    del heavy
    frames.rest(df.sparkSession)
    edges = _near_ones(members, rows, words, similar)
    frames.rest(df.sparkSession)
    found = components(edges).withColumnRenamed("id", "rep")

    # what those stretches left apart
    placed = members.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    groups = placed.groupBy("gkey").agg(F.min("rep").alias("gid"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.min("component").alias("lo"), F.max("component").alias("hi")).checkpoint()
    placed = placed.select("rep", "gkey", "component").join(groups.select("gkey", "gid"), "gkey").select("rep", "gid", "component")
    pairs = _pairs_apart(groups, similar).unionByName(groups.where("lo <> hi").select(F.col("gid").alias("x"), F.col("gid").alias("y")))
    x, y = (placed.select(F.col("gid").alias(g), F.col("rep").alias(r), F.col("component").alias(c)) for g, r, c in (("x", "a", "ca"), ("y", "hub", "cb")))
    pairs = pairs.join(x, "x").join(y, "y").where("ca <> cb AND (x <> y OR a > hub)").select("a", "hub")
    frames.rest(df.sparkSession)
    more = verify(pairs, rows, words, similar)
    frames.rest(df.sparkSession)
    if not more.isEmpty():
        found = components(edges.unionByName(more)).withColumnRenamed("id", "rep")
    of_set = reps.select("sig", "rep").join(found, "rep", "left").select("sig", F.coalesce("component", "rep").alias("component"))
    out = sets.select("id", "tag", "n", "sig").join(of_set, "sig", "left")
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"), *(["tag"] if tag is not None else []))
