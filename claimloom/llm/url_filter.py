"""URL filters: a blocked Bloom filter of listed keys passes possible hits to an exact hash join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.urls import canonical_url

#: Words of 64 bits in a block: a key's bits all lie in one block.
WORDS = 4
#: Bits of the filter for each listed key, up to MOST_BLOCKS blocks (8 MB). Beyond that more keys pass for nothing; the exact join removes them.
BITS_A_KEY, MOST_BLOCKS = 24, 1 << 18
#: Parts that the rows of one listed key are dealt to.
SALTS = 32


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is no ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(7))


def _mask(h: Column, word: int) -> Column:
    """Two bits of one word, from twelve bits of the hash."""
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", h, F.lit(at)).bitwiseAND(F.lit(63)).cast("int"))
    return bit(12 * word).bitwiseOR(bit(12 * word + 6))


def bloom(keys: DataFrame, blocks: int, key_col: str = "key") -> DataFrame:
    """One row, one array of ``blocks * WORDS`` words: the blocked Bloom filter of the keys.

    Keys are or-ed into their blocks before and after one shuffle by block; the row is of ``32 * blocks`` bytes.
    """
    h, g = _hashes(F.col(key_col))
    rows = keys.select(F.pmod(h, F.lit(blocks)).alias("block"), *[_mask(g, w).alias(f"w{w}") for w in range(WORDS)])
    held = rows.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)])
    every = keys.sparkSession.range(blocks).select(F.col("id").alias("block")).join(held, "block", "left")
    row = F.struct("block", F.array(*[F.coalesce(f"w{w}", F.lit(0).cast("long")) for w in range(WORDS)]).alias("words"))
    return every.agg(F.flatten(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["words"])).alias("words"))


def possible(key: Column, words: Column, blocks: int) -> Column:
    """Whether the filter may hold the key: never false for a listed one."""
    h, g = _hashes(key)
    at, out = F.pmod(h, F.lit(blocks)).cast("int") * WORDS, F.lit(True)
    for w in range(WORDS):
        m = _mask(g, w)
        out = out & (F.get(words, at + w).bitwiseAND(m) == m)
    return out


def listing(rules: DataFrame, listed: DataFrame, listed_col: str = "url") -> DataFrame:
    """(key, rule, verdict, size, host_size): a key for each rule (host, path, verdict) and each listed URL's canonical form.

    Equal rules become one, and ``block`` wins. Null and empty URLs are not listed; null hosts and paths are empty.
    """
    h, p = F.lower(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))
    a = rules.select(F.concat(F.lit("r"), h, p).alias("key"), F.concat(h, p).alias("rule"), "verdict", F.length(F.concat(h, p)).alias("size"), F.length(h).alias("host_size"))
    u = canonical_url(F.col(listed_col))
    b = listed.select(u.alias("u")).where("u <> ''").select(F.concat(F.lit("u"), "u").alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), F.lit(-1).alias("size"), F.lit(0).alias("host_size"))
    return a.unionByName(b).groupBy("key").agg(F.max("rule").alias("rule"), F.max("verdict").alias("verdict"), F.max("size").alias("size"), F.max("host_size").alias("host_size"))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict of each row.

    A rule (host, path, verdict) fits its host and all hosts below it, if the URL's path starts with the rule's. The
    longest host and path wins, then the longer host. Where no rule fits, a URL whose canonical form is listed is
    blocked and any other allowed. Null URLs, and those without ``://``, have empty host and path, no rule, and are
    allowed. Rows of one id and URL have one verdict and stay as many as they are; other columns play no part. Empty
    rules or lists allow everything.

    Each URL's keys are the ends of its host with the starts of its path, of as many labels and characters as rules
    have, and its canonical form. The filter, a scalar of at most 8 MB whatever the list's size, refuses most; of a
    URL without any left one row goes on alone. What is left meets the list in an exact hash join, each key in
    ``SALTS`` parts, so that a rule for a third of all URLs is no single task's. Only the number of listed keys and
    the lengths of rules' paths (as many as the longest path has characters, at most) reach the driver.
    """
    entries = listing(rules, listed, listed_col).persist()
    n = entries.count()
    blocks = max(1, min(MOST_BLOCKS, -(-n * BITS_A_KEY // (64 * WORDS))))
    words = bloom(entries, blocks).scalar()
    h, p = F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))
    labels, sizes = rules.agg(F.max(F.size(F.split(h, r"\."))), F.array_sort(F.collect_set(F.length(p)))).first()
    url, parts = F.col("__url"), F.split("host", r"\.")
    rows = pages.select(F.col(id_col), F.col(url_col).alias("__url"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"), F.spark_partition_id().alias("__part"))
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels or 0, 1)))), lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "."))
    fitting = F.filter(F.array(*[F.lit(k) for k in sizes]).cast("array<int>"), lambda k: k <= F.length("path"))
    rows = rows.withColumns({"__ends": ends, "__starts": F.transform(fitting, lambda k: F.substr(F.col("path"), F.lit(1), k))})
    keys = F.flatten(F.transform("__ends", lambda e: F.transform("__starts", lambda s: F.concat(F.lit("r"), e, s))))
    rows = rows.select(id_col, "__url", "host", "path", "__part", F.posexplode(F.concat(F.array(F.concat(F.lit("u"), canonical_url(url))), keys)).alias("__pos", "key"))
    rows = rows.withColumn("__may", possible(F.col("key"), words, blocks)).where("__may OR __pos = 0")
    alone = F.concat(F.lit("n"), F.coalesce(url, F.lit("")))  # no key of the list, and dealt by URL
    rows = rows.withColumns({"key": F.when(F.col("__may"), F.col("key")).otherwise(alone), "__salt": F.pmod(F.xxhash64(id_col, "__url"), F.lit(SALTS)).cast("int")})
    salted = entries.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = rows.join(salted, ["key", "__salt"], "left").groupBy(id_col, "__url", "host", "path", "__part")
    best = F.max_by(F.struct("rule", "verdict"), F.when(F.col("verdict").isNotNull(), F.struct("size", "host_size")))
    out = met.agg(best.alias("__best"), F.count_if(F.col("__pos") == 0).cast("int").alias("__rows")).withColumn("__row", F.explode(F.array_repeat(F.lit(0), F.col("__rows"))))
    return out.select(id_col, "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit("allow")).alias("verdict"))
