"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import vocab as V


def canonical_url(url: Column) -> Column:
    """What identifies the document: https, lower-case host without www. and default port, no /amp, fragment, tracking
    parameters or last slash; the other parameters sorted. Null and blank give the empty text."""
    t = F.trim(F.coalesce(url, F.lit("")))
    return _bound(t, lambda t: F.when(t == "", F.lit("")).otherwise(_bound(F.when(F.contains(t, F.lit("//")), t).otherwise(F.concat(F.lit("https://"), t)), _canonical)))


def _bound(value: Column, read) -> Column:
    """``read`` of a value that is made once; written out it would be made at each place it stands, and plans grow with the product."""
    return F.transform(F.array(value), read)[0]


def _canonical(t: Column) -> Column:
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    whole = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?"
    pairs = F.transform(F.filter(F.split(part(whole, 5), "&"), lambda p: p != ""), lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    pairs = F.sort_array(F.filter(pairs, lambda p: ~F.regexp_extract(p, "^([^=]*)", 1).rlike(f"(?i)^(?:{V.TRACKING})$")))
    path = F.regexp_replace(part(whole, 4), r"(?i)/amp/?$|\.amp$", "")
    return _bound(F.struct(F.lower(part(whole, 1)).alias("scheme"), F.regexp_replace(F.lower(part(whole, 2)), r"^www\.", "").alias("host"), part(whole, 3).alias("port"), path.alias("path"), F.array_join(pairs, "&").alias("query")), _joined)


def _joined(u: Column) -> Column:
    host = F.when(u["port"].isin("", "80", "443"), u["host"]).otherwise(F.concat(u["host"], F.lit(":"), u["port"]))
    path = F.when(F.length(u["path"]) > 1, F.regexp_replace(u["path"], "/$", "")).otherwise(u["path"])
    scheme = F.when(u["scheme"].isin("", "http", "https"), F.lit("https")).otherwise(u["scheme"])
    return F.concat(scheme, F.lit("://"), host, path, F.when(u["query"] != "", F.concat(F.lit("?"), u["query"])).otherwise(F.lit("")))


def domain(url: Column) -> Column:
    return F.regexp_extract(canonical_url(url), r"^[a-z0-9+.-]+://([^/?#:]*)", 1)


def image_url(url: Column, source_url: Column, remote_url: Column, path: Column) -> Column:
    """The first that is given; a path only if it is a web address."""
    given = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.coalesce(given(url), given(source_url), given(remote_url), F.when(path.rlike("^https?://"), path))


def suffixes(host: Column) -> Column:
    """a.b.c -> a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def with_tier(df: DataFrame, listed: DataFrame, host_col: str = "domain", default: str = "other", tiers: dict[str, float] | None = None) -> DataFrame:
    """The frame with ``tier`` and ``source_weight`` of its host.

    ``listed`` (entry, tier) is a configuration; an entry may have a path, which counts for length only. Of the entries
    that are the host or end it after a dot the longest decides. As an equi-join on host suffixes, small side by size.
    """
    hosts = df.select(F.col(host_col).alias("__host")).where("__host IS NOT NULL").distinct()
    ends = hosts.select("__host", F.explode(suffixes(F.regexp_replace(F.lower("__host"), r"^www\.", ""))).alias("__end"))
    index = listed.select(F.element_at(F.split("entry", "/"), 1).alias("__end"), "tier", F.length("entry").alias("__n"), "entry")
    best = ends.join(index, "__end").groupBy("__host").agg(F.max_by("tier", F.struct("__n", "entry")).alias("tier"))
    weights = F.create_map(*[x for k, v in (tiers or V.TIERS).items() for x in (F.lit(k), F.lit(v))])
    out = df.join(best, df[host_col] == best["__host"], "left").drop("__host").withColumn("tier", F.coalesce("tier", F.lit(default)))
    return out.withColumn("source_weight", F.coalesce(F.element_at(weights, F.col("tier")), F.lit((tiers or V.TIERS)["other"])))
