"""Sinks: replies, wire format, graphs, and a keyed cache."""

from __future__ import annotations

import html
import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text


def public_images(images: Column) -> Column:
    """Images without vectors."""
    return F.transform(images, lambda x: x.dropFields("embedding"))


def reply(advice: Column, claim: Column, explanation: Column, reasons: Column, others: Column, demo: Column, most: int = 900) -> Column:
    """What a bot sends back; cut at a word beyond ``most`` characters."""
    none = F.coalesce(claim, F.lit("")) == ""
    more = F.when(others > 0, F.concat(F.lit("\n("), others.cast("string"), F.lit(" other claim"), F.when(others > 1, "s").otherwise(""), F.lit(" checked.)")))
    why = F.when(F.size(reasons) > 0, F.concat(F.lit("\nWhy:\n"), F.array_join(F.transform(F.slice(reasons, 1, 2), lambda r: F.concat(F.lit("  - "), r)), "\n")))
    note = F.when(F.coalesce(demo, F.lit(False)), F.lit("\nNote: this is running on the demo evidence index, not on live fact-checks."))
    full = F.concat_ws("\n", advice, F.concat(F.lit("\nClaim: "), F.substring(claim, 1, 200)), F.coalesce(explanation, F.lit("")), why, more, note)
    full = F.when(none, F.concat_ws("\n", advice, F.lit("I couldn't find a factual claim in this message to check."))).otherwise(full)
    return F.when(F.length(full) > most, F.concat(text.truncated(full, most), F.lit(" ..."))).otherwise(full)


def wire(results: DataFrame, with_graph: bool = False) -> DataFrame:
    """packet_id, body: the answer as JSON."""
    cols = [c for c in results.columns if c != "packet_id" and (with_graph or c != "graph")]
    return results.select("packet_id", F.to_json(F.struct(*cols)).alias("body"))


def accepted(requests: DataFrame, most_chars: int = 10_000, most_bytes: int = 64 << 20) -> DataFrame:
    """``refused``: why a request is not taken, or null."""
    t = F.trim(F.coalesce("text", F.lit("")))
    return requests.withColumn("refused", F.when((t == "") & (F.coalesce("bytes", F.lit(0)) == 0), "empty").when(F.length("text") > most_chars, "too long").when(F.coalesce("bytes", F.lit(0)) > most_bytes, "too large"))


def graph_html(graph_json: str) -> str:
    """One message's graph as a page with its nodes and edges."""
    g = json.loads(graph_json)
    row = lambda *x: "<tr>" + "".join(f"<td>{html.escape(str(c))}</td>" for c in x) + "</tr>"
    nodes = "".join(row(n["id"], n["kind"], n.get("attrs")) for n in g.get("nodes") or [])
    edges = "".join(row(e["src"], e["type"], e["dst"]) for e in g.get("edges") or [])
    return f"<!doctype html><meta charset=utf-8><title>graph</title><table>{nodes}</table><table>{edges}</table>"


def write_cases(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


class Cache:
    """A keyed table of answers (key, value, at): nulls are never kept, old ones don't count."""

    def __init__(self, spark: SparkSession, path: str, ttl_days: float = 7):
        self.spark, self.path, self.ttl = spark, path, ttl_days * 86400

    @staticmethod
    def key(*parts: Column) -> Column:
        return F.sha1(F.to_json(F.array(*[p.cast("string") for p in parts])))

    def read(self) -> DataFrame:
        try:
            rows = self.spark.read.schema("key string, value string, at double").parquet(self.path)
            rows.schema
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "key string, value string, at double")
        return rows.where(F.col("at") > time.time() - self.ttl).groupBy("key").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))

    def split(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(hits with value, misses) of a frame with ``key``."""
        held = self.read()
        return asked.join(held.select("key", "value"), "key"), asked.join(held.select("key"), "key", "left_anti")

    def put(self, answers: DataFrame) -> None:
        answers.where("value IS NOT NULL").select("key", "value", F.lit(time.time()).alias("at")).write.mode("append").parquet(self.path)
