"""Sources: tables, text, pages, JSON lines, images and injected services."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom import schemas
from claimloom.functions import ids, text, urls


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table; with ``spread``, one whose scan has fewer tasks than the cluster has cores is dealt to all of them.

    Text costs far more to read than to move, and a small table may be one row group. Large tables stay as scanned.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def text_packets(df: DataFrame, text_col: str = "text", keys: list[str] | None = None) -> DataFrame:
    """Messages of a table's texts."""
    none = F.array().cast(schemas.PACKET.split("images ")[1])
    t = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(*(keys or []), ids.packet_id(F.lit("text"), t, F.lit(0)).alias("packet_id"), F.lit("text").alias("input_type"), t.alias("text"), F.lit(None).cast("string").alias("source_date"), none.alias("images"))


def link_packets(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Messages of fetched pages: visible text and publication date."""
    t = text.html_text(F.col(html_col))
    day = F.nullif(F.regexp_extract(html_col, r"""(?i)(?:article:published_time|datePublished)["'][^>]*?(\d{4}-\d{2}-\d{2})""", 1), F.lit(""))
    none = F.array().cast(schemas.PACKET.split("images ")[1])
    return pages.select(urls.canonical_url(F.col(url_col)).alias("url"), ids.packet_id(F.lit("link"), t, F.lit(0)).alias("packet_id"), F.lit("link").alias("input_type"), t.alias("text"), day.alias("source_date"), none.alias("images"))


def json_lines(spark: SparkSession, path: str, schema, strict: bool = False) -> DataFrame:
    """JSON lines with a given schema: malformed lines are skipped, or fail the read if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def unique_ids(df: DataFrame, col: str = "id") -> DataFrame:
    """The frame, or an error where an id occurs twice."""
    twice = df.groupBy(col).count().where("count > 1").select(F.collect_list(col).alias("ids")).first()["ids"]
    if twice:
        raise ValueError(f"ids that occur more than once: {sorted(twice)[:10]}")
    return df


def seed_corpus(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.SEED)


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    return unique_ids(json_lines(spark, path, schemas.EVAL_CASE, strict=True))


def source_tiers(spark: SparkSession, path: str | None = None, config: dict | None = None) -> DataFrame:
    """(entry, tier) of a configuration of domains by tier (YAML or JSON file, or a dict); none lists nothing."""
    if config is None and path:
        raw = Path(path).read_text(encoding="utf-8")
        try:
            config = json.loads(raw)
        except ValueError:
            import yaml

            config = yaml.safe_load(raw)
    rows = [(entry.lower(), tier) for tier, entries in ((config or {}).get("domains") or {}).items() for entry in entries or []]
    return spark.createDataFrame(rows, "entry string, tier string")


def image_files(spark: SparkSession, path: str, signals: Callable | None = None) -> DataFrame:
    """path and image signals of files. ``signals(path, content)`` gives a dict of ocr_text, description, embedding,
    exif_date, ai_generated_score; each that fails or is absent stays null."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kind = "path string, ocr_text string, description string, embedding array<float>, exif_date string, ai_generated_score double, frame_time double"

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    found = signals(p, content) if signals else {}
                except Exception:  # a picture that cannot be read has no signals
                    found = {}
                rows.append((p, *(found.get(k) for k in ("ocr_text", "description", "embedding", "exif_date", "ai_generated_score", "frame_time"))))
            yield pd.DataFrame(rows, columns=["path", "ocr_text", "description", "embedding", "exif_date", "ai_generated_score", "frame_time"])

    return files.mapInPandas(run, kind)


def service(queries: DataFrame, call: Callable[[str], str | None], schema: str, tries: int = 1, wait_s: float = 0.0) -> DataFrame:
    """claim_id and what ``call(query text)`` answers as JSON, by ``schema``; each different query is asked once, and a failure is null."""
    asked = queries.select("text").distinct()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for q in pdf["text"]:
                answer = None
                for k in range(tries):
                    try:
                        answer = call(q)
                        break
                    except Exception:  # a source that fails contributes nothing
                        time.sleep(wait_s * k)
                out.append((q, answer))
            yield pd.DataFrame(out, columns=["text", "answer"])

    answers = asked.mapInPandas(run, "text string, answer string").select("text", F.from_json("answer", schema).alias("answer"))
    return queries.join(answers, "text", "left")


def fact_check_candidates(answers: DataFrame) -> DataFrame:
    """One candidate for each review of each claim in a fact-check service's answer (claims array<struct<text, claimReview array<...>>>)."""
    rows = answers.select("claim_id", F.explode("answer.claims").alias("c")).select("claim_id", F.col("c.text").alias("snippet"), F.explode("c.claimReview").alias("r"))
    return rows.select("claim_id", F.lit("factcheck").alias("source_type"), F.col("r.url").alias("url"), F.col("r.title").alias("title"), "snippet", F.col("r.publisher.name").alias("publisher"), F.col("r.publisher.site").alias("domain"), F.substring("r.reviewDate", 1, 10).alias("published_date"), F.col("r.textualRating").alias("rating_raw"))


FACT_CHECKS = "claims array<struct<text:string,claimReview:array<struct<url:string,title:string,textualRating:string,reviewDate:string,publisher:struct<name:string,site:string>>>>>"


def available(probes: dict[str, Callable[[], bool]]) -> dict[str, bool]:
    """Which sources can be asked; one whose probe fails cannot."""
    out = {}
    for name, probe in probes.items():
        try:
            out[name] = bool(probe())
        except Exception:  # not available
            out[name] = False
    return out


class Registry:
    """Sources by name, in order: each a function of (claims, queries) to candidates."""

    def __init__(self):
        self.sources: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}

    def add(self, name: str, find: Callable) -> None:
        self.sources[name] = find

    def collect(self, claims: DataFrame, queries: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame | None:
        out = None
        for name, find in self.sources.items():
            if name not in skip:
                found = find(claims, queries)
                out = found if out is None else out.unionByName(found, allowMissingColumns=True)
        return out
