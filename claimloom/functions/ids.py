"""Deterministic ids: a prefix and the first 12 hex digits of SHA-1 over the parts, joined by a bar."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column) -> Column:
    """Null parts count as the text None."""
    joined = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    text = joined[0]
    for p in joined[1:]:
        text = F.concat(text, F.lit("|"), p)
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(text), 1, 12))


def packet_id(input_type: Column, text: Column, n_images: Column) -> Column:
    return stable_id("pkt", input_type, F.substring(F.coalesce(text, F.lit("")), 1, 500), n_images)


def claim_id(packet: Column, normalized_text: Column) -> Column:
    return stable_id("clm", packet, normalized_text)


def entity_id(label: Column, text: Column) -> Column:
    return stable_id("ent", label, F.lower(text))


def evidence_id(claim: Column, source_type: Column, canonical_url: Column, title: Column, snippet: Column) -> Column:
    other = F.concat(F.coalesce(title, F.lit("")), F.substring(F.coalesce(snippet, F.lit("")), 1, 200))
    return stable_id("ev", claim, source_type, F.when(F.coalesce(canonical_url, F.lit("")) != "", canonical_url).otherwise(other))


def image_id(packet: Column, path: Column, frame_time: Column) -> Column:
    return stable_id("img", packet, path, F.coalesce(F.round(frame_time, 2).cast("string"), F.lit("")))


def source_id(domain: Column) -> Column:
    return stable_id("src", F.lower(domain))


def date_id(day: Column) -> Column:
    return F.concat(F.lit("date_"), F.date_format(day, "yyyy-MM-dd"))


def verdict_id(claim: Column) -> Column:
    return stable_id("vrd", claim)
