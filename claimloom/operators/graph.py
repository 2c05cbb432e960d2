"""The property graph as two tables: nodes (packet_id, id, kind, attrs) and edges (packet_id, src, dst, type, via, attrs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import ids

STANCE_EDGES = ("SUPPORTS", "REFUTES", "NEUTRAL_TO")


def attrs(**values: Column) -> Column:
    """map<string,string> without nulls; vectors don't belong in it."""
    pairs = F.map_from_entries(F.array(*[F.struct(F.lit(k), v.cast("string")) for k, v in values.items()]))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def _node(df: DataFrame, id_: Column, kind: str, a: Column) -> DataFrame:
    return df.select("packet_id", id_.alias("id"), F.lit(kind).alias("kind"), a.alias("attrs"))


def _edge(df: DataFrame, src: Column, dst: Column, type_: str | Column, via: Column | None = None, a: Column | None = None) -> DataFrame:
    kind = F.lit(type_) if isinstance(type_, str) else type_
    empty = F.create_map().cast("map<string,string>")
    return df.select("packet_id", src.alias("src"), dst.alias("dst"), kind.alias("type"), (F.lit("") if via is None else via).alias("via"), (empty if a is None else a).alias("attrs"))


def mentions(claims: DataFrame) -> DataFrame:
    return claims.select("packet_id", "claim_id", "pos", F.explode("entities").alias("e")).select("packet_id", "claim_id", "pos", F.col("e.id").alias("entity_id"), F.col("e.text").alias("text"), F.col("e.label").alias("label"))


def shares_entity(mentions_: DataFrame) -> DataFrame:
    """packet_id, src, dst, via: an earlier claim and a later one of the same message with a common entity.

    Within a message every claim is linked with the claims after it that share an entity, through a self-join on message
    and entity; a message is one text, so its groups are small.
    """
    a = mentions_.select("packet_id", "entity_id", F.col("claim_id").alias("src"), F.col("pos").alias("p"))
    b = mentions_.select("packet_id", "entity_id", F.col("claim_id").alias("dst"), F.col("pos").alias("q"))
    return a.join(b, ["packet_id", "entity_id"]).where("p < q").select("packet_id", "src", "dst", F.col("entity_id").alias("via")).distinct()


def from_claims(claims: DataFrame, packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of claims, entities, images and dates."""
    m = mentions(claims)
    images = packets.select("packet_id", F.posexplode("images").alias("image_index", "i")).select("packet_id", "image_index", "i.*")
    images = images.withColumn("image_id", ids.image_id(F.col("packet_id"), F.col("path"), F.col("frame_time")))
    dated = claims.select("packet_id", "claim_id", F.explode("times").alias("t")).where("t.normalized IS NOT NULL").select("packet_id", "claim_id", F.to_date("t.normalized").alias("day"))
    nodes = [
        _node(claims, F.col("claim_id"), "claim", attrs(text=F.col("sentence"), claim_type=F.col("claim_type"), confidence=F.col("confidence"), check_worthy=F.col("check_worthy"))),
        _node(m, F.col("entity_id"), "entity", attrs(text=F.col("text"), label=F.col("label"))),
        _node(images, F.col("image_id"), "image", attrs(path=F.col("path"), exif_date=F.col("exif_date"), ai_generated_score=F.col("ai_generated_score"))),
        _node(dated, ids.date_id(F.col("day")), "date", attrs(date=F.col("day"))),
    ]
    shown = claims.where("image_index IS NOT NULL").join(images.select("packet_id", "image_index", "image_id"), ["packet_id", "image_index"])
    edges = [
        _edge(m, F.col("claim_id"), F.col("entity_id"), "MENTIONS"), _edge(shares_entity(m), F.col("src"), F.col("dst"), "SHARES_ENTITY", F.col("via")),
        _edge(shown, F.col("claim_id"), F.col("image_id"), "EXTRACTED_FROM"), _edge(dated, F.col("claim_id"), ids.date_id(F.col("day")), "CLAIMED_DATE"),
    ]
    return upsert_nodes(_union(nodes)), upsert_edges(_union(edges))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def add_evidence(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of evidence, its source and its date, and the edges between them and the claim (evidence has packet_id)."""
    day = F.try_to_date("published_date", F.lit("yyyy-MM-dd"))
    src = ids.source_id(F.col("domain"))
    sourced, dated = evidence.where("coalesce(domain, '') <> ''"), evidence.where(day.isNotNull())
    nodes = [
        _node(evidence, F.col("id"), "evidence", attrs(title=F.col("title"), url=F.col("url"), rating=F.col("rating"), score=F.col("score"), weight=F.col("source_weight"), decisive=F.col("decisive"))),
        _node(sourced, src, "source", attrs(domain=F.lower("domain"))), _node(dated, ids.date_id(day), "date", attrs(date=day)),
    ]
    edges = [_edge(evidence, F.col("claim_id"), F.col("id"), "HAS_EVIDENCE"), _edge(sourced, F.col("id"), src, "PUBLISHED_BY"), _edge(dated, F.col("id"), ids.date_id(day), "PUBLISHED_ON")]
    return upsert_nodes(_union(nodes)), upsert_edges(_union(edges))


def stance_edges(stances: DataFrame) -> DataFrame:
    kind = F.when(F.col("stance") == "supports", "SUPPORTS").when(F.col("stance") == "refutes", "REFUTES").otherwise("NEUTRAL_TO")
    return _edge(stances, F.col("evidence_id"), F.col("claim_id"), kind, None, attrs(score=F.col("score"), method=F.col("method")))


def verdict_nodes(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    v = ids.verdict_id(F.col("claim_id"))
    return _node(verdicts, v, "verdict", attrs(label=F.col("label"), confidence=F.col("confidence"))), _edge(verdicts, F.col("claim_id"), v, "HAS_VERDICT")


def upsert_nodes(log: DataFrame, seq: str | None = None) -> DataFrame:
    """One row a node: later attributes win one by one, absent ones stay; two kinds for one id are an error."""
    rows = log.withColumn("__s", F.col(seq) if seq else F.lit(0))
    pairs = rows.select("packet_id", "id", "kind", "__s", F.explode_outer("attrs").alias("k", "v"))
    last = pairs.groupBy("packet_id", "id", "k").agg(F.max_by("v", F.struct("__s", "v")).alias("v"), F.min("kind").alias("a"), F.max("kind").alias("b"))
    one = last.groupBy("packet_id", "id").agg(F.min("a").alias("kind"), F.max("b").alias("__b"), F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))).alias("e"))
    kind = F.when(F.col("kind") == F.col("__b"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("two kinds of node "), F.col("id"))))
    return one.select("packet_id", "id", kind.alias("kind"), F.map_from_entries("e").alias("attrs"))


def upsert_edges(log: DataFrame, seq: str | None = None) -> DataFrame:
    """One row for each (src, dst, type, via); the last write's attributes."""
    s = F.col(seq) if seq else F.lit(0)
    return log.groupBy("packet_id", "src", "dst", "type", "via").agg(F.max_by("attrs", F.struct(s, F.to_json("attrs"))).alias("attrs"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is no node."""
    n = nodes.select("packet_id", F.col("id").alias("__id")).distinct()
    ends = edges.select("packet_id", "src", "dst", "type", F.explode(F.array("src", "dst")).alias("__id"))
    return ends.join(n, ["packet_id", "__id"], "left_anti").select("packet_id", "src", "dst", "type").distinct()


def replaced_stances(log: DataFrame, keys: tuple[str, ...] = ("evidence_id", "claim_id"), seq: str = "seq") -> DataFrame:
    """The last stance of each pair."""
    return log.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))).where("__k = 1").drop("__k")


def evidence_for(edges: DataFrame, nodes: DataFrame, stance: str | None = None) -> DataFrame:
    """claim_id, evidence_id, stance, score, attrs of each claim's evidence, with its stance edge if it has one."""
    has = edges.where("type = 'HAS_EVIDENCE'").select("packet_id", F.col("src").alias("claim_id"), F.col("dst").alias("evidence_id"))
    st = edges.where(F.col("type").isin(*STANCE_EDGES)).select("packet_id", F.col("src").alias("evidence_id"), F.col("dst").alias("claim_id"), F.lower(F.when(F.col("type") == "NEUTRAL_TO", "neutral").otherwise(F.col("type"))).alias("stance"), F.col("attrs")["score"].cast("double").alias("score"))
    out = has.join(st, ["packet_id", "claim_id", "evidence_id"], "left").join(nodes.select("packet_id", F.col("id").alias("evidence_id"), "attrs"), ["packet_id", "evidence_id"])
    return out if stance is None else out.where(F.col("stance") == stance)


def evidence_order(evidence: DataFrame, key: str = "claim_id") -> DataFrame:
    """Each claim's evidence by rank: decisive first, then weighted score, weight and id; missing scores and weights count as 0."""
    score, weight = F.coalesce("score", F.lit(0.0)), F.coalesce("weight", F.lit(0.0))
    order = Window.partitionBy(key).orderBy(F.desc(F.coalesce("decisive", F.lit(False))), F.desc(score * weight), F.desc(weight), "id")
    return evidence.withColumn("rank", F.row_number().over(order))


def with_duplicates(nodes: DataFrame, links: DataFrame, key: str = "id", seen: str = "first_seen") -> DataFrame:
    """Nodes with the number of their duplicate links; links (key, ``seen``) move a node's first-seen day earlier, never later."""
    found = links.groupBy(key).agg(F.min(seen).alias("__seen"), F.count("*").alias("n_duplicates"))
    out = nodes.join(found, key, "left").withColumn(seen, F.least(seen, "__seen")).drop("__seen")
    return out.withColumn("n_duplicates", F.coalesce("n_duplicates", F.lit(0).cast("long")))


def open_claims(claims: DataFrame, stances: DataFrame) -> DataFrame:
    """Check-worthy claims that nothing supports or refutes."""
    return claims.where("check_worthy").join(stances.where(F.col("stance").isin("supports", "refutes")).select("claim_id"), "claim_id", "left_anti")


def first_seen(sightings: DataFrame, key: str = "image_id", day: str = "day") -> DataFrame:
    return sightings.groupBy(key).agg(F.min(day).alias("first_seen"))


def date_mismatch(images: DataFrame, least_days: int = 30) -> DataFrame:
    """``gap_days`` and ``date_mismatch``: seen before the claimed day by at least ``least_days``, or with no claimed day at all."""
    gap = F.datediff("claimed", "first_seen")
    flagged = F.col("first_seen").isNotNull() & (F.col("claimed").isNull() | (gap >= least_days))
    return images.withColumn("gap_days", gap).withColumn("date_mismatch", F.coalesce(flagged, F.lit(False)))


def timeline(claimed: DataFrame, published: DataFrame, seen: DataFrame, packets: DataFrame) -> DataFrame:
    """packet_id, day, type, node, label of all dated things (each with packet_id, day, node, label), by day, type and node within a message."""
    parts = [df.select("packet_id", "day", F.lit(t).alias("type"), "node", "label") for df, t in ((claimed, "claimed"), (published, "published"), (seen, "first_seen"), (packets, "message"))]
    return _union(parts).where("day IS NOT NULL").distinct().orderBy("packet_id", "day", "type", "node")


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """packet_id, graph: each message's graph as JSON, ordered."""
    n = nodes.groupBy("packet_id").agg(F.array_sort(F.collect_list(F.struct("id", "kind", F.array_sort(F.map_entries("attrs")).alias("attrs")))).alias("nodes"))
    e = edges.groupBy("packet_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "type", "via", F.array_sort(F.map_entries("attrs")).alias("attrs")))).alias("edges"))
    return n.join(e, "packet_id", "full_outer").select("packet_id", F.to_json(F.struct("nodes", "edges")).alias("graph"))


_PAIRS = "array<struct<key:string,value:string>>"


def from_json(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of what ``to_json`` wrote."""
    g = graphs.select("packet_id", F.from_json("graph", f"nodes array<struct<id:string,kind:string,attrs:{_PAIRS}>>, edges array<struct<src:string,dst:string,type:string,via:string,attrs:{_PAIRS}>>").alias("g"))
    n = g.select("packet_id", F.explode("g.nodes").alias("n")).select("packet_id", "n.id", "n.kind", F.map_from_entries("n.attrs").alias("attrs"))
    e = g.select("packet_id", F.explode("g.edges").alias("e")).select("packet_id", "e.src", "e.dst", "e.type", "e.via", F.map_from_entries("e.attrs").alias("attrs"))
    return n, e


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def summary(verdicts: DataFrame, most: int = 1200) -> DataFrame:
    """packet_id, summary: claims by absolute margin with label and margin, cut at ``most`` characters."""
    line = F.concat(F.col("label"), F.lit(": "), F.substring("text", 1, 120), F.lit(" ("), F.format_number(F.coalesce("margin", F.lit(0.0)), 2), F.lit(")"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(-F.abs(F.coalesce("margin", F.lit(0.0))).alias("m"), "claim_id", line.alias("l")))), lambda x: x["l"])
    return verdicts.groupBy("packet_id").agg(F.substring(F.array_join(lines, "\n"), 1, most).alias("summary"))
