"""Document fingerprints: a Merkle tree over sections, paragraphs and the sentences in them, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A leaf: up to 200 code points without an end of sentence, then what ends it. Leaves together are the paragraph.
LEAF = r"[^.!?]{1,200}[.!?]*|[.!?]+"
#: Hex digits of a leaf that a fingerprint shows.
SHOWN = 12
#: Documents that stand between two borders of ``next_rows``, and the most borders that the driver holds.
ROWS_BETWEEN, MOST_BORDERS = 1000, 16384


def tree(text: Column) -> Column:
    """struct<root, sections array<struct<hash, paragraphs array<struct<hash, leaves array<string>>>>>> of a text.

    Sections stand between blank lines, paragraphs are lines. Splitting loses nothing and each level is hashed with
    its own mark, so roots are equal exactly where texts are. Null counts as empty.
    """

    def paragraph(p: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.sha2(x, 256))
        return F.struct(F.sha2(F.concat(F.lit("p"), F.array_join(leaves, "")), 256).alias("hash"), F.transform(leaves, lambda x: F.substring(x, 1, SHOWN)).alias("leaves"))

    def section(s: Column) -> Column:
        return F.transform(F.split(s, "\n", -1), paragraph)

    bare = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), section)
    sections = F.transform(bare, lambda ps: F.struct(F.sha2(F.concat(F.lit("s"), F.array_join(F.transform(ps, lambda p: p["hash"]), "")), 256).alias("hash"), ps.alias("paragraphs")))
    root = lambda ss: F.sha2(F.concat(F.lit("r"), F.array_join(F.transform(ss, lambda s: s["hash"]), "")), 256)
    return F.transform(F.array(sections), lambda ss: F.struct(root(ss).alias("root"), ss.alias("sections")))[0]


def leaves(t: Column) -> Column:
    """The shown leaf hashes of a tree, in order."""
    return F.flatten(F.flatten(F.transform(t["sections"], lambda s: F.transform(s["paragraphs"], lambda p: p["leaves"]))))


def fingerprint(t: Column) -> Column:
    """Root, a colon, then the shown leaves: sections apart by ``;``, paragraphs by ``,``."""
    par = lambda p: F.array_join(p["leaves"], "")
    return F.concat(t["root"], F.lit(":"), F.array_join(F.transform(t["sections"], lambda s: F.array_join(F.transform(s["paragraphs"], par), ",")), ";"))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, 0 to 1: 1 for equal roots, else the share of the larger set of different leaves that both have."""
    shown = lambda f: F.array_distinct(F.regexp_extract_all(F.substring(f, 66, 1 << 30), F.lit(f"[0-9a-f]{{{SHOWN}}}"), F.lit(0)))
    return likeness_of(F.substring(a, 1, 64), shown(a), F.substring(b, 1, 64), shown(b))


def likeness_of(root_a: Column, set_a: Column, root_b: Column, set_b: Column) -> Column:
    both = F.size(F.array_intersect(set_a, set_b)).cast("double")
    most = F.greatest(F.size(set_a), F.size(set_b))
    return F.when(root_a == root_b, F.lit(1.0)).when(most == 0, F.lit(0.0)).otherwise(both / most)


def differing(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph>> (from 0) of the paragraphs where two trees part; equal branches are not entered."""

    def hashes(t: Column, k: Column) -> Column:
        return F.coalesce(F.transform(F.get(t["sections"], k)["paragraphs"], lambda p: p["hash"]), F.array().cast("array<string>"))

    def places(k: Column) -> Column:
        x, y = hashes(a, k), hashes(b, k)
        n = F.greatest(F.size(x), F.size(y))
        apart = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i)))
        same = F.get(a["sections"], k)["hash"].eqNullSafe(F.get(b["sections"], k)["hash"])
        return F.when(same, F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(F.transform(apart, lambda i: F.struct(k.alias("section"), i.alias("paragraph"))))

    most = F.greatest(F.size(a["sections"]), F.size(b["sections"]))
    return F.flatten(F.transform(F.sequence(F.lit(0), most - 1), places))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, root and fingerprint of each row's whole text; null texts count as empty, repeated rows stay."""
    t = df.select(F.col(id_col), tree(F.col(text_col)).alias("__tree"))
    return t.select(F.col(id_col), F.col("__tree.root").alias("root"), fingerprint(F.col("__tree")).alias("fingerprint"))


def next_rows(df: DataFrame, id_col: str, carry: list[str], derive=None) -> DataFrame:
    """Each row with ``next_<c>`` of the row that follows by id (ties: by the carried columns); after the last, the first.

    The table is dealt out by id into runs of about ``ROWS_BETWEEN`` rows (more where ``MOST_BORDERS`` borders don't
    suffice; a run is sorted on disk if need be). Borders are ids that occur, so the first row of a run is known by
    its id alone and goes to the run before as well: one exchange, no global order. Rows of a null id come last.
    ``derive(df)`` adds columns after the exchange, before the order is used; they can be carried too.
    """
    ids = df.select(F.col(id_col).alias("i"))
    n = ids.agg(F.count("*").alias("n"), F.count("i").alias("some")).first()
    if not n["n"]:
        k = 1
    else:
        k = min(MOST_BORDERS, max(1, n["n"] // ROWS_BETWEEN))
    borders = ids.agg(F.percentile_approx("i", [j / k for j in range(k)], 4 * k).alias("b")).first()["b"] if n["some"] else []
    least = ids.agg(F.min("i").alias("i")).first()["i"] if n["some"] else None
    borders = sorted({least, *borders}) if n["some"] else []
    runs = len(borders) + (n["n"] > n["some"])
    kind = df.schema[id_col].dataType.simpleString()
    own = F.lit(max(0, len(borders)))
    if borders:
        held = F.array(*[F.lit(b).cast(kind) for b in borders])
        steps = F.array(*[F.lit(1 << s) for s in range(len(borders).bit_length() - 1, -1, -1)])
        find = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s < len(borders)) & (F.get(held, at + s) <= F.col(id_col)), at + s).otherwise(at))
        own = F.when(F.col(id_col).isNull(), own).otherwise(find)
    rows = df.withColumn("__run", own).withColumn("__tail", F.lit(False))
    opens = F.col(id_col).isin(borders) if len(borders) <= 10 else F.get(held, F.col("__run")) == F.col(id_col)
    if n["n"] > n["some"]:
        opens = F.coalesce(opens, F.lit(False)) | F.col(id_col).isNull() if borders else F.lit(True)
    elif not borders:
        opens = F.lit(True)
    # the first row of a run closes the run before; of several with its id only the first by order counts, the others do no harm
    into = F.array(F.struct(F.col("__run").alias("r"), F.lit(False).alias("t")), F.struct(F.pmod(F.col("__run") - 1, F.lit(max(1, runs))).alias("r"), F.lit(True).alias("t")))
    rows = rows.withColumn("__to", F.when(opens, into).otherwise(F.slice(into, 1, 1)))
    rows = rows.select("*", F.explode("__to").alias("__x")).withColumn("__run", F.col("__x.r")).withColumn("__tail", F.col("__x.t")).drop("__to", "__x")
    rows = rows.repartition("__run")
    rows = derive(rows) if derive else rows
    order = Window.partitionBy("__run").orderBy(F.col("__tail"), F.col(id_col).asc_nulls_last(), *[F.col(c) for c in carry])
    rows = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carry])
    return rows.where(~F.col("__tail")).drop("__run", "__tail")


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The edited text has the last floor(n_chars / 2) code points replaced by as many from the start of the next
    document's text (or all, if it is shorter). Null texts count as empty: their edited text is empty too. Repeated ids
    are told apart by text; rows equal in both follow each other. A single document is its own next. Other columns are
    left out. Texts move once, to the run of their id.
    """
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))

    def derive(x: DataFrame) -> DataFrame:
        return x.withColumn("__tree", tree(F.col("__t"))).select("*", fingerprint(F.col("__tree")).alias("__f"), F.array_distinct(leaves(F.col("__tree"))).alias("__l")).drop("__tree")

    rows = next_rows(rows, id_col, ["__t", "__f", "__l"], derive)
    n = F.length("__t").cast("long")
    kept = (n - F.floor(n / 2)).cast("int")
    edited = F.concat(F.substring(F.col("__t"), F.lit(1), kept), F.substring(F.col("next___t"), F.lit(1), F.floor(n / 2).cast("int")))
    rows = rows.select(F.col(id_col), n.alias("n_chars"), edited.alias("__e"), "__f", "__l", F.col("next___f").alias("__nf"), F.col("next___l").alias("__nl"))
    rows = rows.withColumn("__tree", tree(F.col("__e")))
    rows = rows.select("*", fingerprint(F.col("__tree")).alias("__ef"), F.array_distinct(leaves(F.col("__tree"))).alias("__el")).drop("__tree")
    root = lambda f: F.substring(f, 1, 64)
    return rows.select(
        F.col(id_col), "n_chars", F.sha2("__e", 256).alias("edited_sha256"), F.col("__f").alias("fingerprint"), F.col("__ef").alias("edited_fingerprint"),
        likeness_of(root(F.col("__f")), F.col("__l"), root(F.col("__ef")), F.col("__el")).alias("near_edited"),
        likeness_of(root(F.col("__f")), F.col("__l"), root(F.col("__nf")), F.col("__nl")).alias("near_next"),
    )
