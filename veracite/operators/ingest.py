"""Raw files to ordered, citable units.

Order decides ids, winners and ties, so it is data: layer_ord, file_ord and unit_ord say where a unit stands. Everything
here partitions by source, and each source's rows are shuffled once; later windows and groups over the same key reuse it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions import text as T
from ..sources import markup
from ..sources.files import whole_texts

LEAST, MOST = 200, 2200


def part_units(paragraphs: DataFrame, layer_ord: int = 0) -> DataFrame:
    """UNIT rows from PARAGRAPH rows: a marked paragraph starts a subsection, those without a mark go on with it.

    Roman numerals look like letters and start subsections too, so a citation may repeat in a section: it is no key.
    Paragraphs before the first mark are a unit without a letter. A marked paragraph without further text gives no text.
    """
    p = paragraphs.withColumn("letter", T.subsection(F.col("text"))).withColumn("text", T.without_marker(F.col("text")))
    w = Window.partitionBy("source_id", "sec_ord").orderBy("para_ord")
    p = p.withColumn("grp", F.sum(F.col("letter").isNotNull().cast("int")).over(w))
    key = ["source_id", "part", "part_title", "sec_ord", "section", "section_heading", "citation", "grp"]
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_ord", "text"))), lambda x: x["text"]), " ")
    u = p.groupBy(*key).agg(F.max("letter").alias("subsection"), T.strip(body).alias("text"))
    return u.withColumns({
        "jurisdiction": F.lit("US-federal"), "status": F.lit("in_force"), "layer_ord": F.lit(layer_ord), "file_ord": F.col("source_id"),
        "unit_ord": F.col("sec_ord").cast("long") * (1 << 20) + F.col("grp"),
    }).select(*schemas.UNIT_COLUMNS)


def fold_small(rows: DataFrame, key: list[str], order: str, body: str, least: int = LEAST) -> DataFrame:
    """Bodies shorter than `least` join the row before them, unless they are the first of their key.

    Gives key, order (of the row that took them), its other columns, `head` (its own body) and `tails` (those that joined).
    """
    w = Window.partitionBy(*key).orderBy(order)
    starts = (F.length(body) >= least) | (F.row_number().over(w) == 1)
    r = rows.withColumn("starts", starts).withColumn("fold", F.sum(F.col("starts").cast("int")).over(w))
    others = [c for c in rows.columns if c not in (*key, order, body)]
    tails = F.transform(F.array_sort(F.collect_list(F.when(~F.col("starts"), F.struct(order, body)))), lambda x: x[body])
    first = lambda c: F.max(F.when(F.col("starts"), F.col(c))).alias(c)
    return r.groupBy(*key, "fold").agg(F.min(order).alias(order), *[first(c) for c in others], F.max(F.when(F.col("starts"), F.col(body))).alias("head"), tails.alias("tails")).drop("fold")


def labelled_blocks(texts: DataFrame, least_label: int = 80) -> DataFrame:
    """(source_id, grp, label, body): the blocks of each cleaned text (source_id, text), grouped under section labels.

    A block is a label's if it starts with a section number and is longer than `least_label` characters; shorter headings
    are text. Blocks before the first label have none.
    """
    b = texts.select("source_id", F.posexplode(T.blocks(F.col("text"))).alias("ord", "block"))
    b = b.withColumn("mark", T.section_label(F.col("block"), least_label))
    w = Window.partitionBy("source_id").orderBy("ord")
    b = b.withColumn("grp", F.sum(F.col("mark").isNotNull().cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda x: x["block"]), " ")
    return b.groupBy("source_id", "grp").agg(F.max("mark").alias("label"), T.strip(body).alias("body"))


def text_units(texts: DataFrame, meta: DataFrame, layer_ord: int = 1, least: int = LEAST, most: int = MOST, least_label: int = 80) -> DataFrame:
    """UNIT rows from cleaned, reflowed texts (source_id, text) and their metadata (SOURCE rows, few: one per source)."""
    groups = fold_small(labelled_blocks(texts, least_label), ["source_id"], "grp", "body", least)
    pieces = groups.select("source_id", "grp", "label", "tails", T.split_long(F.col("head"), most).alias("pieces"))
    n = F.size("pieces")
    last = T.strip(F.array_join(F.concat(F.array(F.element_at("pieces", -1)), F.col("tails")), " "))
    joined = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.concat(F.slice("pieces", F.lit(1), n - 1), F.array(last)))
    u = pieces.select("source_id", "grp", "label", F.posexplode(joined).alias("piece", "text"))
    own = meta.select(F.col("id").alias("source_id"), "name", F.coalesce("jurisdiction", F.lit("unknown")).alias("jurisdiction"), F.coalesce("status", F.lit("in_force")).alias("status"))
    u = u.join(own, "source_id")
    cite = F.when(F.col("label").isNotNull(), F.concat("name", F.lit(" § "), "label")).otherwise(F.col("name"))
    return u.select(
        "source_id", F.col("source_id").alias("part"), F.col("name").alias("part_title"), F.coalesce("label", F.lit("")).alias("section"), F.lit("").alias("section_heading"),
        cite.alias("citation"), F.lit(None).cast("string").alias("subsection"), "text", "jurisdiction", "status", F.lit(layer_ord).alias("layer_ord"), F.col("source_id").alias("file_ord"),
        (F.col("grp").cast("long") * (1 << 20) + F.col("piece")).alias("unit_ord"),
    )


def text_sources(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, meta, residuals) of a folder's .txt files and their .meta.json sidecars; residuals counts unexplained glyphs."""
    raw = whole_texts(spark, folder, ".txt")
    meta = spark.read.schema(schemas.SOURCE).json(f"{folder.rstrip('/')}/*.meta.json", multiLine=True)
    stems = spark.read.text(f"{folder.rstrip('/')}/*.meta.json", wholetext=True).select(F.expr("regexp_replace(_metadata.file_name, '[.]meta[.]json$', '')").alias("stem"), F.get_json_object("value", "$.id").alias("source_id"))
    named = raw.join(stems, "stem")
    texts = named.select("source_id", T.reflow(T.normalise(F.col("value"))).alias("text"))
    residuals = named.select("source_id", T.residual_ligatures(F.col("value")).alias("residual")).where("residual > 0")
    return texts, meta, residuals


def corpus_units(spark: SparkSession, xml_folder: str, text_folder: str) -> DataFrame:
    """All units: the federal parts, then the texts, each in order of their files."""
    texts, meta, _ = text_sources(spark, text_folder)
    return part_units(markup.parts(spark, xml_folder)).unionByName(text_units(texts, meta))
