"""Units to chunks: one for each unit, or windows of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions import text as T
from ..storage import numbered, running_sums


def _chunk(**columns: Column) -> list[Column]:
    return [columns[c].alias(c) for c in schemas.CHUNK_COLUMNS]


def structural(units: DataFrame) -> DataFrame:
    """A chunk for each unit, with the citation header in the embedded text; ids count the units of the whole corpus."""
    u = numbered(units, "ord", "layer_ord", "file_ord", "unit_ord")
    cite = T.full_citation(F.col("citation"), F.col("subsection"))
    embedded = F.concat(T.header(F.col("part_title"), F.col("section_heading"), cite, F.col("status")), F.lit("\n\n"), F.col("text"))
    return u.select(*_chunk(
        chunk_id=F.concat("source_id", F.lit(":C:"), F.col("ord").cast("string")), strategy=F.lit("structural"), embed_text=embedded, body=F.col("text"), source_id=F.col("source_id"), citations=F.array(cite),
        n_tokens=T.token_estimate(embedded), jurisdiction=F.col("jurisdiction"), status=F.col("status"), source_ids=F.array("source_id"), statuses=F.array("status"), jurisdictions=F.array("jurisdiction"), ord=F.col("ord"),
    ))


def fixed_windows(units: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Windows over the words of each source, `size` and `overlap` in tokens; each cites all units that it touches.

    No source's words are gathered: running sums of the numbers of words place each unit, each unit gives its share of the
    windows it touches, and a window is put together from those, so a group holds no more than a window. Only units and
    windows are keys of texts. Units that tie in unit_ord follow each other by text. A window has the status and the
    jurisdiction of its first unit, and `statuses` and `jurisdictions` of all.
    """
    step, width = T.window_sizes(size, overlap)
    # One column as the key: null sources and orders are equal in it.
    u = units.withColumn("text", T.squash(F.coalesce("text", F.lit("")))).withColumn("key", F.struct("source_id", "unit_ord"))
    words = F.split("text", " ")
    n = F.when(F.col("text") == "", 0).otherwise(F.size(words))
    sizes = u.groupBy("key").agg(F.sum(n).alias("n")).where("n > 0")
    places = running_sums(sizes.select("key.source_id", "key.unit_ord", "n"), "source_id", "unit_ord", "n")
    places = places.select(F.struct("source_id", "unit_ord").alias("key"), "before", "total")
    ties = Window.partitionBy("key").orderBy("text").rowsBetween(Window.unboundedPreceding, -1)
    u = u.withColumn("n", n).withColumn("tied", F.coalesce(F.sum("n").over(ties), F.lit(0))).join(places, "key")
    u = u.withColumn("at", F.col("before") + F.col("tied")).withColumn("upto", F.col("at") + F.col("n"))
    last = F.greatest(F.lit(0), F.ceil((F.col("total") - width) / F.lit(step)))
    lo = F.greatest(F.lit(0), F.floor((F.col("at") - width) / F.lit(step)) + 1)
    hi = F.when(F.col("n") > 0, F.least(last, F.floor((F.col("upto") - 1) / F.lit(step))))

    def share(k: Column) -> Column:
        a = F.greatest(F.lit(0), k * step - F.col("at")).cast("int")
        b = F.least(F.col("n"), k * step + width - F.col("at")).cast("int")
        return F.struct((k * step).alias("start"), F.array_join(F.slice("words", a + 1, b - a), " ").alias("text"))

    cite = T.full_citation(F.col("citation"), F.col("subsection"))
    shares = u.withColumns({"lo": lo, "hi": hi}).where("lo <= hi").withColumn("words", words)
    shares = shares.select("source_id", "at", cite.alias("cite"), "status", "jurisdiction", F.explode(F.transform(F.sequence("lo", "hi"), share)).alias("share"))
    g = shares.groupBy("source_id", F.col("share.start").alias("start")).agg(F.array_sort(F.collect_list(F.struct("at", "share.text", "cite", "status", "jurisdiction"))).alias("x"))
    each = lambda name: F.transform("x", lambda p: p[name])
    body = F.array_join(each("text"), " ")
    return g.select(*_chunk(
        chunk_id=F.concat("source_id", F.lit(":A:"), F.col("start").cast("string")), strategy=F.lit("fixed_window"), embed_text=body, body=body, source_id=F.col("source_id"), citations=F.array_distinct(each("cite")), n_tokens=T.token_estimate(body),
        jurisdiction=each("jurisdiction")[0], status=each("status")[0], source_ids=F.array("source_id"), statuses=F.array_distinct(each("status")), jurisdictions=F.array_distinct(each("jurisdiction")), ord=F.col("start").cast("long"),
    ))


def text_windows(docs: DataFrame, key: str, text: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """(key, start, body, n_tokens): windows over the words of each row's text by itself; rows aren't shuffled."""
    step, width = T.window_sizes(size, overlap)
    d = docs.select(key, T.words(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    d = d.select(key, "words", F.explode(T.window_starts(F.size("words"), step, width)).alias("start"))
    part = F.slice("words", F.col("start") + 1, F.lit(width))
    return d.select(key, "start", F.array_join(part, " ").alias("body"), (F.size(part) * F.lit(T.TOKENS_PER_WORD)).cast("int").alias("n_tokens"))
