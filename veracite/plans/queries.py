"""The registered queries: each applies operators of the engine to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions import text as T
from ..functions import vectors as V
from ..operators import answer, chunk, dedup, evaluate, ingest, retrieve, stats
from ..operators import index as indexing
from ..storage import first_rows
from .catalog import table, vector_index, vector_queries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Similarity below which the vector questions are declined.
DECLINE = 0.35


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def joined(c: Column, by: str = "; ") -> Column:
    return F.array_join(c, by)


# nearest neighbours


@query
def knn_topk(spark, sf_dir):
    index = vector_index(spark, sf_dir)
    one = index.where("ord = 0").select(F.col("ord").alias("query_id"), "embedding")
    return retrieve.search(index, one, 10).select("rank", F.col("ord").alias("vec_id"), F.round("score", 4).alias("score"))


def _found(spark, sf_dir, k=5, **how):
    index = vector_index(spark, sf_dir)
    found = retrieve.nearest(retrieve.filtered(index, **how), vector_queries(index), k, ["query_id"], apart="query_id")
    return found.select("query_id", "rank", F.col("ord").alias("vec_id"), F.round("score", 4).alias("score"))


@query
def knn_batch(spark, sf_dir):
    return _found(spark, sf_dir)


@query
def knn_filtered(spark, sf_dir):
    return _found(spark, sf_dir, jurisdiction="j1")


@query
def knn_in_force(spark, sf_dir):
    return _found(spark, sf_dir, include_withdrawn=False)


@query
def knn_abstain(spark, sf_dir):
    index = vector_index(spark, sf_dir)
    q = vector_queries(index)
    found = retrieve.nearest(index, q, 1, ["query_id"], apart="query_id")
    return retrieve.abstentions(q, found, DECLINE).select("query_id", F.round("top_score", 4).alias("top_score"), "abstain")


def _two_stage(spark, sf_dir, k):
    index = vector_index(spark, sf_dir)
    found = retrieve.two_stage(index, vector_queries(index), k, apart="query_id")
    return found.select("query_id", "rank", F.col("ord").alias("vec_id"), F.round("score", 4).alias("score"), "hop")


@query
def knn_two_stage(spark, sf_dir):
    return _two_stage(spark, sf_dir, 5)


@query
def knn_two_stage_k2(spark, sf_dir):
    return _two_stage(spark, sf_dir, 2)


@query
def pool_probe(spark, sf_dir):
    """The sources of the three best results for each question."""
    index = vector_index(spark, sf_dir)
    found = retrieve.with_rows(retrieve.nearest(index, vector_queries(index), 3, ["query_id"], apart="query_id"), index, ["source_ids"])
    return found.groupBy("query_id").agg(joined(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source_ids"))), lambda x: x["source_ids"][0]), ", ").alias("sources"))


@query
def l2_norm_check(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 4).alias("norm"), F.round(V.norm(V.unit(F.col("embedding"))), 4).alias("unit_norm"))


# dedup


@query
def dedup_merge(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.sha2("text", 256).alias("body_sha"), F.col("doc_id").alias("ord"), F.array("source").alias("source_ids"))
    m = dedup.distinct_lists(d, "body_sha", "ord", ["source_ids"])
    return m.select("body_sha", F.col("first_ord").alias("first_doc"), F.col("n").alias("n_docs"), joined(F.array_sort("source_ids")).alias("sources"))


@query
def dedup_stats(spark, sf_dir):
    m = dedup_merge(spark, sf_dir)
    return m.agg(F.sum("n_docs").alias("n_docs"), F.count("*").alias("n_texts"), F.count_if(F.col("n_docs") > 1).alias("n_groups"), F.max("n_docs").alias("largest"), F.count_if(F.contains("sources", F.lit("; "))).alias("n_across"))


@query
def near_dup_pairs(spark, sf_dir):
    """Each document whose text another source has too, beside the last document of it there."""
    p = stats.bodies_elsewhere(docs(spark, sf_dir))
    return p.select(F.col("doc_id").alias("left_doc"), F.col("other_doc").alias("right_doc"), "body_key")


@query
def shared_bodies(spark, sf_dir):
    """The texts that sources of even and of odd numbers share; every source is on one of the sides."""
    d = docs(spark, sf_dir).select((F.regexp_extract("source", "[0-9]+", 0).cast("int") % 2 == 0).alias("even"), F.sha2("text", 256).alias("body_key"))
    return stats.shared_values(d.where("even"), d.where("not coalesce(even, false)"), "body_key")


def _halves(spark, sf_dir):
    """Documents with vectors as an index, in two parts: sources of even and of odd numbers."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.slice("embedding", 1, 16).alias("body_embedding"))
    d = docs(spark, sf_dir).join(e, "doc_id").withColumn("even", F.regexp_extract("source", "[0-9]+", 0).cast("int") % 2 == 0)
    d = d.select(F.col("doc_id").alias("ord"), F.col("text").alias("body"), "embedding", "body_embedding", F.array("source").alias("source_ids"), "even")
    return d.where("even"), d.where("not coalesce(even, false)")


@query
def header_check(spark, sf_dir):
    c = stats.header_check(*_halves(spark, sf_dir), 0.5)
    return c.select("variant", *[F.round(x, 4).alias(x) for x in ("mean", "least", "most")], "n_above", "n")


@query
def pair_pool_probe(spark, sf_dir):
    """The sources of the three best of a pool of two parts' equal bodies, for each question."""
    pool = stats.pair_pool(*_halves(spark, sf_dir), ["embedding", "source_ids"])
    found = retrieve.nearest(pool, vector_queries(vector_index(spark, sf_dir)), 3, ["query_id"])
    found = retrieve.with_rows(found, pool, ["source_ids"])
    return found.select("query_id", "rank", "ord", F.round("score", 4).alias("score"), F.col("source_ids")[0].alias("source"))


@query
def equal_bodies(spark, sf_dir):
    """The texts that any two sources share, with the last document and the number of them in each."""
    return stats.bodies_by_source(docs(spark, sf_dir))


@query
def likeness_by_label(spark, sf_dir):
    """Inner products of each question with its nearest neighbour: mean, least, most, and how many are above 0.5."""
    index = vector_index(spark, sf_dir)
    q = vector_queries(index)
    near = retrieve.with_rows(retrieve.nearest(index, q, 1, ["query_id"], apart="query_id"), index, ["embedding"])
    s = stats.likeness(near.join(q.select("query_id", F.col("embedding").alias("own")), "query_id"), F.col("own"), F.col("embedding"), 0.5)
    return s.select(*[F.round(c, 4).alias(c) for c in ("mean", "least", "most")], "n_above", "n")


# text


@query
def token_estimate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.token_estimate(F.col("text")).alias("n_tokens"))


@query
def chunk_stats(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.coalesce("source", F.lit("-")).alias("source"), T.token_estimate(F.col("text")).alias("n_tokens"))
    return stats.chunk_stats(d, "source")


@query
def fixed_windows(spark, sf_dir):
    w = chunk.text_windows(docs(spark, sf_dir), "doc_id", "text")
    return w.select("doc_id", "start", "n_tokens", F.sha2("body", 256).alias("body_sha"))


@query
def source_windows(spark, sf_dir):
    """Windows over all words of each source, documents in order, with the documents that each one cites."""
    u = docs(spark, sf_dir).select(
        F.col("source").alias("source_id"), F.lit("").alias("part"), F.lit("").alias("part_title"), F.lit("").alias("section"), F.lit("").alias("section_heading"), F.col("doc_id").cast("string").alias("citation"), F.lit(None).cast("string").alias("subsection"),
        "text", F.lit("x").alias("jurisdiction"), F.lit("in_force").alias("status"), F.lit(0).alias("layer_ord"), F.lit("").alias("file_ord"), F.col("doc_id").alias("unit_ord"),
    )
    w = chunk.fixed_windows(u)
    return w.select(F.col("source_id").alias("source"), F.col("ord").alias("start"), "n_tokens", F.array_join("citations", ",").alias("cited"), F.sha2("body", 256).alias("body_sha"))


@query
def reflow_paragraphs(spark, sf_dir):
    p = T.paragraphs(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", p.alias("p")).select("doc_id", F.size("p").cast("long").alias("n_paragraphs"), F.sha2(F.array_join("p", "\n\n"), 256).alias("text_sha"))


@query
def ligature_repair(spark, sf_dir):
    """Texts in which every fi, fl, ff and ft was lost, repaired from what stands around."""
    lost = F.regexp_replace("text", "(?i)f[filt]", "~")
    return docs(spark, sf_dir).select("doc_id", lost.alias("t")).select("doc_id", T.residual_ligatures(F.col("t"), "~").cast("long").alias("residual"), F.sha2(T.repair_ligatures(F.col("t"), "~"), 256).alias("text_sha"))


@query
def normalise_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(T.normalise(F.col("text")), 256).alias("text_sha"), F.sha2(T.squash(F.col("text")), 256).alias("squashed_sha"))


@query
def section_fold(spark, sf_dir):
    """Turns of a conversation as paragraphs: a user's turn starts a section, which the turns after it join."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("grp", F.sum((F.col("role") == "user").cast("long")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    return c.groupBy("conv_id", "grp").agg(F.count("*").alias("n_turns"), F.sha2(body, 256).alias("body_sha"))


@query
def part_units(spark, sf_dir):
    """Turns of a conversation as the paragraphs of a section: a user's turn is marked and starts a subsection."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("source_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    mark = F.when(F.col("role") == "user", F.concat(F.lit("("), F.chr(F.lit(97) + F.col("turn") % 26), F.lit(") "))).otherwise(F.lit(""))
    empty = F.lit("")
    p = c.select("source_id", empty.alias("part"), empty.alias("part_title"), F.lit(0).alias("sec_ord"), empty.alias("section"), empty.alias("section_heading"), empty.alias("citation"), F.col("turn").cast("int").alias("para_ord"), F.concat(mark, "text").alias("text"))
    return ingest.part_units(p).select("source_id", "unit_ord", "subsection", F.sha2("text", 256).alias("body_sha"))


@query
def labelled_blocks(spark, sf_dir):
    """Lines as blocks, every third with a section number: those of more than 80 characters label the blocks after them."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.when(i % 3 == 0, F.concat(F.lit("§ 5-"), i.cast("string"), F.lit(". A "))).otherwise(F.lit("")), x))
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("source_id"), F.array_join(lines, "\n\n").alias("text"))
    return ingest.labelled_blocks(d).select(F.col("source_id").alias("doc_id"), F.col("grp").cast("long").alias("grp"), "label", F.sha2("body", 256).alias("body_sha"))


@query
def size_fold(spark, sf_dir):
    """Turns shorter than 200 characters join the turn before them."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    f = ingest.fold_small(c, ["conv_id"], "turn", "text")
    return f.select("conv_id", "turn", (F.size("tails") + 1).cast("long").alias("n_turns"), F.sha2(F.array_join(F.concat(F.array("head"), F.col("tails")), " "), 256).alias("body_sha"))


@query
def label_carry(spark, sf_dir):
    """The role of the last turn that wasn't an assistant's, at each turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = F.when(F.col("role") != "assistant", F.concat(F.col("role"), F.col("turn").cast("string")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(own, ignorenulls=True).over(w).alias("label"))


@query
def long_split(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.posexplode(T.split_long(T.strip(F.col("text")))).alias("piece", "body"))
    return d.select("doc_id", "piece", F.length("body").cast("long").alias("n_chars"), F.sha2("body", 256).alias("body_sha"))


@query
def html_text(spark, sf_dir):
    t = T.squash(T.html_text(F.coalesce("html", F.lit(""))))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("t")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("text_sha"))


@query
def excerpt(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.excerpt(F.col("text")).alias("excerpt"), F.substring("text", 1, 300).alias("raw_excerpt"))


#: For texts without any question: words that stand for a request.
WORDS = [r"\bthe and\b", r"\bde la\b", r"\bder die\b"]


@query
def advice_filter(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    probe = spark.createDataFrame([(-1, 0, "Should I settle this?"), (-2, 0, "What must an audit state?"), (-3, 0, "CAN I SUE them"), (-4, 0, "shouldi sue")], "conv_id long, turn long, text string")
    return c.union(probe).select("conv_id", "turn", T.asks_for_advice(F.col("text"), T.ADVICE + WORDS).alias("declined"))


@query
def header_build(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = docs(spark, sf_dir).join(lab, "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "WITHDRAWN").otherwise("in_force")
    cite = T.full_citation(F.concat(F.lit("29 CFR "), F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 2 == 0, "a"))
    return d.select("doc_id", T.header(F.col("source"), F.col("lang"), cite, status).alias("header"))


@query
def citation_order(spark, sf_dir):
    """The citations of each language's sources, the widest scope first."""
    n = F.col("doc_id") % 3
    cite = F.concat(F.when(n == 0, "41 CFR ").when(n == 1, "29 CFR ").otherwise("10 Local "), F.col("source"))
    d = docs(spark, sf_dir).select("lang", F.col("doc_id").alias("ord"), F.array(cite).alias("citations"))
    return dedup.distinct_lists(d, "lang", "ord", ["citations"]).select("lang", joined(T.ordered_citations(F.col("citations"))).alias("citations"))


# answers


def _status(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs(spark, sf_dir).join(lab, "doc_id", "left").withColumn("status", F.when(F.col("toxic") == 1, "WITHDRAWN").otherwise("in_force"))


@query
def withdrawn_flag(spark, sf_dir):
    return _status(spark, sf_dir).groupBy("source").agg(F.bool_or(answer.not_in_force(F.col("status"))).alias("withdrawn"), F.count("*").alias("n"))


@query
def jurisdiction_disclosure(spark, sf_dir):
    """What answers that cite each source's documents must disclose, with languages for jurisdictions."""
    per = _status(spark, sf_dir).groupBy("source", "lang").agg(F.max_by("status", F.col("status") != "in_force").alias("status"))
    cites = per.groupBy("source").agg(F.collect_list(F.struct(F.col("lang").alias("jurisdiction"), "status")).alias("c"))
    found = answer.disclosures(F.col("c"), F.exists("c", lambda x: x["status"] != "in_force"))
    return cites.select("source", joined(found, " / ").alias("disclosures"))


@query
def compose_answers(spark, sf_dir):
    index = vector_index(spark, sf_dir)
    asked = vector_queries(index).withColumn("question", F.when(F.col("query_id") % 200 == 0, F.lit("Should I sue?")).otherwise(F.lit("What is required?")))
    found = retrieve.nearest(index, asked, 3, ["query_id"], apart="query_id")
    a = answer.compose(asked, index, 3, found, DECLINE)
    return a.select("query_id", "refused", "summary", joined(F.flatten(F.transform("citations", lambda c: c["citations"])), ", ").alias("cited"), joined("disclosures", " / ").alias("disclosures"))


# evaluation


def _scores(spark, sf_dir, k):
    """Questions whose evidence is any result of their own label; every seventh is one to decline."""
    index = vector_index(spark, sf_dir)
    q = vector_queries(index)
    expect = F.array(F.struct(F.lit(None).cast("string").alias("citation"), F.lit(None).cast("string").alias("citation_contains"), F.concat(F.lit("s"), F.col("label").cast("string")).alias("source_id")))
    kind = F.when(F.col("query_id") % 350 == 0, "out_of_scope").otherwise(F.concat(F.lit("type"), (F.col("label") % 3).cast("string")))
    golden = q.select(F.col("query_id").alias("id"), kind.alias("type"), F.lit("What is required?").alias("question"), expect.alias("expect"))
    found = retrieve.nearest(index, q, k, ["query_id"], apart="query_id")
    refused = retrieve.abstentions(q, found, DECLINE).select("query_id", F.col("abstain").alias("refused"))
    return evaluate.question_scores(golden, retrieve.with_rows(found, index, ["citations", "source_ids", "status"]), refused)


@query
def question_scores(spark, sf_dir):
    s = _scores(spark, sf_dir, 5)
    return s.select("id", "type", "hit", F.round("recall", 4).alias("recall"), F.round("reciprocal_rank", 4).alias("reciprocal_rank"), "abstained", "correct", F.round("top_score", 4).alias("top_score"), joined("top_citations").alias("top_citations"), "withdrawn_in_top")


@query
def eval_metrics(spark, sf_dir):
    return evaluate.metrics(_scores(spark, sf_dir, 5))


@query
def metric_compare(spark, sf_dir):
    now, before = evaluate.metrics(_scores(spark, sf_dir, 1)), evaluate.metrics(_scores(spark, sf_dir, 5))
    return evaluate.compare(now, before, 0.0).select("scope", "metric", "base", "value", F.round("delta", 4).alias("delta"))


def _benchmark_golden(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    none = F.lit(None).cast("string")
    n = F.col("item_id") % 4
    cite = F.when(n == 0, F.concat(F.lit("src"), F.col("item_id").cast("string")))
    part = F.when(n == 1, F.concat(F.lit("rc"), F.col("item_id").cast("string")))
    source = F.when(n == 2, F.concat(F.lit("src"), (F.col("item_id") % 7).cast("string")))
    expect = F.when(n == 3, F.array().cast(f"array<{schemas.MATCHER}>")).otherwise(F.array(F.struct(cite.alias("citation"), part.alias("citation_contains"), source.alias("source_id"))))
    return b.select("item_id", F.col("item_id").cast("string").alias("id"), F.lit("single_hop").alias("type"), "text", expect.alias("expect"), none.alias("why"))


@query
def golden_validate(spark, sf_dir):
    chunks = docs(spark, sf_dir).select(F.array("source").alias("citations"), F.array("source").alias("source_ids"))
    return evaluate.golden_problems(_benchmark_golden(spark, sf_dir), chunks)


@query
def matcher_kinds(spark, sf_dir):
    return evaluate.matcher_kinds(_benchmark_golden(spark, sf_dir))


@query
def benchmark_overlap(spark, sf_dir):
    """Documents that hold a whole benchmark text. Benchmark items are a stated set."""
    b = table(spark, sf_dir, "benchmark").where("length(text) > 0").select("item_id", F.col("text").alias("item"))
    hits = evaluate.contained_pairs(docs(spark, sf_dir).select("doc_id", "text"), "text", b.select("item")).select("doc_id", "item")
    return hits.join(b, "item").groupBy("doc_id").agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"))


# index


@query
def fingerprint(spark, sf_dir):
    d = docs(spark, sf_dir)
    own = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), T.token_estimate(F.col("text")).cast("string"), "text"), 256)
    return d.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(own, 1, 8), 16, 10).cast("long")).alias("checksum"))


@query
def index_fingerprint(spark, sf_dir):
    """The fingerprint of an index whose chunks are the documents."""
    n = T.token_estimate(F.col("text"))
    d = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("chunk_id"), n.alias("n_tokens"), F.col("text").alias("embed_text"))
    return indexing.fingerprints(d).withColumnRenamed("f", "fingerprint")


@query
def checked_index(spark, sf_dir):
    """Chunks beside their vectors; one without the other would raise."""
    e = table(spark, sf_dir, "embeddings")
    chunks = e.select(F.col("vec_id").alias("ord"), F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("chunk_id"))
    j = indexing.checked_index(chunks, e.select(F.col("vec_id").alias("ord"), "embedding"))
    return j.select("ord", "chunk_id", F.size("embedding").alias("dim"))


@query
def index_integrity(spark, sf_dir):
    """Documents without labels and labels without documents."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"))
    j = d.join(lab, F.col("doc_id") == F.col("label_id"), "full_outer")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("label_id").isNull()).alias("no_label"), F.count_if(F.col("doc_id").isNull()).alias("no_document"))


@query
def embed_text(spark, sf_dir):
    """Hashed vectors of all documents: their lengths. SQL has no such encoder, so there is no SQL for it."""
    d = indexing.with_vectors(docs(spark, sf_dir).select("doc_id", "text"), "text")
    return d.select("doc_id", F.size("embedding").alias("dim"), F.round(V.norm(F.col("embedding")), 4).alias("norm"))


@query
def top_per_source(spark, sf_dir):
    """The three documents of each source with the most tokens."""
    d = docs(spark, sf_dir).select("source", "doc_id", T.token_estimate(F.col("text")).alias("n_tokens"))
    return first_rows(d, ["source"], [F.desc("n_tokens"), F.col("doc_id")], 3).select("source", "rank", "doc_id", "n_tokens")
