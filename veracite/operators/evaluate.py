"""Retrieval metrics over golden questions, and the gate that compares them with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .answer import compose
from .retrieve import ABSTAIN_BELOW, search, two_stage, with_rows

TOLERANCE = 0.02


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions from a file of JSON lines; blank lines don't count."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schemas.GOLDEN).alias("g")).select("g.*")


def matches(matcher: Column, citations: Column, source_ids: Column) -> Column:
    """Whether a result is the evidence that a matcher asks for; a matcher of no known kind raises."""
    part = F.exists(citations, lambda c: F.contains(c, matcher["citation_contains"]))
    return (
        F.when(matcher["citation"].isNotNull(), F.array_contains(citations, matcher["citation"]))
        .when(matcher["citation_contains"].isNotNull(), part)
        .when(matcher["source_id"].isNotNull(), F.array_contains(source_ids, matcher["source_id"]))
        .otherwise(F.raise_error(F.lit("unrecognised matcher")).cast("boolean"))
    )


def question_scores(questions: DataFrame, results: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per question (id, type, question, expect): hit, recall, reciprocal_rank, abstained, correct, top_score, top_citations, withdrawn_in_top.

    results: (query_id, rank, score, citations, source_ids, status); answers: (query_id, refused). A question whose right
    answer is to decline is correct if it was refused; any other if all its evidence was found and it wasn't.
    """
    asked = questions.select(F.col("id").alias("query_id"), "type", "question", "expect")
    wanted = asked.where(~F.col("type").isin(schemas.ABSTAIN_TYPES)).select("query_id", F.posexplode("expect").alias("m", "matcher"))
    pairs = wanted.join(results, "query_id", "left")
    ok = F.when(F.col("rank").isNotNull(), matches(F.col("matcher"), F.col("citations"), F.col("source_ids")))
    per_matcher = pairs.groupBy("query_id", "m").agg(F.min(F.when(ok, F.col("rank"))).alias("at"))
    found = per_matcher.groupBy("query_id").agg(F.avg(F.col("at").isNotNull().cast("double")).alias("recall"), F.min("at").alias("first"))
    top = results.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"), F.max(F.when(F.col("rank") == 1, F.col("citations"))).alias("top_citations"), F.bool_or(F.col("status") != "in_force").alias("withdrawn_in_top"))
    s = asked.join(found, "query_id", "left").join(top, "query_id", "left").join(answers.select("query_id", F.col("refused").alias("abstained")), "query_id")
    recall = F.coalesce("recall", F.lit(0.0))
    declines = F.col("type").isin(schemas.ABSTAIN_TYPES)
    return s.select(
        F.col("query_id").alias("id"), "type", "question", F.col("first").isNotNull().alias("hit"), recall.alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), "abstained",
        F.when(declines, F.col("abstained")).otherwise((recall == 1.0) & ~F.col("abstained")).alias("correct"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
        F.coalesce("top_citations", F.array().cast("array<string>")).alias("top_citations"), F.coalesce("withdrawn_in_top", F.lit(False)).alias("withdrawn_in_top"),
    )


def metrics(scores: DataFrame) -> DataFrame:
    """METRIC rows: overall and by_type.<type>; a metric without questions to measure is absent. One pass, by grouping sets."""
    declines = F.col("type").isin(schemas.ABSTAIN_TYPES)
    mean = lambda c, over: F.round(F.avg(F.when(over, F.col(c).cast("double"))), 4)
    g = scores.groupingSets([["type"], []], "type").agg(
        F.grouping("type").alias("whole"), F.count("*").cast("double").alias("n"), mean("correct", F.lit(True)).alias("correct"), mean("hit", ~declines).alias("hit@k"),
        mean("recall", ~declines).alias("recall@k"), mean("reciprocal_rank", ~declines).alias("mrr"), mean("abstained", declines).alias("abstain_rate"),
    )
    names = ["n", "correct", "hit@k", "recall@k", "mrr", "abstain_rate"]
    long = g.where("n > 0").select(F.when(F.col("whole") == 1, F.lit("overall")).otherwise(F.concat(F.lit("by_type."), "type")).alias("scope"), F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(f"`{x}`").alias("value")) for x in names])).alias("m"))
    return long.select("scope", "m.metric", "m.value").where("value is not null")


def compare(current: DataFrame, baseline: DataFrame, tolerance: float = TOLERANCE, missing: bool = True) -> DataFrame:
    """(scope, metric, base, value, delta): what fell by more than the tolerance. A metric that the baseline lacks is no
    problem; one that the current run lacks is, with a null value, unless missing is False."""
    b = baseline.select("scope", "metric", F.col("value").alias("base"))
    j = current.where("metric <> 'n'").join(b.where("metric <> 'n'"), ["scope", "metric"], "right" if missing else "inner")
    delta = F.col("value") - F.col("base")
    return j.withColumn("delta", delta).where((F.col("delta") < -tolerance) | F.col("value").isNull()).select("scope", "metric", "base", "value", "delta")


def evaluate(questions: DataFrame, index: DataFrame, k: int = 5, multihop: bool = True, threshold: float = ABSTAIN_BELOW) -> DataFrame:
    """Question scores of golden questions with embeddings (id, type, question, expect, embedding); all in one batch."""
    asked = questions.withColumnRenamed("id", "query_id")
    found = two_stage(index, asked, k) if multihop else search(index, asked, k)
    answers = compose(asked, index, k, found, threshold)
    return question_scores(questions, with_rows(found, index, ["citations", "source_ids", "status"]), answers)


def items_in(text: Column, items: list[str]) -> Column:
    """Those of a block of items that a text contains, as an array."""
    return F.filter(F.array(*map(F.lit, items)), lambda x: F.contains(text, x))


def _listed_pairs(rows: DataFrame, text: str, items: DataFrame, block: int) -> DataFrame | None:
    """rows with each `item` that their text contains, by blocks of items and one scan each; None without items."""
    out, held = None, []

    def scan():
        found = rows.withColumn("item", F.explode(items_in(F.col(text), held)))
        return found if out is None else out.union(found)

    for r in items.toLocalIterator():
        held.append(r.item)
        if len(held) == block:
            out, held = scan(), []
    return scan() if held else out


def contained_pairs(rows: DataFrame, text: str, items: DataFrame, block: int = 200) -> DataFrame:
    """rows with each `item` that their text contains, for items (item) of any number.

    An item of three words or more (what stands between single spaces) meets the texts by an anchor, the longest word
    that isn't at its ends: a text that contains the item has that very word. Digests of texts are joined with anchors by
    word, then texts with the pairs found, and only those are searched. Items of one or two words go to the rows in
    blocks of fixed size, one scan each; there nothing is joined.
    """
    items = items.where("item is not null").select("item").distinct()
    words = F.split("item", " ", -1)
    inner = F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    placed = items.withColumn("anchor", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w), w.alias("word"))))["word"])
    keyed = rows.withColumn("__text", F.sha2(F.col(text), 256))
    found = keyed.select("__text", F.explode(F.array_distinct(F.split(F.col(text), " ", -1))).alias("anchor"))
    pairs = found.join(placed.where("anchor is not null"), "anchor").select(F.col("__text").alias("__of"), "item").distinct()
    met = keyed.join(pairs, F.col("__text") == F.col("__of")).where(F.contains(F.col(text), F.col("item"))).select(*rows.columns, "item")
    short = _listed_pairs(rows, text, placed.where("anchor is null").select("item"), block)
    return met if short is None else met.unionByName(short)


def contained(rows: DataFrame, text: str, items: DataFrame) -> DataFrame:
    """(item): the items that some row's text contains."""
    return contained_pairs(rows, text, items).select("item").distinct()


def golden_problems(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, kind, wanted): evidence that no chunk can give, questions without evidence, matchers of no known kind.

    Citations and sources are made distinct before they meet the questions, which are a stated set of a few dozen.
    """
    m = questions.select("id", "type", F.explode_outer("expect").alias("m")).select("id", "type", F.col("m").isNull().alias("none"), "m.*")
    cites = chunks.select(F.explode("citations").alias("c")).distinct()
    sources = chunks.select(F.explode("source_ids").alias("s")).distinct()
    exact = m.where("citation is not null").join(cites, F.col("citation") == F.col("c"), "left_anti").select("id", F.lit("citation").alias("kind"), F.col("citation").alias("wanted"))
    needles = m.where("citation is null and citation_contains is not null")
    part = needles.join(contained(cites, "c", needles.select(F.col("citation_contains").alias("item"))), F.col("citation_contains") == F.col("item"), "left_anti").select("id", F.lit("citation_contains").alias("kind"), F.col("citation_contains").alias("wanted"))
    source = m.where("citation is null and citation_contains is null and source_id is not null").join(sources, F.col("source_id") == F.col("s"), "left_anti").select("id", F.lit("source_id").alias("kind"), F.col("source_id").alias("wanted"))
    none = m.where(F.col("none") & ~F.col("type").isin(schemas.ABSTAIN_TYPES)).select("id", F.lit("none").alias("kind"), F.lit(None).cast("string").alias("wanted"))
    odd = m.where("not none and citation is null and citation_contains is null and source_id is null").select("id", F.lit("unrecognised").alias("kind"), F.lit(None).cast("string").alias("wanted"))
    return exact.union(part).union(source).union(none).union(odd)


def matcher_kinds(questions: DataFrame) -> DataFrame:
    """(kind, n): how many matchers there are of each kind; none: questions without evidence."""
    m = questions.select(F.explode_outer("expect").alias("m"))
    kind = F.when(F.col("m").isNull(), "none").when(F.col("m.citation").isNotNull(), "citation").when(F.col("m.citation_contains").isNotNull(), "citation_contains").when(F.col("m.source_id").isNotNull(), "source_id").otherwise("unrecognised")
    return m.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def report(scores: DataFrame, k: int) -> str:
    """The results as text: overall, by type, and what failed. Golden questions are few."""
    table: dict[str, dict[str, float]] = {}
    for r in metrics(scores).collect():
        table.setdefault(r.scope, {})[r.metric] = r.value
    names = ["correct", "hit@k", "recall@k", "mrr", "abstain_rate"]
    rows = [f"{'scope':<28}{'n':>5}" + "".join(f"{x:>14}" for x in names)]
    for scope in sorted(table, key=lambda s: (s != "overall", s)):
        m = table[scope]
        rows.append(f"{scope.removeprefix('by_type.'):<28}{m['n']:>5.0f}" + "".join(f"{m[x]:>14.3f}" if x in m else f"{'-':>14}" for x in names))
    failed = scores.where(~F.col("correct")).orderBy("id").collect()
    for s in failed:
        why = "answered instead of declining" if s.type in schemas.ABSTAIN_TYPES else "declined an answerable question" if s.abstained else f"recall {s.recall:.2f}"
        rows.append(f"[{s.id}] {s.type}: {why}; found {list(s.top_citations[:2])} at {s.top_score:.3f}; asked: {s.question[:78]}")
    return "\n".join([f"{sum(1 for _ in failed)} of {table.get('overall', {}).get('n', 0):.0f} questions failed (k = {k})", *rows])
