"""Cited answers for batches of questions, with refusals, disclosures and invariants that hold in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieve import ABSTAIN_BELOW, abstentions, two_stage, with_rows

ADVICE_REFUSAL = "Only what published rules say is reported here, with citations. Advice on a case, its prospects or what to do about it is legal advice, which takes a licensed attorney. Ask what a rule requires instead."
SCOPE_REFUSAL = "Nothing in the index answers this closely enough to be quoted."
WITHDRAWN = "At least one of the sources below has been withdrawn and is not current guidance. It is kept for reference only."
JURISDICTIONS = "The sources below belong to more than one jurisdiction (%s). Their obligations may differ, and several may apply at once."

CITATION = "struct<citations:array<string>,jurisdiction:string,status:string,excerpt:string,score:double>"
_RESULT = ["citations", "source_ids", "jurisdiction", "status", "body"]


def not_in_force(status: Column, statuses: Column | None = None) -> Column:
    """Whether a chunk has a source that isn't in force: its own status, or that of any member it was merged from."""
    own = status != "in_force"
    return own if statuses is None else own | F.coalesce(F.exists(statuses, lambda s: s != "in_force"), F.lit(False))


def disclosures(citations: Column, withdrawn: Column) -> Column:
    """The texts that an answer with these citations must carry: of withdrawn sources, then of several jurisdictions."""
    places = F.array_sort(F.array_distinct(F.transform(citations, lambda c: c["jurisdiction"])))
    several = F.when(F.size(places) > 1, F.format_string(JURISDICTIONS, F.array_join(places, ", ")))
    return F.filter(F.array(F.when(withdrawn, F.lit(WITHDRAWN)), several), lambda x: x.isNotNull())


def checked(answers: DataFrame) -> DataFrame:
    """answers, of which any that breaks an invariant raises when it is computed.

    An answer that isn't a refusal cites something; a refusal cites nothing; sources that aren't in force are disclosed.
    The check is part of `summary`, a column that is read, so it can't be pruned.
    """
    n = F.coalesce(F.size("citations"), F.lit(0))
    hidden = F.exists("citations", lambda c: c["status"] != "in_force") & ~F.array_contains("disclosures", WITHDRAWN)
    bad = F.when(~F.col("refused") & (n <= 0), F.lit("an answer that is not a refusal must cite a source")).when(F.col("refused") & (n > 0), F.lit("a refusal must not cite sources")).when(hidden, F.lit("withdrawn sources without the disclosure"))
    return answers.withColumn("summary", F.when(bad.isNotNull(), F.raise_error(bad).cast("string")).otherwise(F.col("summary")))


def refusals(questions: DataFrame, reason: Column) -> DataFrame:
    """Refusal rows for questions (query_id, question)."""
    none = F.array().cast(f"array<{CITATION}>")
    return questions.select("query_id", "question", F.lit(True).alias("refused"), reason.alias("refusal_reason"), reason.alias("summary"), none.alias("citations"), F.array().cast("array<string>").alias("disclosures"))


def compose(questions: DataFrame, index: DataFrame, k: int = 5, results: DataFrame | None = None, threshold: float = ABSTAIN_BELOW, advice: list[str] = T.ADVICE) -> DataFrame:
    """One answer per question: query_id, question, refused, refusal_reason, summary, citations, disclosures.

    questions has query_id, question and embedding. Questions for advice are refused before anything is searched. results:
    what was already found (query_id, rank, ord, score), so that no search runs twice.
    """
    asks = F.coalesce(T.asks_for_advice(F.col("question"), advice), F.lit(False))
    declined = refusals(questions.where(asks), F.lit(ADVICE_REFUSAL))
    rest = questions.where(~asks)
    found = two_stage(index, rest, k) if results is None else results.join(rest.select("query_id"), "query_id", "left_semi")
    judged = abstentions(rest, found, threshold)
    unknown = refusals(rest.join(judged.where("abstain"), "query_id", "left_semi"), F.lit(SCOPE_REFUSAL))
    extra = ["statuses"] if "statuses" in index.columns else []
    rows = with_rows(found.join(judged.where(~F.col("abstain")).select("query_id"), "query_id"), index, _RESULT + extra)
    gone = not_in_force(F.col("status"), F.col("statuses") if extra else None)
    cite = F.struct("citations", "jurisdiction", F.when(gone & (F.col("status") == "in_force"), F.lit("WITHDRAWN")).otherwise(F.col("status")).alias("status"), T.excerpt(F.col("body")).alias("excerpt"), F.round("score", 4).alias("score"))
    cited = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", cite.alias("cite")))), lambda x: x["cite"]).cast(f"array<{CITATION}>").alias("citations"), F.bool_or(gone).alias("gone"))
    lead = F.col("citations")[0]
    summary = F.concat(F.lit("The most relevant provision is "), F.array_join(lead["citations"], ", "), F.lit(". "), T.excerpt(lead["excerpt"], 260))
    answered = rest.select("query_id", "question").join(cited, "query_id").select("query_id", "question", F.lit(False).alias("refused"), F.lit(None).cast("string").alias("refusal_reason"), summary.alias("summary"), "citations", disclosures(F.col("citations"), F.col("gone")).alias("disclosures"))
    return checked(declined.union(unknown).union(answered))
