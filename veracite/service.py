"""Single questions against a loaded index, as plain dictionaries; a web framework needs to do no more than call these."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import index as I
from .operators import retrieve
from .operators.answer import compose


def validated(question: str, k: int) -> None:
    """Raises ValueError unless the question has 3 to 2000 characters and k is from 1 to 20."""
    if not isinstance(question, str) or not 3 <= len(question) <= 2000:
        raise ValueError("a question has from 3 to 2000 characters")
    if not isinstance(k, int) or isinstance(k, bool) or not 1 <= k <= 20:
        raise ValueError("k is from 1 to 20")


class Service:
    """An index that is loaded when first needed. FileNotFoundError says that it hasn't been built."""

    def __init__(self, spark: SparkSession, path: str, encoder: I.Encoder = I.hashed_words, threshold: float = retrieve.ABSTAIN_BELOW):
        self.spark, self.path, self.encoder, self.threshold = spark, path, encoder, threshold
        self._index: DataFrame | None = None

    @property
    def index(self) -> DataFrame:
        if self._index is None:
            self._index = I.load(self.spark, self.path).cache()
        return self._index

    def _asked(self, question: str, k: int) -> DataFrame:
        validated(question, k)
        vector = [float(x) for x in self.encoder([question])[0]]
        return self.spark.createDataFrame([(0, question, vector)], "query_id long, question string, embedding array<float>")

    def health(self) -> dict:
        try:
            I.load(self.spark, self.path)
        except FileNotFoundError as e:
            return {"status": "degraded", "index": "missing", "detail": str(e)}
        m = I.meta(self.spark, self.path)
        return {"status": "ok", "index": "loaded", "chunks": m["n_chunks"], "model": m["model"]}

    def ask(self, question: str, k: int = 5) -> dict:
        row = compose(self._asked(question, k), self.index, k, threshold=self.threshold).drop("query_id")
        return json.loads(row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first().j)

    def search(self, question: str, k: int = 5, jurisdiction: str | None = None, include_withdrawn: bool = True) -> dict:
        found = retrieve.search(self.index, self._asked(question, k), k, jurisdiction, include_withdrawn)
        rows = retrieve.with_rows(found, self.index, ["citations", "jurisdiction", "status", "body"]).orderBy("rank").collect()  # k rows
        results = [{"rank": r.rank, "score": round(r.score, 4), "citations": list(r.citations), "jurisdiction": r.jurisdiction, "status": r.status, "excerpt": r.body[:300]} for r in rows]
        return {"question": question, "abstain": not rows or rows[0].score < self.threshold, "results": results}
