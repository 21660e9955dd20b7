"""python -m veracite build|ask|search|serve|evaluate|validate|stats --index FOLDER ..., or fetch --manifest FILE --out FOLDER"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import evaluate as E
from .operators import index as I
from .operators import stats
from .service import Service
from .sources import manifests
from .sources.files import exists, write_bytes
from .web import server


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="veracite", description=__doc__)
    p.add_argument("what", choices=["fetch", "build", "ask", "search", "serve", "evaluate", "validate", "stats"])
    p.add_argument("question", nargs="?")
    p.add_argument("--index")
    p.add_argument("--manifest", help="JSON file that names the sources to fetch")
    p.add_argument("--kind", help="fetch sources of this kind only")
    p.add_argument("--port", type=int, default=8000)
    p.add_argument("--xml", help="folder of .xml parts")
    p.add_argument("--texts", help="folder of .txt sources with .meta.json beside them")
    p.add_argument("--golden", help="JSON lines of golden questions")
    p.add_argument("--out", help="folder for latest.json and baseline.json")
    p.add_argument("-k", type=int, default=5)
    p.add_argument("--no-multihop", action="store_true")
    p.add_argument("--set-baseline", action="store_true")
    a = p.parse_args(argv)
    for name in ("manifest", "out") if a.what == "fetch" else ("index",):
        if not getattr(a, name):
            p.error(f"--{name} is required")
    spark = SparkSession.builder.appName("veracite").getOrCreate()
    if a.what == "fetch":
        return fetched(manifests.fetch(spark, manifests.manifest(spark, a.manifest, a.kind), a.out))
    if a.what == "serve":
        server(Service(spark, a.index), port=a.port).serve_forever()
    if a.what == "build":
        print(I.build(spark, a.xml, a.texts, a.index).count(), "chunks")
        return 0
    if a.what in ("ask", "search"):
        print(json.dumps(getattr(Service(spark, a.index), a.what)(a.question or "", a.k), indent=2))
        return 0
    index = I.load(spark, a.index)
    if a.what == "stats":
        stats.chunk_stats(index).orderBy("source_id").show(1000, False)
        own = index.select(F.explode("source_ids").alias("source"), F.col("ord").alias("doc_id"), F.col("body").alias("text"))
        stats.bodies_by_source(own).orderBy("body_key", "source").show(1000, False)
        return 0
    golden = E.golden(spark, a.golden)
    if a.what == "validate":
        problems = E.golden_problems(golden, index).orderBy("id").collect()
        for r in problems:
            print(f"[{r.id}] {r.kind}: {r.wanted}")
        return int(bool(problems))
    return gate(spark, E.evaluate(I.with_vectors(golden, "question"), index, a.k, not a.no_multihop).cache(), a.k, a.out, a.set_baseline)


def fetched(status) -> int:
    """Prints the outcome of each source; gives 1 if one failed."""
    status = status.cache()
    for r in status.collect():  # one row per source of a manifest
        print(f"{r.id}: {r.bytes} bytes" if r.ok else f"{r.id}: {r.error}")
    total = manifests.fetch_summary(status).first()
    print(f"{total.n_ok} of {total.n} sources fetched" + (f"; unresolved: {total.unresolved}" if total.unresolved else ""))
    return int(total.n_ok < total.n)


def gate(spark: SparkSession, scores, k: int, out: str | None, set_baseline: bool = False) -> int:
    """Prints the report, keeps the run in latest.json, and gives 1 if it is worse than baseline.json."""
    print(E.report(scores, k))
    found = E.metrics(scores)
    if not out:
        return 0
    run = {"k": k, "metrics": [r.asDict() for r in found.collect()], "questions": [json.loads(x) for x in scores.toJSON().collect()]}
    write_bytes(spark, f"{out}/latest.json", json.dumps(run, indent=1).encode())
    base = f"{out}/baseline.json"
    if set_baseline:
        write_bytes(spark, base, json.dumps(run, indent=1).encode())
        return 0
    if not exists(spark, base):
        return 0
    before = spark.read.json(base, multiLine=True).select(F.explode("metrics").alias("m")).select("m.*")
    worse = E.compare(found, before).collect()
    for r in worse:
        print(f"worse: {r.scope} {r.metric}: {r.base} before, {r.value} now")
    return int(bool(worse))


if __name__ == "__main__":
    sys.exit(main())
