"""What Python workers need: the package, which they find on this machine (on a cluster it is installed or shipped with
--py-files), and Arrow batches of bounded size."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: What one Arrow batch holds, at most so many rows and about so many bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def reachable(spark: SparkSession) -> None:
    """Lets Python workers find the package, and bounds the session's Arrow batches: by default one has 10,000 rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, path) if x)
