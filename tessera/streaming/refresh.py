"""Scheduled refresh: new answers of a model are merged into the documents they belong to, version by version.

A run takes all answers that have come since the last one (trigger availableNow, which an external schedule starts) and
writes the documents of that batch as one version. A batch that is run again writes the same version again, so a lost
run does no harm; readers take the last complete version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.knowledge import enrich


def current(spark: SparkSession, out: str, base: DataFrame, before: int | None = None) -> DataFrame:
    """file_name, doc of the last version in `out` (older than `before`), or of the documents it started from."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [] if not system.exists(path) else [s.getPath() for s in system.listStatus(path)]
    versions = [int(p.getName().split("=")[1]) for p in done if p.getName().startswith("version=") and system.exists(p.suffix("/_SUCCESS"))]
    versions = [v for v in versions if before is None or v < before]
    return spark.read.parquet(f"{out}/version={max(versions)}").select("file_name", "doc") if versions else base.select("file_name", "doc")


def refresh(answers: DataFrame, base: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """answers: stream of at, file_name, answer. The last answer to a file in a batch counts; a document without one, or
    with one that is not sound, stays as it was, with the reason in `error`."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("file_name").agg(F.max_by("answer", F.struct("at", "answer")).alias("answer"))
        merged = enrich(current(spark, out, base, number), last)
        merged.select("file_name", "doc", "error").write.mode("overwrite").parquet(f"{out}/version={number}")

    return answers.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
