"""Token counts (3): a cache of counts by content digest and tokenizer version.

Every text is replaced by the SHA-256 of its normalised content (computed in the JVM). The digests are joined to the
stored counts of this tokenizer version; one text of each digest without a count is encoded, and the new counts are
appended to the cache before the documents are joined to it. An append is one directory of Parquet files that Spark
commits as a whole, so a lost executor leaves no half-written counts, and counts written twice are equal.

Only digests go through shuffles, with one exception: texts that are encoded are read straight from the scan, unless
several rows share the digest; then each task sends one of its rows, and one of those is encoded. Which digests are
known or shared is broadcast up to a counted number of them and joined by a shuffle beyond it.

Normalisation must not change counts, so the default only turns null into the empty text; a caller with a tokenizer
that ignores, say, case may pass a Column function.

Defined cases: null counts as the empty text (0 bytes, 0 tokens). Repeated rows are each returned. An empty table
gives an empty result and appends nothing. Only doc_id and text of the input are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.cluster import cut, discard, key_join, new_folder, prepare, tidied

CACHE = "digest binary, version string, n_tokens long"
LIMIT = 512
#: Digests that are broadcast at most: 32 bytes each.
FEW = 300_000


def with_null_as_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def encode_counts(texts: DataFrame, name: str) -> DataFrame:
    """digest, n_tokens of rows of digest, text."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, at in tokens.encode(batch.column("text"), name):
                yield pa.RecordBatch.from_arrays([batch.column("digest").slice(block.first, len(block)), pa.array(np.diff(at))], ["digest", "n_tokens"])

    return texts.mapInArrow(run, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, cache: str | None = None, name: str = tokens.BPE, limit: int = LIMIT, normalise: Callable[[Column], Column] = with_null_as_empty) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs. cache: folder of stored counts, made if absent."""
    spark = prepare(docs.sparkSession)
    cache = cache or new_folder(spark, "token-cache")
    version = tokens.version(name)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("raw"), normalise(F.col("text")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    sizes = cut(keyed.select("doc_id", "digest", F.octet_length("raw").cast("long").alias("n_bytes")), "token-digests")
    asked = cut(sizes.groupBy("digest").agg((F.count("*") > 1).alias("shared")), "token-asked", tidy=False)

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    known = None
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        hits = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).join(asked.select("digest"), "digest", "left_semi")
        known = cut(hits.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-known", tidy=False)

    # The misses: read from the scan, but for digests of several rows, of which one row a task is sent.
    texts = keyed.select("digest", "text")
    missing = asked if known is None else cut(asked.join(known.select("digest"), "digest", "left_anti"), "token-missing", tidy=False)
    twice = missing.where("shared").select("digest")
    skip = twice if known is None else cut(known.select("digest").unionByName(twice), "token-skip", tidy=False)
    if known is None or skip.count() <= missing.count():
        alone = key_join(texts, skip, ["digest"], "left_anti", rows=FEW)
    else:
        alone = key_join(texts, missing.where("not shared").select("digest"), ["digest"], "left_semi", rows=FEW)
    shared = key_join(texts, twice, ["digest"], "left_semi", rows=FEW)
    shared = shared.groupBy("digest").agg(F.any_value("text").alias("text"))
    encoded = cut(encode_counts(alone, name).unionByName(encode_counts(shared, name)), "token-counts")
    encoded.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)

    # Both sides of the join are tables, and nothing stands between their shuffles and the join: AQE splits a hot digest.
    counts = encoded
    if known is not None:
        counts = cut(known.unionByName(encoded), "token-all", tidy=False)
        discard(known, missing, skip, encoded)
    discard(asked)
    return sizes.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
