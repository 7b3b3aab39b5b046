"""Token counts through a cache of digests.

Texts become digests of their normalised content; digests that the cache of this
tokenizer version lacks are encoded, once per distinct digest, and appended.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import batch_of, map_arrow, save, texts
from pitchframe.llm.vocabularies import encoder, id_column

CACHE = "digest binary, n_tokens long"


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row of ``docs``.

    ``tokenizer`` is a vocabulary file that executors can read, ``cache`` a
    shared folder that calls may use again. Where the tokenizer ignores how much
    blank space stands between words, such texts share a digest.

    Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows
    and null keys each keep their row; an empty table gives no row; other columns
    of ``docs`` are ignored, whatever their names. Only text of distinct misses
    is shuffled, spread by key and digest, so copies don't meet in one task.
    """
    spark = docs.sparkSession
    code = encoder(tokenizer)
    stored = os.path.join(cache, f"tokenizer={code.version}")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(stored)
    content = F.regexp_replace("text", "[ \\n]+", " ") if code.blank_safe else F.col("text")
    rows = texts(docs, id_col, text_col).withColumn("digest", F.unhex(F.sha2(content, 256)))
    keyed = save(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    known = spark.read.schema(CACHE).parquet(stored)
    first = keyed.groupBy("digest").agg(F.min("doc_id").alias("first_id")).join(known.select("digest"), "digest", "left_anti")
    chosen = first.select(F.col("digest").alias("miss"), "first_id")
    misses = rows.join(chosen, (F.col("digest") == F.col("miss")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("digest", "text")
    kinds = {"digest": pa.binary(), "n_tokens": pa.int64()}

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(kinds, {"digest": batch.column("digest").to_pylist(), "n_tokens": [len(ids) // 4 for ids in id_column(encoder(tokenizer), batch.column("text"))]})

    map_arrow(misses, count, CACHE).write.mode("append").parquet(stored)
    counts = spark.read.schema(CACHE).parquet(stored).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
