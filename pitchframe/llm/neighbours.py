"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are dealt to the lists of a coarse quantiser and cut into blocks of a
fixed number of rows. Within each probed list they are scanned in a randomly
rotated space, a few columns at a time: after each block of columns a hypothesis
test compares the partial distance with the best so far and abandons candidates
that are almost surely farther. Survivors get their exact distance on the
original vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import save, ship

SAMPLE_ROWS = 20_000  # vectors the quantiser is fitted on, at most: the least by a hash of the vector
MAX_LISTS = 1024
PROBED = 0.7  # share of the lists that a query looks into; embeddings without cluster structure need most of them
ROWS_PER_BLOCK, QUERIES_PER_BLOCK = 4096, 512
COLUMNS = 16  # of one step of the scan
EPSILON = 2.4  # of the test: larger abandons later
FIRST, CHUNK = 64, 1024


def _kmeans(sample: np.ndarray, k: int) -> np.ndarray:
    random = np.random.Generator(np.random.PCG64(11))
    centres = sample[np.sort(random.choice(len(sample), k, replace=False))]
    for _ in range(12):
        nearest = (np.square(centres).sum(1) - 2 * sample @ centres.T).argmin(axis=1)
        counts = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
    return centres


def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(5)).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def scan(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """``query, vector, distance`` of the nearest ``k`` per query among ``vectors`` other than the query's own id; ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    size = vectors.shape[1]
    turn = rotation(size)
    turned, turned_queries = np.ascontiguousarray((vectors @ turn).T), queries @ turn
    out = []
    for query, own, probe in zip(queries, query_ids, turned_queries, strict=True):
        best_ids, best = np.zeros(0, np.int64), np.zeros(0)
        limit = np.inf
        for at in [0, *range(FIRST, len(ids), CHUNK)]:
            alive = np.arange(at, min(at + (CHUNK if at else FIRST), len(ids)))
            alive = alive[ids[alive] != own]
            partial = np.zeros(len(alive))
            for column in range(0, size if np.isfinite(limit) else 0, COLUMNS):
                upto = min(column + COLUMNS, size)
                partial += np.square(turned[column:upto, alive] - probe[column:upto, None]).sum(axis=0)
                slack = (1 + EPSILON / math.sqrt(upto)) ** 2 if upto < size else 1 + 1e-9
                stays = partial <= limit * upto / size * slack + 1e-12
                alive, partial = alive[stays], partial[stays]
            if len(alive):
                exact = np.sqrt(np.square(vectors[alive] - query).sum(axis=1))
                best_ids, best = np.concatenate([best_ids, ids[alive]]), np.concatenate([best, exact])
                chosen = np.lexsort((best_ids, best))[:k]
                best_ids, best = best_ids[chosen], best[chosen]
                if len(best) == k:
                    limit = best[-1] ** 2
        out += [(int(own), int(i), float(d)) for i, d in zip(best_ids, best, strict=True)]
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` (doubles) of the rows with a key and a finite, non-zero vector of the commonest length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).dropna()
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists("vector", lambda x: x != 0))
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (length["n"] if length else 0))


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", probed: float = PROBED) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row for which the condition ``is_query`` on ``vec_id`` holds.

    Every row is indexed; the quantiser alone is fitted on a bounded sample. A
    list is cut into blocks of ``ROWS_PER_BLOCK`` rows by a hash of the id and
    its queries into blocks too, so neither a common vector nor a large query set
    meets in one task. Driver and broadcasts hold the centres, at most
    ``MAX_LISTS``, and the size of each list.

    Defined cases: null, zero or non-finite vectors, vectors of another length
    than the commonest and null ids take no part; rows that repeat an id count
    once (the least vector); with fewer than ``k`` candidates all are returned if
    their lists are probed; an empty table gives no row; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = save(rows, "vectors")
    n = rows.count()
    lists = max(1, min(MAX_LISTS, round(math.sqrt(n) / 2)))
    drawn = rows.withColumn("draw", F.xxhash64("vec_id"))
    sample = drawn.where((F.col("draw") / 2.0**63 + 1) / 2 < min(1.0, SAMPLE_ROWS / max(n, 1))).select("vector").collect() if n else []
    found = "query_id long, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([row["vector"] for row in sample] or [rows.first()["vector"]])
    centres = _kmeans(sample, min(lists, len(sample)))
    lists = len(centres)
    probes = max(1, math.ceil(probed * lists))
    shared = spark.sparkContext.broadcast(centres)

    def ranked(batches, n_lists: int):
        for batch in batches:
            points = np.stack(batch.column("vector").to_numpy(zero_copy_only=False))
            far = np.square(shared.value).sum(1) - 2 * points @ shared.value.T
            chosen = np.argsort(far, axis=1, kind="stable")[:, :n_lists]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(chosen.astype(np.int32)), pa.list_(pa.int32()))], names=["vec_id", "vector", "lists"]
            )

    kinds = "vec_id long, vector array<double>, lists array<int>"
    placed = save(rows.mapInArrow(lambda b: ranked(b, 1), kinds).select("vec_id", "vector", F.col("lists")[0].alias("list")), "placed")
    asking = rows.where(is_query).mapInArrow(lambda b: ranked(b, probes), kinds).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), F.explode("lists").alias("list"))
    asking = save(asking, "probes")
    sizes = placed.groupBy("list").agg(F.count("*").alias("n")).join(asking.groupBy("list").agg(F.count("*").alias("q")), "list")
    cuts = F.broadcast(sizes.select("list", F.ceil(F.col("n") / ROWS_PER_BLOCK).cast("int").alias("parts"), F.ceil(F.col("q") / QUERIES_PER_BLOCK).cast("int").alias("query_parts")))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    part = lambda key, count: F.expr(f"cast(pmod(xxhash64({key}), {count}) as int)")
    blocks = placed.join(cuts, "list").select("list", part("vec_id", "parts").alias("part"), every("query_parts").alias("query_part"), "vec_id", "vector")
    queries = asking.join(cuts, "list").select("list", every("parts").alias("part"), part("query_id", "query_parts").alias("query_part"), "query_id", "query")
    key = ["list", "part", "query_part"]

    def search(block: pd.DataFrame, probe: pd.DataFrame) -> pd.DataFrame:
        if block.empty or probe.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        hits = scan(np.stack(probe["query"]), probe["query_id"].to_numpy(), np.stack(block["vector"]), block["vec_id"].to_numpy(), k)
        return pd.DataFrame(hits, columns=["query_id", "vec_id", "score"])

    hits = blocks.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(search, found)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
