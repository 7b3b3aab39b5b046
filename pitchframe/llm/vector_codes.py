"""Vector codes by product quantisation in exact integer arithmetic.

Components become integers, vectors are cut into parts, and every part is
replaced by the index of its nearest codebook entry. Distances need the products
of all parts with all entries: integers are broken into limbs so small that a
matrix product of limbs in float64 stays below 2^53 and is exact, whatever order
the library adds in; the products are put together again in int64.

Each round is one pass over the vectors: a partition assigns its parts and adds
them up per entry, and sums of partitions meet in one aggregation of as many
groups as there are entries. Only codebooks reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import save, ship

SCALE = 256
STEP_NUMBERS = 1_000_000  # components, or distances to entries, that a step holds at a time


def usable(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False))), F.lit(False))


def limit(size: int) -> int:
    """The largest magnitude for which the squared distance of two vectors of ``size`` components fits in 64 bits."""
    return math.isqrt((2**61 - 1) // max(size, 1))


def limb_bits(width: int) -> int:
    """Bits of a limb: ``width`` products of two numbers up to 2^bits add up to at most 2^53."""
    return (53 - max(width - 1, 0).bit_length()) // 2


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of int64 matrices, exact wherever the result fits in 64 bits.

    A limb has so many bits that a sum of as many products as rows are long stays
    below 2^53. The lowest limbs are unsigned, the highest carries the sign.
    """
    bits = limb_bits(a.shape[1])

    def limbs(x: np.ndarray) -> list[np.ndarray]:
        out = []
        while True:
            if not x.size or (x.min() >= -(1 << bits) and x.max() <= 1 << bits):
                return [*out, x.astype(np.float64)]
            out.append((x & ((1 << bits) - 1)).astype(np.float64))
            x = x >> bits

    total = np.zeros((len(a), len(b)), np.int64)
    right = limbs(b)
    for i, low in enumerate(limbs(a)):
        for j, high in enumerate(right):
            total += (low @ high.T).astype(np.int64) << (bits * (i + j))
    return total


def assigned(vectors: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per vector and part the first nearest entry of ``codebooks`` (part, entry, place) and its squared distance."""
    parts, entries, width = codebooks.shape
    codes, far = np.empty((len(vectors), parts), np.int64), np.empty((len(vectors), parts), np.int64)
    for part in range(parts):
        own = np.ascontiguousarray(vectors[:, part * width : (part + 1) * width])
        book = codebooks[part]
        distance = (own * own).sum(axis=1)[:, None] - 2 * exact_products(own, book) + (book * book).sum(axis=1)
        codes[:, part] = distance.argmin(axis=1)
        far[:, part] = distance[np.arange(len(own)), codes[:, part]]
    return codes, far


def _matrices(batch: pa.RecordBatch, size: int, entries: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows and their integer vectors, of a bounded number of components."""
    step = max(1, STEP_NUMBERS // max(size, entries, 1))
    for first in range(0, batch.num_rows, step):
        part = batch.slice(first, step)
        yield part, part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, size)


def _sums(vectors: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``part, entry, n, s0, s1 ...``: how many parts an entry is nearest to, and their components added up."""
    parts, entries, width = codebooks.shape
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks)
    names = [f"s{i}" for i in range(width)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            for _, matrix in _matrices(batch, parts * width, entries):
                codes, _ = assigned(matrix, shared.value)
                flat = (codes + np.arange(parts) * entries).ravel()
                pieces = matrix.reshape(-1, width)
                order = np.argsort(flat, kind="stable")
                seen, first = np.unique(flat[order], return_index=True)
                total[seen] += np.add.reduceat(pieces[order], first, axis=0)
                count += np.bincount(flat, minlength=len(count))
        used = np.flatnonzero(count)
        columns = [pa.array(used // entries, pa.int64()), pa.array(used % entries, pa.int64()), pa.array(count[used], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns + [pa.array(total[used, i], pa.int64()) for i in range(width)], names=["part", "entry", "n", *names])

    schema = ", ".join(f"{name} long" for name in ["part", "entry", "n", *names])
    found = vectors.select("vector").mapInArrow(add, schema)
    return found.groupBy("part", "entry").agg(*[F.sum(name).alias(name) for name in ["n", *names]])


def trained(vectors: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray | None:
    """Codebooks (part, entry, place) of ``vectors`` (``vec_id, vector`` of integers of one length); None without any with an id."""
    start = vectors.where(F.col("vec_id").isNotNull()).orderBy("vec_id", "vector").limit(entries).collect()
    if not start:
        return None
    matrix = np.array([r["vector"] for r in start], np.int64)
    codebooks = np.ascontiguousarray(matrix.reshape(len(start), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        moved = codebooks.copy()
        for r in _sums(vectors, codebooks).collect():
            moved[r["part"], r["entry"]] = [total // r["n"] for total in r[3:]]
        codebooks = moved
    return codebooks


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of each row of ``vectors`` (``vec_id, label, vector``)."""
    parts, entries, width = codebooks.shape
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks)
    digits = 2 if entries <= 256 else 4

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, matrix in _matrices(batch, parts * width, entries):
                codes, far = assigned(matrix, shared.value)
                raw = codes.astype(">u1" if digits == 2 else ">u2").tobytes().hex()
                size = parts * digits
                texts = [raw[i * size : (i + 1) * size] for i in range(len(codes))]
                columns = [part.column("vec_id"), part.column("label"), pa.array(texts, pa.string()), pa.array(far.sum(axis=1), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select("vec_id", "label", "vector").mapInArrow(code, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")


def vector_codes(
    table: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of each row with a usable vector.

    Codebooks start as the parts of the vectors with the smallest ids; each round
    replaces an entry by the mean of the parts nearest to it, rounded down.

    Defined cases: rows whose vector is null or holds null or non-finite
    components have no row; a repeated row keeps its rows and counts each time;
    rows with a null id are coded but start no codebook; of equal smallest ids the
    smaller vectors come first; fewer vectors than entries give fewer entries. All
    vectors must have the length of the one with the smallest id, a multiple of
    ``parts``, and components so small that 64 bits hold any distance
    (:func:`limit`): other rows keep their row with a null code and error, and
    take no part. An empty table, or one without ids, gives null codes or no
    row; null labels are one label; other columns are ignored.
    """
    spark = table.sparkSession
    ship(spark)
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).where(usable(F.col(vector_col)))
    first = rows.where(F.col("vec_id").isNotNull()).groupBy().agg(F.min(F.struct("vec_id", F.size("vector").alias("size"))).alias("m")).first()["m"]
    size = first["size"] if first else 0
    fits = (F.size("vector") == size) & F.lit(size > 0 and size % parts == 0)
    small = F.forall("vector", lambda x: F.abs(x.cast("double") * SCALE) <= limit(size))
    regular = F.coalesce(fits & small, F.lit(False))
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    vectors = rows.where(regular).select("vec_id", "label", whole.alias("vector"))
    codebooks = trained(vectors, parts, entries, rounds)
    other = rows if codebooks is None else rows.where(~regular)
    done = other.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if codebooks is not None:
        done = coded(vectors, codebooks).unionByName(done)
    done = save(done, "codes")
    sums = done.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = done.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks) if codebooks is not None else None).cast("string").alias("codebooks_sha256"))
