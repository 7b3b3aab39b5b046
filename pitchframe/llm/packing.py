"""Best-fit packing planned on the histogram of lengths.

Documents become pieces of at most ``capacity`` tokens. The plan sees only how
many pieces have each length (at most ``capacity`` rows) and places them longest
first into the fullest sequence that still has room, whole runs of equal
sequences at a time. Pieces then take the planned slots by their rank within
their length.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import batch_of, map_arrow, save, texts
from pitchframe.llm.vocabularies import encoder, id_column

PIECES = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
STEP = 2_000_000  # bytes of text whose distinct words are encoded together
RUNS = "length long, first_rank long, n long, layers long, first_sequence long, base long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and ``end_id``, cut every ``capacity`` ids."""
    end = end_id.to_bytes(4, "little")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {name: [] for name in PIECES}
        for key, ids in zip(batch.column("doc_id").to_pylist(), id_column(encoder(tokenizer), batch.column("text")), strict=True):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for name, value in zip(PIECES, (key, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    out[name].append(value)
        return batch_of(PIECES, out)

    rows = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_arrow(rows, cut, "doc_id long, piece int, start long, length long, ids_crc32 long", STEP)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, first rank, n, layers, first sequence, base)`` of a best-fit-decreasing packing of ``counts``.

    Rank ``r`` of a run stands in sequence ``first sequence + r mod n`` at offset
    ``base + length * (r div n)``. Sequences with equal room are interchangeable
    and kept as ranges of numbers, so the work follows the number of lengths and
    not the number of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left: ranges (first sequence, how many)
    rooms: list[int] = []
    runs, opened = [], 0

    def give(left: int, first: int, n: int) -> None:
        if left:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo and (at := bisect_left(rooms, length)) < len(rooms):
            left = rooms[at]
            first, n = room[left].pop()
            if not room[left]:
                del room[left], rooms[at]
            used = min(n, todo)
            runs.append((length, rank, used, 1, first, capacity - left))
            if n > used:
                give(left, first + used, n - used)
            give(left - length, first, used)
            rank, todo = rank + used, todo - used
        per = capacity // length
        for sequences, layers in ((todo // per, per), (1, todo % per)):
            if sequences and layers:
                runs.append((length, rank, sequences, layers, opened, 0))
                give(capacity - layers * length, opened, sequences)
                rank, opened = rank + sequences * layers, opened + sequences
    return runs


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of :func:`token_pieces` with ``sequence_id`` and ``offset``.

    The driver sees one count per length. A rank within a length is a row number
    within one of about sqrt(count) random parts of that length plus the sizes of
    the parts before it, so a length that a third of all pieces share is split
    evenly. The broadcast tables have at most ``capacity`` rows and the runs of
    the plan, whose number is checked.

    Defined cases: a null text counts as empty and becomes one piece that holds
    ``end_id`` alone; repeated rows are pieces of their own; rows with a null key
    are kept; an empty table gives no row; other columns are ignored.
    """
    spark = docs.sparkSession
    cut = save(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    counts = {length: n for length, n in cut.groupBy("length").count().collect()}
    runs = spark.createDataFrame(plan(counts, capacity), RUNS)
    runs = F.broadcast(runs) if len(counts) <= 20_000 else runs
    parts = spark.createDataFrame([(length, math.isqrt(n - 1) + 1) for length, n in counts.items()], "length long, parts long")
    dealt = cut.join(F.broadcast(parts), "length").withColumn("part", F.expr("pmod(xxhash64(doc_id, piece, ids_crc32), parts)"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(own) - 1).join(offsets.select("length", "part", "before"), ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("before"))
    place = F.col("rank") - F.col("first_rank")
    return (
        ranked.join(runs, "length")
        .where((place >= 0) & (place < F.col("n") * F.col("layers")))
        .select(
            *PIECES,
            (F.col("first_sequence") + place % F.col("n")).alias("sequence_id"),
            (F.col("base") + F.col("length") * F.expr("(rank - first_rank) div n")).alias("offset"),
        )
    )
