"""Importance resampling towards a target distribution, by hashed features.

Texts are split by an untrained pre-tokenizer into words with offsets; windows
over neighbouring offsets are the features, and the CRC of a feature names its
bucket. Buckets are counted over the whole corpus and the whole target. A
bucket's gain is the logarithm of its smoothed share there over its share here;
a document weighs the mean gain of its features, and a Gumbel number hashed from
its id turns the best weights into a draw without replacement that a lost task
repeats exactly.

Each text is split once: the buckets of its features are written, two bytes each
(four above 65,536 buckets), and counting and weighing read those.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import map_arrow, save, ship, texts
from pitchframe.llm.vocabularies import Memo
from pitchframe.operators.ordered import ROWS_PER_TASK, Ordered

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCALE = 1000
FEATURE_BYTES = 8_000_000  # of written features that a step holds at a time; a longer single document is taken alone


class Features:
    """``buckets(text)``: the bucket of each run of ``shortest`` to ``longest`` words, all of one length after the other."""

    def __init__(self, shortest: int, longest: int, buckets: int):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True).pre_tokenize_str
        self.lengths, self.n = range(shortest, longest + 1), buckets
        self.kind = np.uint16 if buckets <= 2**16 else np.uint32
        self.alone = Memo(lambda word: zlib.crc32(word.encode()))
        self.joined = Memo(lambda word: b" " + word.encode())

    def buckets(self, text: str) -> tuple[int, np.ndarray]:
        """The number of words and the buckets of all features of ``text``."""
        lowered = text.encode().lower().decode()
        words = [lowered[start:end] for _, (start, end) in self.split(lowered)]
        sums = list(map(self.alone.__getitem__, words))
        out = []
        for length in range(1, self.lengths[-1] + 1):
            if length > 1:  # a window grows by the word at its far end
                sums = [zlib.crc32(self.joined[word], so_far) for so_far, word in zip(sums, words[length - 1 :], strict=False)]
            if length in self.lengths:
                out.append(np.array(sums, np.uint32) % np.uint32(self.n))
        return len(words), np.concatenate(out).astype(self.kind)


_features: dict[tuple, Features] = {}


def _features_of(rule: tuple[int, int, int]) -> Features:
    if rule not in _features:
        _features[rule] = Features(*rule)
    return _features[rule]


def hashed(docs: DataFrame, rule: tuple[int, int, int]) -> DataFrame:
    """``doc_id, n_words, buckets`` (little-endian bytes) of each row of ``docs`` (``doc_id, text``)."""

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [_features_of(rule).buckets(text) for text in batch.column("text").to_pylist()]
        columns = [batch.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array([b.tobytes() for _, b in made], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "buckets"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, convert, f"doc_id {kind}, n_words long, buckets binary")


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, raw bytes and sizes of the column ``buckets``, for runs of rows of bounded size."""
    column = batch.column("buckets").cast(pa.large_binary())
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1])
    first = 0
    while first < len(sizes):
        held = np.cumsum(sizes[first:])
        last = first + max(1, int(np.searchsorted(held, FEATURE_BYTES, "right")))
        raw = np.frombuffer(b"".join(column.slice(first, last - first).to_pylist()), np.uint8)
        yield first, last, raw, sizes[first:last]
        first = last


def counts(features: DataFrame, rule: tuple[int, int, int]) -> np.ndarray:
    """How many features fall into each bucket: summed per partition, then over partitions; at most one row per bucket returns."""
    n, kind = rule[2], np.dtype(np.uint16 if rule[2] <= 2**16 else np.uint32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for _, _, raw, _ in _steps(batch):
                total += np.bincount(raw.view(kind), minlength=n)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    ship(features.sparkSession)
    rows = features.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(n, np.int64)
    for row in rows:
        out[row["bucket"]] = row["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Per bucket ``SCALE`` times the logarithm of its add-one share in the target over that in the source, rounded down."""
    n, total, everything = len(source), int(target.sum()), int(source.sum())
    share = lambda t, s: ((t + 1.0) * (everything + n)) / ((s + 1.0) * (total + n))
    return np.array([math.floor(SCALE * math.log(share(float(t), float(s)))) for t, s in zip(target, source, strict=True)], np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each row: the mean gain of its features, rounded down, 0 without any."""
    kind = np.dtype(np.uint16 if len(gain) <= 2**16 else np.uint32)
    shared = features.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, raw, sizes in _steps(batch):
                n = sizes // kind.itemsize
                running = np.concatenate([[0], np.cumsum(shared.value[raw.view(kind)])])
                ends = np.cumsum(n)
                sums = running[ends] - running[ends - n]
                weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
                part = batch.slice(first, last - first)
                columns = [part.column("doc_id"), part.column("n_words"), pa.array(n, pa.int64()), pa.array(weight, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    ship(features.sparkSession)
    id_type = features.schema["doc_id"].dataType.simpleString()
    return features.mapInArrow(weigh, f"doc_id {id_type}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """``SCALE`` times a Gumbel number hashed from the id, rounded down; a null id counts as an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(2**32)
    return F.floor(-F.lit(float(SCALE)) * F.log(-F.log(uniform)))


def _ranked(rows: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """Add ``rank`` to the ``percent`` of the eligible rows with the highest scores, ties to smaller ids.

    Scores are counted first: gains and Gumbel numbers are thousandths within
    fixed bounds, so there are at most some ten thousands of them whatever the
    table. They give the score at which the draw ends and how many rows lie above
    each score; only drawn rows and those at that score are then ordered, score by
    score, and a score that very many rows share is split.
    """
    tally = sorted(((r["score"], r["n"]) for r in rows.where(eligible).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted = percent * sum(n for _, n in tally) // 100
    above, held = [], 0
    for score, n in tally:
        if held >= wanted:
            break
        above.append((score, held))
        held += n
    if not above:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    last = above[-1][0]
    drawn = eligible & (F.col("score") >= last)
    offsets = rows.sparkSession.createDataFrame(above, "of long, above long")
    few = max(n for _, n in tally) <= ROWS_PER_TASK
    tied = Ordered(rows.where(drawn).withColumn("no_id", F.col("doc_id").isNull()), ["score"], ["no_id", "doc_id", "n_features", "weight", "n_words"], bounded=few)
    ranked = tied.row_number("place").build().join(F.broadcast(offsets), F.col("score") == F.col("of"))
    number = F.col("place") + F.col("above")
    ranked = ranked.select(*rows.columns, F.when(number <= wanted, number).cast("long").alias("rank"))
    return ranked.unionByName(rows.where(~drawn).withColumn("rank", F.lit(None).cast("long")))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    lengths: tuple[int, int] = (1, 2),
    buckets: int = 10_000,
    percent: int = 10,
    min_words: int = 20,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of each row; ``rank`` is null for documents that are not drawn.

    Of the documents with ``min_words`` words, ``percent`` are drawn; rows below
    that still get their score. ``target`` is a corpus of the wanted kind.

    Defined cases: a null or empty text has no features and weighs 0; rows that
    repeat an id draw the same Gumbel number and are ordered by their features,
    so equal rows have neighbouring ranks; a null id is hashed as an empty string
    and comes last among ties; without any target text the gains only compare
    buckets with a uniform share; an empty table gives no row; other columns are
    ignored, whatever their names.
    """
    rule = (lengths[0], lengths[1], buckets)
    features = save(hashed(texts(docs, id_col, text_col), rule), "features")
    wanted = hashed(target.select(F.lit(0).alias("doc_id"), F.coalesce(F.col(target_text_col), F.lit("")).alias("text")), rule)
    weights = weighed(features, gains(counts(wanted, rule), counts(features, rule)))
    rows = save(weights.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "weights")
    return _ranked(rows, F.col("n_words") >= min_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
