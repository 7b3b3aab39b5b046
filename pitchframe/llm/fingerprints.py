"""Document fingerprints from closed syncmers.

A k-mer of characters is chosen when the smallest of its inner s-mers, by hash,
is the first or the last: a choice that depends on the k-mer alone, so equal
passages give equal anchors whatever surrounds them. A fingerprint is the
anchors with the least hashes, each with the place of its first occurrence.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import STEP_CHARS, ship, texts
from pitchframe.llm.words import _power_tables, mix

K, S, SIZE = 20, 10, 64

Anchors = dict[int, int]  # hash: place


def anchors(column: list[str], k: int = K, s: int = S, size: int = SIZE) -> list[Anchors]:
    """The fingerprint of each text; a text of fewer than ``k`` characters is one anchor, an empty one has none."""
    lengths = np.array([len(t) for t in column], np.int64)
    codes = np.frombuffer("".join(column).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    forward, backward = _power_tables(len(codes) + 1)
    running = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes + np.uint64(1)) * forward[: len(codes)], out=running[1:])

    def hashes(width: int) -> np.ndarray:
        n = max(len(codes) - width + 1, 0)
        return mix((running[width : width + n] - running[:n]) * backward[:n])

    inner, outer = hashes(s), hashes(k)
    span = k - s + 1
    least, width = inner, 1
    while width * 2 <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < span and len(inner) >= span:
        least = np.minimum(least[: len(inner) - span + 1], least[span - width : len(inner) - width + 1])
    n = len(outer)
    edge = (inner[:n] == least[:n]) | (inner[span - 1 : span - 1 + n] == least[:n])
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a < k:
            whole = mix((running[b : b + 1] - running[a]) * backward[a] + np.uint64(b - a))[0] if b > a else None
            out.append({} if whole is None else {int(whole >> np.uint64(32)): 0})
            continue
        places = np.flatnonzero(edge[a : b - k + 1])
        found = (outer[a : b - k + 1][places] >> np.uint64(32)).astype(np.int64)
        if len(found) > 8 * size:  # only the least can enter: look at those below a cut that leaves enough
            cut = np.partition(found, 4 * size)[4 * size]
            if len(np.unique(found[found <= cut])) >= size:
                places, found = places[found <= cut], found[found <= cut]
        least_found, where = np.unique(found, return_index=True)
        out.append(dict(zip(least_found[:size].tolist(), places[where[:size]].tolist(), strict=True)))
    return out


def written(found: Anchors) -> str:
    return ",".join(f"{h:08x}@{place}" for h, place in found.items())


def likeness(a: Anchors, b: Anchors, size: int = SIZE) -> float:
    """The share of common anchors among the least of both: an estimate of the Jaccard similarity. Two empty ones are alike."""
    if not a and not b:
        return 1.0
    least = sorted(a.keys() | b.keys())[:size]
    return sum(h in a and h in b for h in least) / len(least)


def shift(a: Anchors, b: Anchors) -> int | None:
    """How far the common anchors of ``b`` mostly stand from those of ``a``."""
    moves = Counter(b[h] - a[h] for h in a.keys() & b.keys())
    return min(moves, key=lambda m: (-moves[m], abs(m), m)) if moves else None


def _with_following(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``bucket, borrowed, doc_id, text`` sorted so that in a partition each own row stands before the next document's.

    Buckets are ranges of ids between quantiles that are ids themselves. The
    first document of a bucket is also lent to the bucket before (that of the
    first bucket to the last), so no bucket looks into another and every text is
    moved once.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5))
    least, cuts, chars = rows.agg(F.min("doc_id"), F.percentile_approx("doc_id", shares, 100_000), F.sum(F.octet_length("text"))).first()
    bounds = np.array(sorted({least, *cuts}) if least is not None else [], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = max(len(bounds) - 1, 0)
        for batch in batches:
            ids = batch.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            value = ids.fill_null(0).to_numpy()
            bucket = np.where(known, np.maximum(np.searchsorted(bounds, value, side="right") - 1, 0), 0).astype(np.int32)
            lent = np.flatnonzero(~known | np.isin(value, bounds))
            before = np.where(bucket[lent] == 0, last, bucket[lent] - 1).astype(np.int32)
            for chosen, to, borrowed in ((None, bucket, False), (lent, before, True)):
                part = batch if chosen is None else batch.take(pa.array(chosen))
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.full(len(to), borrowed)), part.column("doc_id"), part.column("text")], names=["bucket", "borrowed", "doc_id", "text"])

    dealt = rows.mapInArrow(deal, "bucket int, borrowed boolean, doc_id long, text string")
    return dealt.repartitionById(max(len(bounds), 1), F.col("bucket")).sortWithinPartitions("bucket", "borrowed", "doc_id", "text")


RESULT = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(), "near_next": pa.float64(), "edited_shift": pa.int64(),
}


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) characters replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``RESULT`` for each row; the next document is the one with the next id, after the last the first.

    Defined cases: a null text counts as empty, with an empty fingerprint; rows
    of equal id follow each other by text; null ids come before all others; a
    single document is followed by itself; an empty table gives no row; other
    columns are ignored. Every text is shuffled once.
    """
    ship(docs.sparkSession)

    def compute(rows: list[tuple]) -> pa.RecordBatch | None:
        """``rows``: (borrowed, doc_id, text) in order; the last one is only looked at."""
        own = [i for i in range(len(rows) - 1) if not rows[i][0]]
        changed = [edited(rows[i][2], rows[i + 1][2]) for i in own]
        marks = anchors([r[2] for r in rows])
        new = anchors(changed)
        out = {name: [] for name in RESULT}
        for i, text, mark in zip(own, changed, new, strict=True):
            digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
            values = (rows[i][1], len(rows[i][2]), digest, written(marks[i]), written(mark), likeness(marks[i], mark), likeness(marks[i], marks[i + 1]), shift(marks[i], mark))
            for name, value in zip(RESULT, values, strict=True):
                out[name].append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in RESULT.items()], names=list(RESULT)) if own else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        chars = 0
        for batch in batches:
            for _, borrowed, key, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append((borrowed, key, text))
                chars += len(text)
                if chars > STEP_CHARS // 2 and len(held) > 1:
                    done = compute(held)
                    if done is not None:
                        yield done
                    held, chars = held[-1:], len(text)
        if len(held) > 1 and (done := compute(held)) is not None:
            yield done

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_shift long"
    return _with_following(docs, id_col, text_col).mapInArrow(run, kinds)
