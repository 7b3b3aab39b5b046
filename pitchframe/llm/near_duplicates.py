"""Near duplicates by SuperMinHash.

The signature takes, for each shingle, correlated values: a random permutation of
the slots, drawn step by step, receives ``step + uniform``; a slot keeps its
minimum. A text is finished as soon as the next step can't lower any slot. Bands
of slots propose pairs, pairs are confirmed on the full shingle sets, and
confirmed pairs are grouped by union-find.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import map_arrow, save, texts
from pitchframe.llm.groups import components
from pitchframe.llm.words import Words, mix

ROWS, BANDS = 5, 25
LEADER_ROUNDS = 2
SKETCH = 16  # 64-bit numbers
_STEP = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 256, dtype=np.uint64)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    shingles, first = Words(column).shingles(width)
    return [np.unique(shingles[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """One row of ``slots`` values per set; equal slots estimate the Jaccard similarity. An empty set has infinities.

    All sets advance together, step by step; sets whose slots are all below the
    next step leave with their shingles.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    seeds = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    lowest = np.full((len(sets), slots), np.inf)
    flat = lowest.reshape(-1)
    order = None
    for step in range(slots):
        if not len(owner):
            break
        drawn = mix(seeds ^ _STEP[step])
        chosen = step + ((mix(drawn + np.uint64(1)) >> np.uint64(40)) % np.uint64(slots - step)).astype(np.int64)
        if order is None:
            slot = chosen
        else:
            rows = np.arange(len(owner))
            slot = order[rows, chosen].astype(np.int64)
            order[rows, chosen] = order[:, step]
            order[:, step] = slot
        np.minimum.at(flat, owner * slots + slot, step + (drawn >> np.uint64(11)) * 2.0**-53)
        stays = (lowest.max(axis=1) >= step + 1)[owner]
        if order is None:
            owner, seeds, slot = owner[stays], seeds[stays], slot[stays]
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(owner), 1))
            order[np.arange(len(owner)), slot] = 0
            order[:, 0] = slot
        elif not stays.all():
            owner, seeds, order = owner[stays], seeds[stays], order[stays]
    return lowest


def band_hashes(signatures: np.ndarray, rows: int, bands: int) -> np.ndarray:
    bits = signatures[:, : rows * bands].copy().view(np.uint64).reshape(len(signatures), bands, rows)
    return mix((mix(bits) * (_STEP[:rows] | np.uint64(1))).sum(axis=2, dtype=np.uint64) + _STEP[100 : 100 + bands]).view(np.int64)


def odd_sketch(members: np.ndarray) -> list[int]:
    """The parity of the number of members in each of ``64 * SKETCH`` cells, as 64-bit numbers.

    Two sketches differ in at most as many bits as the sets have elements that
    the other lacks: a bound that needs no look at the sets.
    """
    odd = np.bincount((members >> np.uint64(11)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def signed_documents(docs: DataFrame, width: int, rows: int = ROWS, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, digest, bands, sketch``; ``digest`` names the shingle set, null for an empty one."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("text"), width)
        hashes = band_hashes(super_minhash(sets, rows * bands), rows, bands)
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        kept = [h if len(s) else None for h, s in zip(hashes, sets, strict=True)]
        sketches = [odd_sketch(s) for s in sets]
        columns = [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(kept, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "bands", "sketch"])

    return map_arrow(texts(docs, id_col, text_col), sign, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``node, shingles`` of the documents in ``wanted`` (``node, digest``)."""

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("text"), width)
        same = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d for s, d in zip(sets, batch.column("digest").to_pylist(), strict=True)])
        columns = [batch.column("doc_id"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["node", "shingles"]).filter(same)

    rows = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_arrow(rows.join(wanted, F.col("doc_id") == F.col("node")).select("doc_id", "text", "digest"), compute, "node long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b") - both
    return pairs.join(left, "a").join(right, "b").where(share[1] * both >= share[0] * either).select("a", "b")


def near_duplicates(
    docs: DataFrame, width: int = 5, share: tuple[int, int] = (80, 100), rows: int = ROWS, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row.

    Texts are linked when their sets of ``width``-word shingles overlap by at
    least ``share[0] / share[1]`` of their union; components are closed over
    links and named by their smallest id.

    Equal sets are one class from the start, so copies never pair up. Within a
    bucket of a band the classes are compared with one leader, drawn anew per
    bucket, twice; buckets that then still span several components compare all
    pairs across components, so no link of a bucket is lost. Of these pairs an
    odd sketch, which bounds from below how much two sets differ, leaves only
    those that can reach the threshold; they are met in the join and not written
    out. Similarity is always confirmed on the full sets.

    Defined cases: a null or blank text has no shingles and stays alone; a text
    of fewer words is one shingle; a null id links with nothing (null component,
    kept); repeated rows share their component and are kept or not together; an
    empty table gives no row; other columns are ignored. A pair at the threshold
    shares a bucket with probability ``1 - (1 - share^rows)^bands``.
    """
    signed = save(signed_documents(docs, width, rows, bands, id_col, text_col), "signed")
    full = signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = save(
        full.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch")).alias("first")).select("digest", F.col("first.doc_id").alias("node"), "first.n_shingles", "first.bands", "first.sketch"),
        "classes",
    )
    entries = classes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    crowded = entries.groupBy("bucket").count().where("count > 1")
    entries = save(entries.join(crowded, "bucket").select("bucket", "node", "n_shingles"), "buckets")
    wanted = entries.select("node").distinct().join(classes.select("node", "digest"), "node")
    sets = save(_sets(docs, wanted, width, id_col, text_col), "sets")
    fits = share[1] * F.least("n_shingles", "other_n") >= share[0] * F.greatest("n_shingles", "other_n")

    def proposed(placed: DataFrame, others: DataFrame, possible: Column | bool = True) -> DataFrame:
        pairs = placed.join(others, "bucket").where((F.col("node") != F.col("other")) & (F.col("component") != F.col("other_component")) & fits & possible)
        return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()

    placed = entries.withColumn("component", F.col("node"))
    links, tested = None, None
    for turn in range(LEADER_ROUNDS + 1):
        if turn:
            found = components(links)
            placed = entries.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
            open_ = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
            placed = save(placed.join(open_.select("bucket"), "bucket"), "open")
        if turn < LEADER_ROUNDS:
            leader = F.min(F.struct(F.xxhash64("node", "bucket", F.lit(turn)).alias("draw"), "node", "n_shingles", "component")).alias("l")
            others = placed.groupBy("bucket").agg(leader).select("bucket", F.col("l.node").alias("other"), F.col("l.n_shingles").alias("other_n"), F.col("l.component").alias("other_component"))
            pairs = proposed(placed, others)
        else:
            # All pairs across the components that a bucket still holds, as far as the sketches leave them possible.
            bits = [f"bits_{i}" for i in range(SKETCH)]
            sketches = classes.select("node", *[F.col("sketch")[i].alias(b) for i, b in enumerate(bits)])
            marked = placed.join(sketches, "node")
            others = marked.select("bucket", F.col("node").alias("other"), F.col("n_shingles").alias("other_n"), F.col("component").alias("other_component"), *[F.col(b).alias(f"other_{b}") for b in bits])
            apart = F.expr(" + ".join(f"bit_count({b} ^ other_{b})" for b in bits))
            pairs = proposed(marked, others, (share[0] + share[1]) * apart <= (share[1] - share[0]) * (F.col("n_shingles") + F.col("other_n")))
        pairs = save(pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        new = save(_confirmed(pairs, sets, share), "links")
        links = new if links is None else links.union(new)
    found = components(links)
    named = classes.select("digest", "node").join(found, "node", "left").select(F.col("digest").alias("of"), F.coalesce("component", "node").alias("component"))
    out = signed.join(named, F.col("digest") == F.col("of"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, width: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`near_duplicates` does not keep; rows with a null id stay."""
    found = near_duplicates(docs, width, share, id_col=id_col, text_col=text_col)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
