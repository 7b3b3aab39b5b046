import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchframe.llm import quality, resampling, vector_codes

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


# -- vector codes


def plain_codes(rows, parts, entries, rounds):
    """By definition, in Python integers; ``rows`` are (id, label, vector of integers)."""
    width = len(rows[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    start = [v for i, _, v in sorted(rows, key=lambda r: (r[0] is None, r[0], r[2])) if i is not None][:entries]
    books = [[list(cut(v, p)) for v in start] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        moved = []
        for p in range(parts):
            own = [best(v, p) for _, _, v in rows]
            of = {e: [cut(v, p) for (_, _, v), o in zip(rows, own, strict=True) if o == e] for e in set(own)}
            moved.append([[sum(c) // len(of[e]) for c in zip(*of[e], strict=True)] if e in of else books[p][e] for e in range(len(books[p]))])
        books = moved
    codes = [[best(v, p) for p in range(parts)] for _, _, v in rows]
    errors = [sum(far(cut(v, p), books[p][c[p]]) for p in range(parts)) for (_, _, v), c in zip(rows, codes, strict=True)]
    sums = Counter()
    for (_, label, _), e in zip(rows, errors, strict=True):
        sums[label] += e
    name = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{x:02x}" for x in c), e, sums[label], name) for (i, label, _), c, e in zip(rows, codes, errors, strict=True))


def test_exact_products_of_large_integers():
    draw = random.Random(3)
    for width in (1, 2, 3, 4, 7, 64, 300):
        for size in (1, 2**9, 2**20, 2**28, vector_codes.limit(width)):
            a = [[draw.choice((draw.randint(-size, size), -size, size)) for _ in range(width)] for _ in range(5)]
            b = [[draw.choice((draw.randint(-size, size), -size, size)) for _ in range(width)] for _ in range(4)]
            got = vector_codes.exact_products(np.array(a, np.int64), np.array(b, np.int64))
            assert got.tolist() == [[sum(x * y for x, y in zip(r, s, strict=True)) for s in b] for r in a]


def test_limbs_stay_below_the_exact_range():
    assert all(width * 4 ** vector_codes.limb_bits(width) <= 2**53 for width in (1, 2, 3, 4, 5, 64, 65, 1000, 4096))


@pytest.mark.parametrize("size", [1, 1000, 2_000_000])
def test_codes_against_definition(spark, size):
    draw = random.Random(size)
    rows = [(k * 7 % 301, draw.choice((None, 1, 2)), [draw.uniform(-size, size) for _ in range(8)]) for k in range(300)]
    rows += rows[:40] + [(None, 2, rows[0][2]), (None, None, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    got = sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.vector_codes(df, 4, 16, 2).collect())
    assert got == plain_codes([(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows], 4, 16, 2)


def test_odd_vectors_have_no_row_or_no_code(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, [1.0, 2.0]), (2, 1, [1.5, -0.001]), (3, 1, None), (4, 2, [nan, 1.0]), (5, 2, [inf, 1.0]), (6, 2, [1.0, None]), (7, 2, [1.0, 2.0, 3.0]), (8, 2, [1e300, -1e300]), (9, None, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"code": F.lit("x"), "error": F.lit(1), "vector": F.lit(2)})
    got = {r["vec_id"]: r for r in vector_codes.vector_codes(df, 2, 4, 2).collect()}
    assert set(got) == {1, 2, 7, 8, 9} and [got[i]["code"] for i in (1, 2, 7, 8, 9)] == ["0000", "0101", None, None, None]
    assert got[1]["label_error"] == 0 and got[7]["label_error"] is None
    assert vector_codes.vector_codes(df.limit(0), 2, 4, 2).count() == 0
    assert [r["code"] for r in vector_codes.vector_codes(df.withColumn("vec_id", F.lit(None).cast("long")), 2, 4, 2).collect()] == [None] * 5
    assert [r["code"] for r in vector_codes.vector_codes(df.where("vec_id < 3"), 3, 4, 2).collect()] == [None] * 2


# -- quality rules


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 5)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


def counted(rows):
    return sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)


def wanted(texts):
    out = []
    for text in texts:
        found = plain_counts(text)
        out.append((*found, found[0] < 10 or 100 * found[4] > 20 * found[0]))
    return sorted(out)


def test_base_counts_against_definition(spark):
    draw = random.Random(8)
    parts = ["a", "bb", "a", "é👍", "#", "|", " ", " ", "\n", "\n", "\t", "\x0b\x0c", "\r", "a b c d e f ", " ", "<x>", "A", "7"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 90))) for _ in range(800)]
    df = spark.createDataFrame([(i, t, draw.choice((None, "x", "y"))) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert counted(quality.quality(df).collect()) == wanted(texts)


def test_odd_quality(spark, odd, nothing):
    df = odd.withColumns({"words": F.lit(1), "total": F.lit("t"), "classes": F.lit(0), "of": F.lit(0)})
    rows = quality.quality(df).collect()
    assert counted(rows) == wanted([r["text"] for r in odd.collect()])
    assert all(not r["kept"] for r in rows if r["base_failed"])
    assert quality.quality(nothing).count() == 0
    long = spark.createDataFrame([(1, "to be or not to " * 60_000, "en")], "doc_id long, text string, lang string")
    assert quality.quality(long).first()["n_repeat_words"] == 300_000


def divergence(p, q):
    total = 0.0
    for k in set(p) | set(q):
        a, b = p.get(k, 0), q.get(k, 0)
        total += (a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0)
    return math.sqrt(max(0.0, total) / 2)


def shares(counts):
    total = sum(counts.values())
    return {k: n / total for k, n in counts.items()}


def test_distances_against_definition(spark):
    draw = random.Random(2)
    stop = ["the", "of", "and", "to"]
    make = lambda n, k: " ".join(draw.choice(stop) if draw.random() < 0.4 else w for w in prose(k, n).split())
    rows = [(k, make(draw.randint(40, 400), k), draw.choice(("en", None))) for k in range(60)]
    rows += [(90, " | ".join(prose(90, 80).split()), "en"), (91, "THE!! " * 3 + make(80, 91).upper(), None), (92, make(300, 92), "rare")]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    kind = lambda c: "l" if c.islower() else "u" if c.isupper() else " " if c in " \n" else "s" if c in "#*$%&|<>" else "."
    for i, text, lang in rows:
        texts = [t for _, t, o in rows if o == lang]
        words = Counter(w for t in texts for w in WORD.findall(t))
        common = {w for w, n in words.items() if n * quality.COMMON >= sum(words.values())}
        fold = lambda counts: Counter({w: sum(n for v, n in counts.items() if (v if v in common else None) == w) for w in [*common, None]})  # noqa: B023, E731
        own = Counter(WORD.findall(text))
        if sum(own.values()) < quality.JUDGED_WORDS or sum(words.values()) < quality.REFERENCE_WORDS:
            assert got[i]["word_distance"] is None and got[i]["class_distance"] is None
            continue
        assert math.isclose(got[i]["word_distance"], divergence(shares(fold(own)), shares(fold(words))), abs_tol=1e-9)
        assert math.isclose(got[i]["class_distance"], divergence(shares(Counter(map(kind, text))), shares(Counter(map(kind, "".join(texts))))), abs_tol=1e-9)
        allowed = lambda bins: quality.BASE + quality.NOISE * math.sqrt(bins / sum(own.values()))  # noqa: B023, E731
        near = got[i]["class_distance"] <= allowed(8) and got[i]["word_distance"] <= allowed(len(common) + 1)
        assert got[i]["kept"] == (near and not got[i]["base_failed"])
    assert not got[90]["kept"] and not got[91]["kept"] and got[92]["kept"]


def test_quality_finds_junk_and_keeps_prose(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select(F.col("doc_id").alias("of"), F.col("quality").alias("good"))
    rows = quality.quality(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, F.col("doc_id") == F.col("of")).where("n_words >= 50").collect()
    good, junk = [r for r in rows if r["good"]], [r for r in rows if not r["good"]]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good) and sum(not r["kept"] for r in junk) >= 0.9 * len(junk)


def test_plan_of_quality_is_native(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (quality.quality(documents), quality.references(documents.select("text", "lang"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|NestedLoop|Cartesian", plan)
    assert "Exchange hashpartitioning" not in quality.quality(documents)._jdf.queryExecution().executedPlan().toString()


# -- importance resampling


def plain_resample(rows, target, lengths, buckets, percent, min_words, seed):
    words = lambda text: FEATURE_WORD.findall((text or "").translate(LOWER))
    runs = lambda w: [" ".join(w[i : i + n]) for n in range(lengths[0], lengths[1] + 1) for i in range(len(w) - n + 1)]
    hashed = lambda text: [zlib.crc32(f.encode()) % buckets for f in runs(words(text))]
    source, wanted = Counter(b for _, t in rows for b in hashed(t)), Counter(b for t in target for b in hashed(t))
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets)))) for b in source}
    out = []
    for i, t in rows:
        found = hashed(t)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(t)), None])
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2], r[4]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = rank
    return sorted(((i, n, w, s, rank) for i, n, w, s, _, rank in out), key=str)


@pytest.mark.parametrize("lengths", [(1, 1), (1, 2), (2, 3)])
def test_resampling_against_definition(spark, lengths):
    draw = random.Random(4)
    parts = ["Ab", "ab", "é", "ÀB", " ", " ", ".", "-", "7x", "\x00", " ", "👍", "_", "\n", "c"]
    rows = [(draw.choice((None, k, k, k % 9)), draw.choice((None, "")) if draw.random() < 0.05 else "".join(draw.choice(parts) for _ in range(draw.randint(0, 80)))) for k in range(300)]
    target = ["".join(draw.choice(parts) for _ in range(40)) for _ in range(30)] + [None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rank": F.lit("r"), "weight": F.lit("w"), "buckets": F.lit(0)}).repartition(5)
    wish = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resampled(docs, wish, lengths, 997, 30, 8, 7)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_resample(rows, target, lengths, 997, 30, 8, 7)


def test_odd_resampling(spark, odd, nothing, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = plain_resample(rows, [], (1, 1), 10_000, 50, 20, 1)
    assert sorted((tuple(r) for r in resampling.resampled(odd, nothing, (1, 1), percent=50, seed=1).collect()), key=str) == want
    assert resampling.resampled(nothing, odd).count() == 0
    assert resampling.resampled(odd, odd, buckets=100_000).count() == odd.count()
    # A score that very many rows share is cut into segments.
    same = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(prose(1, 30)).alias("text"))
    monkeypatch.setattr(resampling, "ROWS_PER_TASK", 100)
    monkeypatch.setattr("pitchframe.operators.ordered.ROWS_PER_TASK", 100)
    ranks = [r["rank"] for r in resampling.resampled(same, same, percent=25).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 1001)) and len(ranks) == 4000
