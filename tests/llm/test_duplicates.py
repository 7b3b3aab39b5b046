import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from pitchframe.llm import near_duplicates, repeated_passages
from pitchframe.llm.common import map_arrow, save
from pitchframe.llm.groups import components

from .conftest import WORDS, prose


def shingles(text, width):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").lower()) if w]
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def grouped(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    draw = random.Random(2)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5)]
    want = grouped({x for e in edges for x in e}, edges)
    rows = components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in rows} == {k: v for k, v in want.items() if k in touched} and len(rows) == len(touched)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signature_estimates_similarity_and_stops_early():
    draw = np.random.default_rng(3)
    base = draw.integers(1, 2**63, 400).astype(np.uint64)
    errors = []
    for overlap in (100, 200, 300, 360):
        other = np.concatenate([base[:overlap], draw.integers(1, 2**63, 400 - overlap).astype(np.uint64)])
        a, b = near_duplicates.super_minhash([base, other], 128)
        errors.append(abs((a == b).mean() - overlap / (800 - overlap)))
    assert max(errors) < 0.12
    # The same as drawing every step of every element: the early stop changes nothing.
    few = [base[:3], base[:50], base[:0]]
    alone = np.vstack([near_duplicates.super_minhash([s], 32) for s in few])
    assert np.array_equal(near_duplicates.super_minhash(few, 32), alone)
    assert np.isinf(alone[2]).all() and (alone[:2] < 32).all()


@pytest.mark.parametrize("width, share", [(3, (85, 100)), (5, (80, 100))])
def test_against_all_pairs(spark, width, share):
    draw = random.Random(width)
    texts = []
    for group in range(12):
        words = prose(group, draw.randint(5, 150)).split()
        for _ in range(draw.randint(1, 9)):
            new = [draw.choice(WORDS) if draw.random() < draw.choice((0, 0.01, 0.03, 0.06)) else w for w in words]
            texts.append(" ".join(new))
    texts += ["", None, "one", "one", "Two words", "two  WORDS"]
    sets = [shingles(t, width) for t in texts]
    links = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and share[1] * len(sets[i] & sets[j]) >= share[0] * len(sets[i] | sets[j])]
    want = grouped(range(len(texts)), links)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = near_duplicates.near_duplicates(df, width, share).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == want[r["doc_id"]]) and r["n_shingles"] == len(sets[r["doc_id"]]) for r in rows)


def test_links_that_leaders_miss(spark):
    """Two texts near a middle one but not near each other, many times over: every link counts, whoever leads."""
    texts = []
    for group in range(6):
        words = prose(100 + group, 200).split()
        for side in range(8):
            new = list(words)
            for k in range(side * 20, side * 20 + 12):
                new[k] = new[k] + "x"
            texts.append(" ".join(new))
        texts.append(" ".join(words))
    sets = [shingles(t, 3) for t in texts]
    links = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    rows = near_duplicates.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, (85, 100)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == grouped(range(len(texts)), links)


def test_odd_documents(odd, nothing):
    rows = near_duplicates.near_duplicates(odd, 5).collect()
    assert len(rows) == odd.count()
    of = {r["doc_id"]: r for r in rows}
    assert of[5]["component_id"] == 1 and not of[5]["kept"] and of[1]["kept"]
    assert of[None]["component_id"] is None and of[None]["kept"]
    assert all(of[i]["n_shingles"] == 0 and of[i]["component_id"] == i for i in (2, 3, 4))
    assert near_duplicates.near_duplicates(nothing, 5).count() == 0
    kept = near_duplicates.deduplicated(odd, 5)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]


def test_compact_windows_against_definition():
    draw = random.Random(7)
    for _ in range(150):
        parts = [np.array([draw.randint(1, draw.choice([5, 1000])) for _ in range(draw.randint(0, 40))], np.uint64) for _ in range(draw.randint(1, 5))]
        first, least, want = np.concatenate([[0], np.cumsum([len(p) for p in parts])]), draw.randint(1, 12), set()
        for k, p in enumerate(parts):
            for c in range(len(p)):
                left, right = c, c
                while left > 0 and p[left - 1] > p[c]:
                    left -= 1
                while right + 1 < len(p) and p[right + 1] >= p[c]:
                    right += 1
                if right - left + 1 >= least:
                    want.add((c + first[k], left + first[k], right + first[k]))
        assert set(zip(*[x.tolist() for x in repeated_passages.compact_windows(np.concatenate(parts), first, least)], strict=True)) == want


def test_planted_passages(spark, nothing):
    shared = [prose(900 + k, 55 + 9 * k) for k in range(5)]
    texts = [prose(k, 40 + 7 * k) for k in range(60)]
    planted = {}
    for k in range(60):
        if k % 3 == 0:
            words = shared[k // 3 % 5].split()
            if k > 30:
                words[len(words) // 2] = "changed"
            texts[k] = f"{prose(500 + k, 30)} {' '.join(words)} {prose(700 + k, 35)}"
            planted.setdefault(k // 3 % 5, []).append(k)
    rows = repeated_passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)).collect()
    of = {r["doc_id"]: r for r in rows}
    for members in planted.values():
        assert {of[m]["class_id"] for m in members} == {members[0]} and not of[members[0]]["spans"]
        for m in members[1:]:
            (span,) = of[m]["spans"]
            size = len(shared[m // 3 % 5].split())
            assert span["start"] <= 34 and span["end"] >= 26 + size
    assert all(of[k]["class_id"] == k and not of[k]["spans"] for k in range(60) if k % 3)
    assert repeated_passages.repeated_passages(nothing).count() == 0


def in_order(spark, texts):
    rows = repeated_passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)).collect()
    return {r["doc_id"]: r for r in rows}


def test_passages_that_the_first_document_lacks(spark):
    """A first document has most of a passage, not enough of it: the later two that have all of it are linked all the same."""
    texts = []
    for k in range(12):
        words = prose(2000 + k, 54).split()
        part = words[:47] if k % 2 else words[7:]
        texts += [" ".join([prose(2100 + 9 * k, 30), *part, prose(2101 + 9 * k, 30)])]
        texts += [" ".join([prose(2102 + 9 * k + i, 30), *words, prose(2105 + 9 * k + i, 30)]) for i in range(2)]
    of = in_order(spark, texts)
    for k in range(0, len(texts), 3):
        assert [of[k + i]["class_id"] for i in range(3)] == [k, k + 1, k + 1]
        assert [of[k + i]["n_links"] for i in range(3)] == [0, 0, 1] and [tuple(s) for s in of[k + 2]["spans"]] == [(30, 84)]


def test_passages_with_words_more_or_less(spark):
    texts = []
    for k in range(10):
        words = prose(3000 + k, 60).split()
        other = words[:30] + ["added"] * (k % 2) + words[30 + (k + 1) % 2 :]
        texts += [" ".join([prose(3100 + 4 * k, 30), *words, prose(3101 + 4 * k, 30)]), " ".join([prose(3102 + 4 * k, 30), *other, prose(3103 + 4 * k, 30)])]
    of = in_order(spark, texts)
    assert all(of[k]["class_id"] == of[k + 1]["class_id"] == k and len(of[k + 1]["spans"]) == 1 for k in range(0, len(texts), 2))


def test_links_in_frequent_minima(spark):
    """More documents than are all compared share a part that is too short; some share all of the passage, some with changes."""
    words, sides = prose(4000, 66).split(), 20
    texts = [" ".join([prose(4100 + k, 20), *words[10:50], prose(4300 + k, 20)]) for k in range(repeated_passages.SMALL + 10)]
    short = len(texts)
    texts += [" ".join([prose(4500 + k, sides), *words, prose(4600 + k, sides)]) for k in range(5)]
    changed = [w + "x" if i == 40 else w for i, w in enumerate(words)]
    texts += [" ".join([prose(4700 + k, sides), *changed, prose(4800 + k, sides)]) for k in range(5)]
    of = in_order(spark, texts)
    assert all(of[k]["class_id"] == k and not of[k]["n_links"] for k in range(short))
    assert {of[k]["class_id"] for k in range(short, len(texts))} == {short}
    assert all(tuple(of[k]["spans"][0]) == (sides, sides + 66) for k in range(short + 1, len(texts)))


@pytest.mark.parametrize("small", [1000, 3])
def test_repeats_against_plain_search(spark, monkeypatch, small):
    """Documents cut from few sources: each pair with 50 words in a row in common is connected; if all are compared, it counts and its words are in the spans."""
    monkeypatch.setattr(repeated_passages, "SMALL", small)
    draw = random.Random(11)
    sources = [prose(5000 + k, 200).split() for k in range(4)] + [["same"] * 200, (prose(5100, 9).split() * 30)[:200]]
    texts = []
    for _ in range(70):
        words = []
        for _ in range(draw.randint(1, 5)):
            at = draw.randint(0, 130)
            words += draw.choice(sources)[at : at + draw.randint(20, 70)] + prose(draw.randint(6000, 10**6), draw.randint(0, 20)).split()
        texts.append(" ".join(words))
    of, seen, pairs, short = in_order(spark, texts), {}, set(), 0 if small == 1000 else 24
    for i, text in enumerate(texts):
        words = text.split()
        runs = [tuple(words[k : k + 50]) for k in range(len(words) - 49)]
        for k, run in enumerate(runs):
            pairs |= {(other, i) for other in seen.get(run, ())}
            if run in seen:
                assert any(s["start"] - short <= k and k + 50 <= s["end"] + short for s in of[i]["spans"])
        for run in runs:
            seen.setdefault(run, set()).add(i)
    assert pairs and all(of[a]["class_id"] == of[b]["class_id"] for a, b in pairs)
    assert small < 1000 or all(of[i]["n_links"] >= len({a for a, b in pairs if b == i}) for i in of)


def test_passages_within_one_that_falls_short():
    """Each stretch that meets the threshold by itself counts whole, though the text goes on with too many changes."""
    draw = np.random.default_rng(5)
    a = draw.integers(1, 2**62, 200)
    b = a.copy()
    changed = [*range(95, 101), *range(130, 136), *range(150, 160), *range(170, 180), *range(190, 199)]
    b[changed] = draw.integers(1, 2**62, len(changed))
    spans = repeated_passages.passages(a, np.insert(b, 132, 9), 46, (80, 100))
    assert (0, 130) in spans and all(end <= 150 for _, end in spans)


def test_common_run():
    assert repeated_passages.common_run(46, 5, (80, 100)) == 20 and repeated_passages.common_run(46, 5, (100, 100)) == 46


def test_cut_passages(spark, odd):
    found = {r["doc_id"]: r for r in repeated_passages.repeated_passages(odd).collect()}
    assert found[5]["class_id"] == found[7]["class_id"] == 1 and found[None]["class_id"] is None
    kept = repeated_passages.without_repeats(odd)
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert kept.columns == odd.columns and 5 not in rows and rows[7]["text"] == prose(3, 70)
    assert rows[1]["text"] == prose(1, 120) and rows[2]["text"] is None and rows[None]["text"] == prose(1, 120)


def test_word_hashes_follow_words():
    from pitchframe.llm.words import Words

    column = pa.array(["a  B\tc", "", "b C", None, "é\x0ba"]).fill_null("")
    words = Words(column[1:])
    assert np.diff(words.first).tolist() == [0, 2, 0, 2]
    whole = Words(column)
    assert whole.hashes[:3].tolist() == [*Words(pa.array(["a b c"])).hashes.tolist()] and whole.hashes[3] == whole.hashes[1]


def test_saved_tables_leave_no_shuffles_and_hold_settings(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles() -> set[str]:
        names = files.getAllFiles()
        return {n for n in (names.apply(i).getName() for i in range(names.size())) if n.startswith("shuffle_")}

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, limit = shuffles(), spark.conf.get(key)
    wide = spark.range(1000).repartition(3).groupBy("id").count()
    sizes = map_arrow(wide, lambda batch: pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"]), "n long")
    out = save(sizes, "sizes", spark__sql__execution__arrow__maxRecordsPerBatch=repeated_passages.ROWS)
    rows = [r["n"] for r in out.collect()]
    assert sum(rows) == 1000 and max(rows) <= int(repeated_passages.ROWS)
    assert spark.conf.get(key) == limit
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before


def test_alignments_far_apart_keep_their_places(spark):
    draw = random.Random(11)
    fresh = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    one, two, three = fresh(60), fresh(70), fresh(80)
    texts = {1: one + fresh(5000) + two + fresh(40) + three, 2: fresh(30) + three + fresh(4200) + one + fresh(9) + two}
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in repeated_passages.repeated_passages(docs).collect()}
    assert [tuple(s) for s in rows[2]["spans"]] == [(30, 110), (4310, 4370), (4379, 4449)]
    assert (rows[2]["class_id"], rows[2]["n_links"], rows[1]["spans"]) == (1, 1, [])


def test_slices_give_the_passages_of_their_bands(monkeypatch):
    """Random runs, copies with changes and words over and over: each band of a pair of slices gives what its own parts give."""
    draw, least, share, seen = np.random.default_rng(8), 46, (80, 100), 0
    for k in range(300):
        a = draw.integers(1, 2**62, 300)
        if k % 3 == 0:
            a = np.repeat(draw.integers(1, 6, 40), draw.integers(1, 70, 40))[: draw.integers(1, 400)]
        b = np.concatenate([draw.integers(1, 2**62, draw.integers(0, 90)), a])
        for place in draw.integers(0, len(b), draw.integers(0, 8)):
            b = np.concatenate([b[:place], draw.integers(1, 9, draw.integers(0, 12)), b[place + draw.integers(0, 12) :]])
        if not len(b):
            continue
        x, u = (int(n) for n in draw.integers(0, 50, 2))
        bands, want = [], []
        for _ in range(3):
            start, until = sorted(int(n) for n in draw.integers(x, x + len(a) + 60, 2))
            shift = int(draw.integers(-120, max(start - u, -119)))
            if until == start or start - shift < u:
                continue
            bands.append({"shift": shift, "x": start, "y": until})
            parts = a[start - x : until - x], b[start - shift - u : until - shift - u]
            want += [(shift, i + start, j + start) for i, j in repeated_passages.passages(*parts, least, share, 0)]
        seen += len(want)
        assert repeated_passages.aligned_passages(a, b, bands, x, u, least, share) == want
    assert seen > 100
    # One word over and over on both sides, among other words, is not compared place by place.
    monkeypatch.setattr(repeated_passages, "_grown", None)
    for n, m in ((10, 80), (46, 9), (80, 46), (45, 45)):
        a, b = (np.concatenate([draw.integers(10, 2**62, 140), np.full(size, 7), draw.integers(10, 2**62, 140)]) for size in (n, m))
        found = repeated_passages.aligned_passages(a, b, [{"shift": 0, "x": 0, "y": 400}], 0, 0, least, share)
        assert found == ([(0, 140, 140 + n)] if n >= least else [])


def test_second_comparison_goes_in_turns_and_leaves_no_tables(spark, monkeypatch):
    """Documents that share a part that is too short, and some that share all of it: with few pairs held at a time all are found too, and spent tables go."""
    words = prose(8000, 66).split()
    texts = [" ".join([prose(8100 + k, 20), *words[10:50], prose(8300 + k, 20)]) for k in range(20)]
    texts += [" ".join([prose(8500 + k, 20), *words, prose(8600 + k, 20)]) for k in range(8)]
    whole = in_order(spark, texts)
    saved = []

    def keep(df, purpose, **settings):
        saved.append((purpose, save(df, purpose, **settings)))
        return saved[-1][1]

    monkeypatch.setattr(repeated_passages, "save", keep)
    monkeypatch.setattr(repeated_passages, "AT_ONCE", 0)
    monkeypatch.setattr(repeated_passages, "TURN", 1000)
    assert in_order(spark, texts) == whole and {whole[k]["class_id"] for k in range(20, 28)} == {20}
    assert sum(purpose == "passages" for purpose, _ in saved) > 2
    assert {purpose for purpose, table in saved if os.path.exists(table._saved_as)} == {"passages"}
