from itertools import combinations
from pathlib import Path

import corpus_pipeline
from pitchframe.llm import queries
from pitchframe.llm.common import save

DATA = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_on_all_that_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    lexicon = queries.toxic_lexicon(spark, docs, DATA)
    for name, stage in corpus_pipeline.STAGES:
        rows = {r["doc_id"]: r for r in docs.collect()}
        after = save(stage(spark, docs, DATA), f"test-{name}")
        left = after.collect()
        ids = {r["doc_id"] for r in left}
        if name == "toxicity":
            assert ids == {i for i, r in rows.items() if lexicon.score(*lexicon.measures(r["text"] or "")) < 0.7}
        elif name == "near_duplicates":
            sets = {i: shingles(r["text"]) for i, r in rows.items()}
            root = {i: i for i in rows}
            for a, b in combinations(sorted(rows), 2):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    low, high = sorted((root[a], root[b]))
                    root = {i: low if r == high else r for i, r in root.items()}
            assert ids == {i for i, r in root.items() if i == r}
        elif name == "repeated_passages":
            assert ids <= set(rows) and all(len(r["text"] or "") <= len(rows[r["doc_id"]]["text"] or "") for r in left)
        else:
            assert ids == set(rows)
        if name != "packing":
            assert after.columns == columns
        docs = after
    places = {}
    for r in left:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for row in places.values():
        at = 0
        for offset, length in sorted(row):
            assert offset == at
            at += length
        assert at <= 4096


def test_pipeline_stands_on_the_operators():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "personal_data", "packing"]
    assert Path(corpus_pipeline.__file__).parent == Path(__file__).parents[2]
