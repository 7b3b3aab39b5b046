import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from pitchframe.llm import fingerprints, languages, neighbours, personal_data, queries, toxicity

from .conftest import prose

DATA = "/root/testdata/sf0.01"


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    """The patterns of the contract, plainly."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (pattern, valid) in enumerate(rules) for m in re.finditer(pattern, text) if valid(m.group()))


def test_base_spans_against_plain_patterns(spark):
    draw = random.Random(5)
    parts = ["a@b.com", "x_y@c.d-e.org", "@", ".", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+12", "1.2.3.4", "300.1.1.1", "0001.02.3.255", "é👍", " ", "-", "7", "12", "\n", "+", "(", "a.b", "_"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(1500)]
    rows = personal_data.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == base_spans(texts[r["doc_id"]])
        spans = {(s["start"], s["kind"], s["end"]) for s in r["spans"]}
        assert spans >= set(base_spans(texts[r["doc_id"]]))


def test_expectation_maximisation_finds_the_reliable_labeler():
    draw = random.Random(1)
    counts = {}
    for _ in range(4000):
        truth = draw.random() < 0.5
        say = lambda right: (1 if truth else -1) * (1 if draw.random() < right else -1)  # noqa: E731, B023
        votes = (0, say(0.95), say(0.9), say(0.5), say(0.85), 0)
        counts[votes] = counts.get(votes, 0) + 1
    patterns = sorted(counts.items())
    chance = dict(zip([v for v, _ in patterns], personal_data.reliabilities(patterns), strict=True))
    assert chance[0, 1, 1, -1, 1, 0] > 0.97 and chance[0, -1, -1, 1, -1, 0] < 0.03
    assert personal_data.reliabilities([]) == []


def test_odd_personal_data(odd, nothing):
    rows = personal_data.personal_data(odd).collect()
    assert len(rows) == odd.count() and personal_data.personal_data(nothing).count() == 0
    of = {r["doc_id"]: r["base"] for r in rows}
    assert [s["kind"] for s in of[8]] == [0, 1] and of[2] == of[3] == of[10] == []
    out = personal_data.redacted(odd)
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == odd.columns and text[2] is None and text[8] == "Ünï  çödé 👍 it's <|endoftext|> <email> <ip>"


def test_plan_of_personal_data_is_native(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    for df in (queries.QUERIES["op7_personal_data"](spark, DATA), personal_data.redacted(documents)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_folding():
    assert toxicity.fold("1D10T  сlоwn, Lösér! 2024 a1b2 $tupid") == " idiot clown loser 2024 aib2 stupid "
    assert toxicity.fold("") == "  "


def test_lexicon_with_exceptions():
    lexicon = toxicity.Lexicon({"clown": 3.0, "trash": 2.0}, ["clown fish"])
    assert lexicon.hits(toxicity.fold("a clown fish and a Cl0wn")) == 3.0
    assert lexicon.hits(toxicity.fold("clown clown trashy trash")) == 8.0
    assert toxicity.Lexicon({}, []).hits(" a ") == 0.0


def test_exceptions_are_learned(spark):
    rows = [(f"{prose(k, 30)} you moron {prose(k + 1, 9)}", 1) for k in range(20)] + [(f"{prose(k, 30)} moron valley {prose(k + 1, 9)}", 0) for k in range(100, 106)]
    rows += [(prose(k, 40), 0) for k in range(200, 500)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"))
    assert "moron" in lexicon.weights and "moron valley" in lexicon.exceptions
    assert lexicon.score(*lexicon.measures("some moron valley")) < 0.7 < lexicon.score(*lexicon.measures("you moron " * 5))


def test_toxicity_of_held_out_documents(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op2_toxicity"](spark, DATA).collect() if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in rows)
    assert right >= 0.95 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert not [r for r in rows if r["predicted"] and not labels[r["doc_id"]]]


def test_labels_are_drawn_before_the_texts(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (6, 0), (99, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    found = [(r["text"], r["toxic"]) for r in toxicity.labelled_sample(odd, labels).collect()]
    text = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert sorted(found) == sorted([(text[1], 1), (text[5], 1), (text[5], 1), (text[6], 0)])
    assert toxicity.labelled_sample(nothing, labels).count() == toxicity.labelled_sample(odd, labels.limit(0)).count() == 0
    many = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"), F.lit("a b").alias("text"))
    assert 400 < toxicity.labelled_sample(many, many, size=500).count() < 600


def test_odd_toxicity(spark, odd, nothing):
    lexicon = toxicity.Lexicon({"dor": 2.0}, [])
    assert toxicity.scores(odd, lexicon).count() == odd.count() and toxicity.scores(nothing, lexicon).count() == 0
    assert toxicity.without_toxic(odd, lexicon).columns == odd.columns
    empty = toxicity.learn(spark.createDataFrame([], "text string, toxic int"))
    assert empty.weights == {} and empty.score(*empty.measures("anything")) < 0.7


def greedy_phrases(text, sample):
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        n, at = n + 1, at + size
    return n


def test_phrases_against_plain_search():
    draw = random.Random(9)
    samples = {k: "".join(draw.choice("abcd ef"[i:]) for _ in range(400)) for i, k in enumerate("xyz")}
    parser = languages.Parser(samples)
    texts = ["".join(draw.choice("abcdefg") for _ in range(draw.randint(1, 200))) for _ in range(40)]
    counts = parser.phrases(texts) / parser.weights
    for text, row in zip(texts, counts, strict=True):
        assert [round(x) for x in row] == [greedy_phrases(text, re.sub(" +", " ", samples[k])) for k in "xyz"]


def test_languages_of_held_out_documents(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op8_languages"](spark, DATA).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_odd_languages(spark, odd, nothing):
    parser = languages.learn(odd)
    rows = languages.languages(odd, parser).collect()
    assert len(rows) == odd.count() and {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 4, 10)} == {"und"}
    assert languages.languages(nothing, parser).count() == 0
    assert {r["lang_pred"] for r in languages.languages(odd, languages.learn(nothing)).collect()} == {"und"}


def test_syncmers_against_definition():
    text = prose(4, 80)
    inner = {text[i : i + fingerprints.S] for i in range(len(text) - fingerprints.S + 1)}
    (found,) = fingerprints.anchors([text], size=10**6)
    places = sorted(found.values())
    hashed = {}
    for s in inner:
        (value,) = fingerprints.anchors([s])[0] if len(s) < fingerprints.S else (None,)
        hashed[s] = value
    # Context-free: every anchor of a passage is an anchor of any text around it.
    (wider,) = fingerprints.anchors([prose(5, 40) + text + prose(6, 40)], size=10**6)
    assert set(found) <= set(wider) and len(places) > len(text) / 10
    assert fingerprints.anchors(["", "abc", "abc"])[1:] == [fingerprints.anchors(["abc"])[0]] * 2
    moved = fingerprints.anchors([text, "0123456789" + text])
    assert fingerprints.shift(*moved) == 10 and fingerprints.likeness(*moved) > 0.8


def test_following_documents(spark, odd, nothing):
    rows = fingerprints.fingerprints(odd).collect()
    texts = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["text"] or "") for r in odd.collect())
    texts = [t for _, t in texts]
    want = sorted(hashlib.sha256(fingerprints.edited(a, b).encode()).hexdigest() for a, b in zip(texts, texts[1:] + texts[:1], strict=True))
    assert sorted(r["edited_sha256"] for r in rows) == want
    assert fingerprints.fingerprints(nothing).count() == 0
    one = spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")
    assert fingerprints.fingerprints(one).first()["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
    documents = [(7 * k % 501, prose(k, 30)) for k in range(1, 501)]
    rows = fingerprints.fingerprints(spark.createDataFrame(documents, "doc_id long, text string").repartition(7)).collect()
    order = [t for _, t in sorted(documents)]
    want = [hashlib.sha256(fingerprints.edited(a, b).encode()).hexdigest() for a, b in zip(order, order[1:] + order[:1], strict=True)]
    assert [r["edited_sha256"] for r in sorted(rows, key=lambda r: r["doc_id"])] == want


def test_neighbours_against_all_distances(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    points = {r["vec_id"]: np.array(r["embedding"]) for r in df.collect()}
    ids = np.array(sorted(points))
    matrix = np.stack([points[i] for i in ids])
    found = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 10 == 0, 10).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for query in ids[ids % 10 == 0]:
        far = np.sqrt(np.square(matrix - points[query]).sum(axis=1))
        want = [int(ids[i]) for i in np.lexsort((ids, far)) if ids[i] != query][:10]
        rows = sorted(found[query])
        assert [rank for rank, _, _ in rows] == list(range(1, 11)) and [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
        assert all(score == far[np.searchsorted(ids, v)] for _, v, score in rows)
        hits, total = hits + len(set(want) & {v for _, v, _ in rows}), total + 10
    assert hits >= 0.9 * total


def test_scan_keeps_ties_and_all_near_rows():
    draw = np.random.default_rng(2)
    vectors = draw.standard_normal((3000, 24))
    vectors[100:900] = vectors[100]
    ids = draw.permutation(3000)
    hits = neighbours.scan(vectors[95:105], ids[95:105], vectors, ids, 10)
    good = 0
    for i in range(95, 105):
        far = np.sqrt(np.square(vectors - vectors[i]).sum(axis=1))
        want = [int(ids[j]) for j in np.lexsort((ids, far)) if j != i][:10]
        got = [v for q, v, _ in hits if q == ids[i]]
        good += len(set(want) & set(got))
        if i >= 100:
            assert got == want
    assert good >= 95


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [0.0, 0.0]), (8, [1.0, None]), (9, [1.0]), (None, [1.0, 0.0]), (2, [0.9, 0.1]), (100, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", F.lit("clash"))
    out = neighbours.nearest(df, F.col("vec_id") % 100 == 0, 10, probed=1.0)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in out.collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (0, 3): 100, (100, 1): 2, (100, 2): 0, (100, 3): 1}
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
