"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, look-alike letters, digits and signs that stand
for letters). Lexicon terms are found by one Aho-Corasick automaton, at word
borders; hits inside exception phrases don't count. The weights are log odds of
labelled documents; the sum of hits is set against the length of the text, and a
logistic curve fitted to the labels turns both into a score.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import map_arrow, ship, texts

# Signs that are read as the letter they look like.
LOOKALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i",
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "ı": "i",
}
_SUBSTITUTES = "01345787@$!"
# Labelled rows that the lexicon and the curve are fitted on, at most; the least by a hash of the text.
SAMPLE_ROWS = 40_000
MIN_DOCS = 4
MIN_ODDS = 2.0
TERMS = 20_000


@lru_cache(maxsize=1)
def _tables() -> tuple[dict, re.Pattern, re.Pattern]:
    table = {ord(k): v for k, v in LOOKALIKES.items() if k not in _SUBSTITUTES}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        table.setdefault(code, plain or " ")
    for code in [*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0xAD, 0xFEFF]:
        table[code] = None
    table |= {ord(u): l for u, l in zip(map(str.upper, "авсекмнорѕтухαβεικνορτυχ"), map(LOOKALIKES.get, "авсекмнорѕтухαβεικνορτυχ"), strict=True)}
    mixed = re.compile(r"(?<![\w@$!])(?=[^\W\d_@$!]*[0134578@$!])(?=[0134578@$!]*[^\W\d_])[\w@$!]+")
    return table, mixed, re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower-case words separated and enclosed by single blanks, look-alikes resolved; digits change only inside words with letters."""
    table, mixed, word = _tables()
    text = text.lower()
    if not text.isascii():
        text = text.translate(table)
    substitute = str.maketrans({k: LOOKALIKES[k] for k in set(_SUBSTITUTES)})
    if any(sign in text for sign in "013457 8@$!".replace(" ", "")):
        text = mixed.sub(lambda m: m.group().rstrip("!").translate(substitute), text)
    return f" {' '.join(word.findall(text))} "


class Lexicon:
    """Weighted terms and exception phrases (both folded, phrases contain a term), and the curve of the score."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], curve: tuple[float, float, float] = (-4.0, 1.0, 1.0)):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self._automaton = None

    def __getstate__(self):
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, state):
        self.__init__(*state)

    def _matcher(self):
        if self._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                made.add_word(f" {term} ", (len(term), weight))
            for phrase in self.exceptions:
                made.add_word(f" {phrase} ", (len(phrase), None))
            if len(made):
                made.make_automaton()
            self._automaton = made
        return self._automaton

    def hits(self, folded: str) -> float:
        """The summed weight of the terms in a folded text, without those inside an exception phrase."""
        matcher = self._matcher()
        if not len(matcher):
            return 0.0
        found, covered = [], []
        for last, (length, weight) in matcher.iter(folded):
            (covered if weight is None else found).append((last - length, last, weight))
        if covered:
            found = [(a, b, w) for a, b, w in found if not any(x <= a and b <= y for x, y, _ in covered)]
        return sum(w for _, _, w in found)

    def measures(self, text: str) -> tuple[float, float]:
        folded = fold(text)
        hits = self.hits(folded)
        words = max(1, folded.count(" ") - 1)
        return np.log1p(hits), np.log1p(100 * hits / words)

    def score(self, total: float, rate: float) -> float:
        base, by_total, by_rate = self.curve
        return float(1 / (1 + np.exp(-(base + by_total * total + by_rate * rate))))


def held_out(key: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def _word_documents(rows: DataFrame) -> DataFrame:
    """One row per document and distinct folded word, pair and triple of words, with ``toxic``."""

    def grams(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, label = [], []
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            own = set(fold(text).split())
            found += own
            label += [toxic] * len(own)
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(label, pa.int32())], names=["gram", "toxic"])

    return map_arrow(rows, grams, "gram string, toxic int")


def _phrases(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Each document's phrases of a term and the word before or after it, with ``toxic``."""
    wanted = set(terms)

    def around(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, label = [], []
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = fold(text).split()
            own = {" ".join(words[a:b]) for i, w in enumerate(words) if w in wanted for a, b in ((i - 1, i + 1), (i, i + 2)) if a >= 0 and b <= len(words)}
            found += own
            label += [toxic] * len(own)
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(label, pa.int32())], names=["gram", "toxic"])

    return map_arrow(rows, around, "gram string, toxic int")


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", size: int = SAMPLE_ROWS) -> DataFrame:
    """``text`` and label of about ``size`` labelled documents, those with the least hash of their key; all of them, if there are fewer.

    The labels are drawn before they meet the texts, so the side that is
    broadcast has no more than the sample's rows (a key and a label each) and no
    text is shuffled. Rows without key or label take no part; a key that is
    labelled more than once has its largest label.
    """
    known = labels.select(F.col(id_col).alias("__key"), F.col(label_col).cast("int").alias(label_col)).dropna()
    known = known.groupBy("__key").agg(F.max(label_col).alias(label_col))
    share = size / max(known.count(), 1)
    if share < 1:
        known = known.where((F.xxhash64("__key") / 2.0**63 + 1) / 2 < share)
    return docs.select(F.col(id_col).alias("__key"), text_col).join(F.broadcast(known), "__key").drop("__key")


def learn(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """A lexicon from rows with a text and a 0/1 label.

    Fitted on the ``SAMPLE_ROWS`` rows with the least hash of their text: a
    bounded sample that is the same on every run. A term needs ``MIN_DOCS``
    toxic documents and log odds of ``MIN_ODDS``; a phrase of a term and a
    neighbour that stands in ten times as many clean documents as toxic ones, and
    in ``MIN_DOCS``, becomes an exception.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("toxic")).dropna()
    rows = rows.withColumn("draw", F.xxhash64("text"))
    n = rows.count()
    if n > SAMPLE_ROWS:
        share = SAMPLE_ROWS / n
        rows = rows.where((F.col("draw") / 2.0**63 + 1) / 2 < share)
    rows = rows.drop("draw").persist()
    totals = {row["toxic"]: row["count"] for row in rows.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    counts = [F.sum("toxic").alias("of_toxic"), F.sum(1 - F.col("toxic")).alias("of_clean")]
    odds = F.log((F.col("of_toxic") + 0.5) / (toxic + 1)) - F.log((F.col("of_clean") + 0.5) / (clean + 1))
    chosen = _word_documents(rows).groupBy("gram").agg(*counts).withColumn("odds", odds).where((F.col("of_toxic") >= MIN_DOCS) & (F.col("odds") >= MIN_ODDS))
    terms = chosen.orderBy(F.desc("of_toxic"), "gram").limit(TERMS).collect()
    weights = {row["gram"]: row["odds"] for row in terms}
    exceptions = []
    doubtful = [row["gram"] for row in terms if row["of_clean"] >= MIN_DOCS]
    if doubtful:
        around = _phrases(rows, doubtful).groupBy("gram").agg(*counts)
        harmless = (F.col("of_clean") >= MIN_DOCS) & (F.col("of_toxic") <= 0.1 * F.col("of_clean"))
        exceptions = [row["gram"] for row in around.where(harmless).orderBy(F.desc("of_clean"), "gram").limit(TERMS).collect()]
    lexicon = Lexicon(weights, exceptions)
    lexicon.curve = _curve(rows, lexicon)
    rows.unpersist()
    return lexicon


def _curve(rows: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """Logistic regression of the label on the two measures, over counts of measures rounded to 0.1 (a bounded table)."""

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [lexicon.measures(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.float64()), pa.array([y for _, y in pairs], pa.float64()), batch.column("toxic")], names=["total", "rate", "toxic"])

    cells = map_arrow(rows, measure, "total double, rate double, toxic int").groupBy(F.round("total", 1).alias("total"), F.round("rate", 1).alias("rate"), "toxic").count()
    table = np.array([tuple(row) for row in cells.orderBy("total", "rate", "toxic").collect()], float).reshape(-1, 4)
    # Two cells stand for what a few labels can't show: no hit is clean, strong hits are toxic.
    table = np.vstack([table, [[0, 0, 0, 2], [3, 3, 1, 2]]])
    x = np.column_stack([np.ones(len(table)), table[:, :2]])
    y, n, w = table[:, 2], table[:, 3], np.array([-4.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - 0.01 * w
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3)
        w = w + np.clip(np.linalg.solve(bend, slope), -2, 2)
    return tuple(map(float, w))


def scores(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of each row, from the text alone.

    Defined cases: a null or empty text has no hit and gets the lowest score;
    repeated rows and null keys each keep their row; an empty table gives no row;
    other columns are ignored; a very long text is scored whole. No shuffle.
    """
    rows = texts(docs, id_col, text_col)

    def rate(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [lexicon.score(*lexicon.measures(t)) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32())], names=["doc_id", "score", "predicted"])

    return map_arrow(rows, rate, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all their columns; null texts stay."""
    ship(docs.sparkSession)

    @F.pandas_udf("boolean")
    def clean(column: pd.Series) -> pd.Series:
        return column.map(lambda t: t is None or lexicon.score(*lexicon.measures(t)) < threshold).astype(bool)

    return docs.where(clean(F.col(text_col)))
