"""Language identification by cross-parsing.

A suffix automaton of a sample of each language holds all its substrings. A text
is parsed greedily into the longest phrases that occur in the sample; the
language that needs the fewest phrases, each weighed by the logarithm of its
sample's length, wins. All texts of a batch and all languages advance together,
one symbol at a time, through one dense transition table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import map_arrow

# Bounds of the training sample: texts per language (the least by a hash of the text), characters of each, symbols of all.
SAMPLE_TEXTS, TEXT_CHARS, SAMPLE_SYMBOLS = 60, 2_000, 24_000
BLOCK = 256  # symbols parsed in one go; a phrase ends where a block ends
BLANK, OTHER = 0, 1


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of the smallest automaton of all substrings of ``symbols``; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in symbols:
        new, at = len(moves), last
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at >= 0:
            target = moves[at][symbol]
            if length[at] + 1 == length[target]:
                link[new] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                link.append(link[target])
                length.append(length[at] + 1)
                while at >= 0 and moves[at].get(symbol) == target:
                    moves[at][symbol] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    return moves


class Parser:
    """Counts phrases per language. Letters are symbols of their own in lower case, all else is one blank between words."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        letters = sorted({c for text in samples.values() for c in text.lower() if c.isalpha() and ord(c) < 0x10000})
        self.table = np.full(0x10000, OTHER, np.int32)
        for code in range(0x10000):
            if not chr(code).isalpha():
                self.table[code] = BLANK
        self.table[[ord(c) for c in letters]] = np.arange(2, 2 + len(letters))
        self.pad = 2 + len(letters)
        self.width = self.pad + 1
        self.roots, weights, parts, base = [], [], [], 0
        for name in self.names:
            symbols = self.symbols(samples[name])[:SAMPLE_SYMBOLS].tolist()
            moves = suffix_automaton(symbols)
            dense = np.full((len(moves), self.width), -1, np.int32)
            for state, targets in enumerate(moves):
                for symbol, target in targets.items():
                    if symbol != OTHER:
                        dense[state, symbol] = base + target
            dense[:, self.pad] = base + np.arange(len(moves))
            self.roots.append(base)
            weights.append(np.log2(len(symbols) + 2))
            parts.append(dense)
            base += len(moves)
        self.moves = np.concatenate(parts).reshape(-1) if parts else np.zeros(0, np.int32)
        self.weights = np.array(weights)

    def symbols(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        coded = np.where(codes < 0x10000, self.table[np.minimum(codes, 0xFFFF)], BLANK)
        blank = coded == BLANK
        keep = ~blank
        keep[1:] |= blank[1:] & ~blank[:-1]
        return coded[keep]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Weighed phrases per text (row) and language (column)."""
        coded = [self.symbols(t) for t in texts]
        blocks = [-(-len(c) // BLOCK) for c in coded]
        lanes = np.full((sum(blocks), BLOCK), self.pad, np.int32)
        at = 0
        for symbols, n in zip(coded, blocks, strict=True):
            lanes[at : at + n].reshape(-1)[: len(symbols)] = symbols
            at += n
        columns = np.ascontiguousarray(lanes.T)
        roots = np.array(self.roots, np.int32)[:, None]
        fresh = self.moves.reshape(-1, self.width)[self.roots]
        fresh = np.where(fresh < 0, roots, fresh)
        unknown = fresh == roots
        state = np.repeat(roots, len(lanes), axis=1)
        counts = np.zeros(state.shape, np.int32)
        for symbols in columns:
            following = self.moves[state * self.width + symbols]
            failed = following < 0
            counts += failed
            counts += failed & unknown[:, symbols] & (state != roots)  # the phrase before, and the symbol alone
            state = np.where(failed, fresh[:, symbols], following)
        counts += state != roots
        owner = np.repeat(np.arange(len(texts)), blocks)
        out = np.zeros((len(texts), len(self.names)))
        for k in range(len(self.names)):
            out[:, k] = np.bincount(owner, counts[k], len(texts)) * self.weights[k]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A language and a score per text; ``und`` and 0 for a null text or one without a letter."""
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        real = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if real and self.names:
            costs = self.phrases([texts[i] for i in real])
            best = costs.argmin(axis=1)
            gaps = (costs - costs[np.arange(len(real)), best][:, None]) / self.weights.max()
            sure = 1 / np.exp(-np.minimum(gaps, 50)).sum(axis=1)
            for i, k, s in zip(real, best, sure, strict=True):
                names[i], scores[i] = self.names[k], float(s)
        return names, scores


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Parser:
    """A parser from rows with a text and a language; see ``SAMPLE_TEXTS`` for the bounds of the sample."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna().withColumn("draw", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy("draw")
    chosen = rows.select("lang", "draw").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_TEXTS).drop("n")
    # At most SAMPLE_TEXTS rows a language: safe to broadcast and to collect.
    sample = rows.join(F.broadcast(chosen), ["lang", "draw"]).select("lang", "draw", F.substring("text", 1, TEXT_CHARS).alias("text"))
    texts: dict[str, list[str]] = {}
    for row in sample.dropDuplicates(["lang", "draw"]).orderBy("lang", "draw").collect():
        texts.setdefault(row["lang"], []).append(row["text"])
    return Parser({lang: "\n".join(parts) for lang, parts in texts.items()})


def languages(docs: DataFrame, parser: Parser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of each row, from the text alone.

    Defined cases: a null text, or one without a letter, is ``und`` with score 0;
    ties go to the first language by name; repeated rows and null keys each keep
    their row; an empty table gives no row; without any learned language all rows
    are ``und``; other columns are ignored. Whole texts are parsed. No shuffle.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = shared.value.predict(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_arrow(rows, predict, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
