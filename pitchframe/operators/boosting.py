"""Gradient-boosted trees over binned features, with missing values.

Rows are turned once into small bin numbers and written. A level of all trees of
a round is one pass: partitions add up gradients per class, node, feature and
bin, sums meet in one aggregation, and the driver picks splits from a table
whose size depends on the model and not on the rows. A missing value has a bin
of its own and goes to whichever side of a split gains more.

Gradients are rounded to whole multiples of 2^-20 before they are added, so sums
don't depend on the order of rows or partitions and a recomputed task gives the
same trees. Several models with different settings grow in the same passes.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchframe.operators.models import ClassScores
from pitchframe.operators.ordered import written
from pitchframe.session import ship

MISSING = 255
MOST_TEXTS = 254  # values of a text feature with a bin of their own, the most frequent ones; others count as missing
UNIT = float(2**20)
REFRESH = 10  # rounds after which the scores so far are written, so that no pass sums up more trees than that


@dataclass(frozen=True)
class Setting:
    """Parameters of one model, named as in the parameter registry."""

    max_depth: int = 3
    min_child_weight: float = 1.0
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    learning_rate: float = 0.3
    n_estimators: int = 20
    reg_lambda: float = 1.0


@dataclass
class Tree:
    """Nodes in heap order: the feature (-1 in a leaf), the last bin that goes left, where missing values go, the leaf's score."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n))

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The node where each row stands: a leaf, or a node that is still open."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(int(math.log2(len(self.feature) + 1)) - 1):
            feature = self.feature[at]
            held = bins[rows, np.maximum(feature, 0)]
            left = np.where(held == MISSING, self.missing_left[at], held <= self.cut[at])
            at = np.where(feature < 0, at, 2 * at + 2 - left)
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.places(bins)]

    def signature(self) -> tuple:
        """The same for trees that split alike and score alike, however deep they might still grow."""
        nodes = np.flatnonzero(self.feature >= 0).tolist()
        splits = tuple((i, int(self.feature[i]), int(self.cut[i]), bool(self.missing_left[i])) for i in nodes)
        return splits, tuple((i, float(v)) for i, v in enumerate(self.value.tolist()) if v)


@dataclass
class Binning:
    """Cut points of numeric and known values of text features."""

    numeric: list[str]
    text: list[str]
    cuts: dict[str, np.ndarray]
    values: dict[str, dict[str, int]]

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.text]

    def inputs(self) -> list:
        return [F.col(c).cast("double").alias(f"__n{i}") for i, c in enumerate(self.numeric)] + [
            F.col(c).cast("string").alias(f"__t{i}") for i, c in enumerate(self.text)
        ]

    def size(self, feature: int) -> int:
        """Bins of a feature by its place, without the one of missing values."""
        return len(self.cuts[self.numeric[feature]]) + 1 if feature < len(self.numeric) else len(self.values[self.text[feature - len(self.numeric)]])

    def bins(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.full((batch.num_rows, len(self.features)), MISSING, np.uint8)
        for i, c in enumerate(self.numeric):
            x = batch.column(f"__n{i}").to_numpy(zero_copy_only=False).astype(np.float64)
            out[:, i] = np.where(np.isnan(x), MISSING, np.searchsorted(self.cuts[c], x, "left"))
        for i, c in enumerate(self.text, len(self.numeric)):
            known = self.values[c]
            texts = batch.column(f"__t{i - len(self.numeric)}").dictionary_encode()
            codes = np.array([known.get(v, MISSING) for v in texts.dictionary.to_pylist()] + [MISSING], np.uint8)
            out[:, i] = codes[texts.indices.fill_null(len(codes) - 1).to_numpy(zero_copy_only=False)]
        return out


def fit_binning(train: DataFrame, numeric: Sequence[str], text: Sequence[str] = (), bins: int = 32) -> Binning:
    """Quantile cut points, and the most frequent values of each text feature in alphabetical order."""
    shares = [k / bins for k in range(1, bins)]
    cuts: dict[str, np.ndarray] = {}
    if numeric:
        present = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in numeric]
        row = train.agg(*[F.percentile_approx(p, shares, 10_000).alias(f"q{i}") for i, p in enumerate(present)]).first()
        cuts = {c: np.unique(np.array(row[f"q{i}"] or [], np.float64)) for i, c in enumerate(numeric)}
    values: dict[str, dict[str, int]] = {c: {} for c in text}
    if text:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in text])
        counts = train.select(F.inline(cells)).where("value IS NOT NULL").groupBy("column", "value").count()
        rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
        found: dict[str, list[str]] = {c: [] for c in text}
        for r in counts.withColumn("at", rank).where(F.col("at") <= MOST_TEXTS).collect():
            found[r["column"]].append(r["value"])
        values = {c: {v: i for i, v in enumerate(sorted(v))} for c, v in found.items()}
    return Binning(list(numeric), list(text), cuts, values)


def _binned(df: DataFrame, binning: Binning, classes: Sequence[str], target: str) -> DataFrame:
    """``row, label, bins, scores`` of the rows whose class is known: a hash of the row, class number and bin numbers.

    They are dealt evenly to the cores, as every pass reads them and an ordered
    split may leave up to a million rows in one partition.
    """
    ship(df.sparkSession)
    names = F.array(*[F.lit(c) for c in classes])
    label = (F.array_position(names, F.col(target).cast("string")) - 1).cast("int")
    rows = df.select(F.xxhash64(*df.columns).alias("row"), label.alias("label"), *binning.inputs()).where("label >= 0")
    rows = rows.repartition(df.sparkSession.sparkContext.defaultParallelism)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binning.bins(batch)
            packed = pa.array([b.tobytes() for b in bins], pa.binary())
            none = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("label"), packed, none], names=["row", "label", "bins", "scores"])

    return written(rows.mapInArrow(convert, "row long, label int, bins binary, scores binary"), "binned")


@dataclass
class Boosted(ClassScores):
    """A fitted model: per round one tree per class, added to the classes' first scores."""

    target: str
    classes: list[str]
    binning: Binning
    first: np.ndarray
    setting: Setting
    rounds: list[list[Tree]] = field(default_factory=list)
    gains: np.ndarray | None = None

    def document(self) -> dict:
        """Everything a copy needs, as plain values."""
        trees = [[{k: v.tolist() for k, v in vars(t).items()} for t in trees] for trees in self.rounds]
        cuts = {c: v.tolist() for c, v in self.binning.cuts.items()}
        binning = {"numeric": self.binning.numeric, "text": self.binning.text, "cuts": cuts, "values": self.binning.values}
        gains = None if self.gains is None else self.gains.tolist()
        own = {"target": self.target, "classes": self.classes, "first": self.first.tolist(), "setting": vars(self.setting)}
        return own | {"binning": binning, "rounds": trees, "gains": gains}

    @classmethod
    def from_document(cls, stored: Mapping) -> Boosted:
        kept = stored["binning"]
        binning = Binning(kept["numeric"], kept["text"], {c: np.array(v, np.float64) for c, v in kept["cuts"].items()}, kept["values"])
        rounds = [[Tree(*[np.array(t[k]) for k in ("feature", "cut", "missing_left", "value")]) for t in trees] for trees in stored["rounds"]]
        gains = None if stored["gains"] is None else np.array(stored["gains"])
        return cls(stored["target"], stored["classes"], binning, np.array(stored["first"]), Setting(**stored["setting"]), rounds, gains)

    def signature(self) -> tuple:
        return tuple(t.signature() for trees in self.rounds for t in trees)

    def raw(self, bins: np.ndarray, rounds: Sequence[list[Tree]] | None = None) -> np.ndarray:
        out = np.tile(self.first, (len(bins), 1)) if rounds is None else np.zeros((len(bins), len(self.classes)))
        for trees in self.rounds if rounds is None else rounds:
            for k, tree in enumerate(trees):
                out[:, k] += tree.scores(bins)
        return out

    def probabilities(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probabilities`` in class order and the likeliest class; missing and unseen values are scored too."""
        ship(df.sparkSession)
        n = len(df.columns)
        fields = [*df.schema.fields, T.StructField("probabilities", T.ArrayType(T.DoubleType())), T.StructField("predicted", T.StringType())]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = softmax(self.raw(self.binning.bins(batch)))
                best = pa.array([self.classes[k] for k in p.argmax(axis=1)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(list(p), pa.list_(pa.float64())), best], names=[f.name for f in fields])

        return df.select("*", *self.binning.inputs()).mapInArrow(score, T.StructType(fields))

    def importances(self, spark) -> DataFrame:
        """Share of the total gain per feature, largest first."""
        gains = np.zeros(len(self.binning.features)) if self.gains is None else self.gains
        rows = [(name, float(g / gains.sum()) if gains.sum() else 0.0) for name, g in zip(self.binning.features, gains, strict=True)]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _hashed(rows: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from row hashes."""
    x = rows.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


def _state(batch: pa.RecordBatch, models: Sequence[Boosted], since: int, wanted: Collection[int] | None = None) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Bin numbers, class numbers and the raw scores of the models wanted, all by default: written ones plus the trees grown since."""
    n = batch.num_rows
    bins = _unpacked(batch.column("bins"), np.uint8).reshape(n, -1)
    label = batch.column("label").to_numpy(zero_copy_only=False)
    k = len(models[0].classes)
    named = range(len(models)) if wanted is None else sorted(wanted)
    if since:
        held = _unpacked(batch.column("scores"), np.float64).reshape(n, len(models), k)
        return bins, label, {i: held[:, i] + models[i].raw(bins, models[i].rounds[since:]) for i in named}
    return bins, label, {i: models[i].raw(bins) for i in named}


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _alike(items: Mapping[int, object]) -> dict[int, int]:
    """Each key with the first key whose value is the same."""
    first: dict[object, int] = {}
    return {m: first.setdefault(v, m) for m, v in items.items()}


def _histograms(rows: DataFrame, models: Sequence[Boosted], growing: Mapping[int, list[Tree]], since: int, number: int, level: int) -> dict:
    """(model, class) -> array (node of the level, feature, bin, gradient and curvature), over the rows in each model's sample.

    Models that have the same trees so far and draw the same sample have the same
    sums: one of them is added up for all. Scores are likewise made once for
    models that agree in their finished trees.
    """
    classes, width = len(models[0].classes), len(models[0].binning.features)
    nodes = 2**level
    grown = {m: models[m].signature() for m in growing}
    scored = _alike(grown)
    shown = _alike({m: (grown[m], models[m].setting.subsample, tuple(t.signature() for t in trees)) for m, trees in growing.items()})
    each = {m: growing[m] for m in dict.fromkeys(shown.values())}
    # Bins in use lie side by side: those up to the last cut point or value of a feature, and the one of missing values.
    used = [models[0].binning.size(f) for f in range(width)]
    starts = np.concatenate([[0], np.cumsum([u + 1 for u in used])])
    cells = int(starts[-1])
    spread = {m: i for i, m in enumerate(each)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(each), classes, 2, nodes * cells))
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, label, scores = _state(batch, models, since, {scored[m] for m in each})
            hashes = batch.column("row").to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.where(bins == MISSING, np.array(used), bins) + starts[:-1]
            likely = {m: softmax(scores[m]) for m in {scored[m] for m in each}}
            slopes: dict = {}
            for m, trees in each.items():
                share = models[m].setting.subsample
                if (scored[m], share) not in slopes:
                    taken = slice(None) if share >= 1 else _hashed(hashes, number) < share
                    p, y = likely[scored[m]][taken], label[taken]
                    slopes[scored[m], share] = taken, np.rint((p - (y[:, None] == np.arange(classes))) * UNIT), np.rint(p * (1 - p) * UNIT)
                taken, g, h = slopes[scored[m], share]
                own, where = bins[taken], flat[taken]
                for k, tree in enumerate(trees):
                    at = tree.places(own) - (nodes - 1)
                    open_ = at >= 0
                    if not open_.any():
                        continue
                    whole = open_.all()
                    cell = (at[:, None] * cells + where if whole else at[open_, None] * cells + where[open_]).ravel()
                    for j, x in enumerate((g, h)):
                        total[spread[m], k, j] += np.bincount(cell, np.repeat(x[:, k] if whole else x[open_, k], width), nodes * cells)
        held = np.nonzero(total.any(axis=2))
        cell = np.ravel_multi_index(held, (len(each), classes, nodes * cells))
        sums = [pa.array(total[held[0], held[1], j, held[2]].astype(np.int64), pa.int64()) for j in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), *sums], names=["cell", "g", "h"])

    found = rows.mapInArrow(add, "cell long, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    m, k, at = np.unravel_index(found["cell"].to_numpy(), (len(each), classes, nodes * cells))
    node, cell = np.divmod(at, cells)
    feature = np.searchsorted(starts, cell, "right") - 1
    held = cell - starts[feature]
    held = np.where(held == np.array(used)[feature], MISSING, held)
    tables = np.zeros((len(each), classes, nodes, width, 256, 2))
    for j, name in enumerate(("g", "h")):
        tables[m, k, node, feature, held, j] = found[name].to_numpy() / UNIT
    return {(m, k): tables[spread[shown[m]], k] for m in growing for k in range(classes)}


def _leaf(g: float, h: float, setting: Setting) -> float:
    return -g / (h + setting.reg_lambda) * setting.learning_rate


def _best_split(table: np.ndarray, allowed: np.ndarray, setting: Setting) -> tuple[float, int, int, bool] | None:
    """Gain, feature, last bin to the left and the side of missing values; the first of equal gains. None if nothing gains."""
    quality = lambda g, h: g * g / (h + setting.reg_lambda)
    whole = table[0].sum(axis=0)
    best = None
    for f in np.flatnonzero(allowed):
        lost, running = table[f, MISSING], table[f, :MISSING].cumsum(axis=0)
        for missing_left in (True, False):
            left = running + lost if missing_left else running
            right = whole - left
            gain = quality(left[:, 0], left[:, 1]) + quality(right[:, 0], right[:, 1]) - quality(whole[0], whole[1])
            gain = np.where((left[:, 1] >= setting.min_child_weight) & (right[:, 1] >= setting.min_child_weight), gain, 0.0)
            at = int(gain.argmax())
            if gain[at] > 1e-9 and (best is None or gain[at] > best[0] + 1e-9):
                best = (float(gain[at]), int(f), at, missing_left)
    return best


def _grow(tree: Tree, table: np.ndarray, level: int, model: Boosted, allowed: np.ndarray) -> None:
    """Split the nodes of a level, and give both children of a split the score they have as leaves."""
    setting = model.setting
    for node in range(2**level):
        at = 2**level - 1 + node
        if level and tree.feature[(at - 1) // 2] < 0:
            continue
        sums = table[node]
        g, h = sums[0].sum(axis=0)
        if not level:
            tree.value[at] = _leaf(g, h, setting)
        split = _best_split(sums, allowed, setting)
        if split is None:
            continue
        gain, feature, cut, missing_left = split
        left = sums[feature, : cut + 1].sum(axis=0) + (sums[feature, MISSING] if missing_left else 0)
        right = sums[feature].sum(axis=0) - left
        tree.feature[at], tree.cut[at], tree.missing_left[at] = feature, cut, missing_left
        for child, (cg, ch) in ((2 * at + 1, left), (2 * at + 2, right)):
            tree.value[child] = _leaf(cg, ch, setting)
        model.gains[feature] += gain


def _with_scores(rows: DataFrame, models: Sequence[Boosted], since: int) -> DataFrame:
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, scores = _state(batch, models, since) if batch.num_rows else (0, 0, {})
            packed = [s.tobytes() for s in np.stack(list(scores.values()), axis=1)] if scores else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], names=["row", "label", "bins", "scores"])

    return written(rows.mapInArrow(convert, rows.schema), "scores")


def fit_many(binned: DataFrame, target: str, classes: Sequence[str], binning: Binning, settings: Sequence[Setting]) -> list[Boosted]:
    """One model per setting over the rows of ``binned``, grown in the same passes."""
    counts = {r["label"]: r["count"] for r in binned.groupBy("label").count().collect()}
    total = sum(counts.values())
    first = np.log([(counts.get(k, 0) + 1) / (total + len(classes)) for k in range(len(classes))])
    models = [Boosted(target, list(classes), binning, first, s, gains=np.zeros(len(binning.features))) for s in settings]
    since = 0
    for number in range(max((s.n_estimators for s in settings), default=0) if total else 0):
        if number - since == REFRESH:
            binned, since = _with_scores(binned, models, since), number
        growing = {m: [Tree.empty(s.max_depth) for _ in classes] for m, s in enumerate(settings) if number < s.n_estimators}
        allowed = {m: _columns(len(binning.features), settings[m].colsample_bytree, number) for m in growing}
        for level in range(max(settings[m].max_depth for m in growing)):
            deeper = {m: trees for m, trees in growing.items() if level < settings[m].max_depth}
            open_ = {m: t for m, t in deeper.items() if not level or any((x.feature[2 ** (level - 1) - 1 : 2**level - 1] >= 0).any() for x in t)}
            if not open_:
                break
            for (m, k), table in _histograms(binned, models, open_, since, number, level).items():
                _grow(open_[m][k], table, level, models[m], allowed[m])
        for m, trees in growing.items():
            models[m].rounds.append(trees)
    return models


def _columns(width: int, share: float, number: int) -> np.ndarray:
    """The features a round may split on: the first by a hash of the round, at least one."""
    order = np.argsort(_hashed(np.arange(width, dtype=np.int64), -number - 1), kind="stable")
    allowed = np.zeros(width, bool)
    allowed[order[: max(1, round(share * width))]] = True
    return allowed


def class_names(train: DataFrame, target: str) -> list[str]:
    rows = train.select(F.col(target).cast("string").alias("c")).where("c IS NOT NULL").distinct().collect()
    return sorted(r["c"] for r in rows)


def fit_boosted(train: DataFrame, target: str, numeric: Sequence[str], text: Sequence[str] = (), setting: Setting | None = None, bins: int = 32) -> Boosted:
    """Boosted trees for the classes of ``target``; rows without a class are left out, missing features are used."""
    binning, classes = fit_binning(train, numeric, text, bins), class_names(train, target)
    binned = _binned(train, binning, classes, target)
    return fit_many(binned, target, classes, binning, [setting or Setting()])[0]


def losses(binned: DataFrame, models: Sequence[Boosted], unknown: int = 0) -> list[float]:
    """Mean negative log of the probability given to the true class, of every model in one pass.

    ``unknown`` rows of classes that no model knows count with probability 0, clipped as usual.
    """
    least = 2.220446049250313e-16

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(models)), 0
        for batch in batches:
            if batch.num_rows:
                bins, label, scores = _state(batch, models, 0)
                n += len(label)
                for m, raw in scores.items():
                    total[m] -= np.log(np.clip(softmax(raw)[np.arange(len(label)), label], least, 1 - least)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(models)), pa.int64()), pa.array(total), pa.array([n] * len(models), pa.int64())], names=["m", "loss", "n"])

    rows = binned.mapInArrow(add, "m long, loss double, n long").groupBy("m").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).collect()
    of = {r["m"]: (r["loss"] - unknown * math.log(least)) / (r["n"] + unknown) if r["n"] + unknown else math.nan for r in rows}
    return [of.get(m, math.nan) for m in range(len(models))]


# Fixed shape of the greedy search: three groups of two parameters, three values each, 27 fits.
GREEDY_GROUPS = [
    {"max_depth": [2, 3, 5], "min_child_weight": [1, 3, 5]},
    {"subsample": [0.5, 0.7, 0.9], "colsample_bytree": [0.5, 0.7, 0.9]},
    {"learning_rate": [0.01, 0.05, 0.1], "n_estimators": [50, 100, 200]},
]


def greedy_search(
    train: DataFrame,
    test: DataFrame,
    target: str,
    numeric: Sequence[str],
    text: Sequence[str] = (),
    groups: Sequence[Mapping[str, Sequence[object]]] = tuple(GREEDY_GROUPS),
    start: Setting | None = None,
) -> tuple[Setting, list[tuple[int, Setting, float]]]:
    """Grid search group by group; the best setting of a group is kept for the next ones.

    Returns the best setting and every trial with its log loss on the test rows;
    the first one wins ties. Rows are binned once, and all settings of a group
    grow in the same passes.
    """
    binning, classes = fit_binning(train, numeric, text), class_names(train, target)
    fit_rows, test_rows = _binned(train, binning, classes, target), _binned(test, binning, classes, target)
    known = F.col(target).cast("string").isin(classes)
    unknown = test.where(F.col(target).isNotNull() & ~known).count()
    best, trials = start or Setting(), []
    for number, group in enumerate(groups):
        settings = [replace(best, **dict(zip(group, values, strict=True))) for values in product(*group.values())]
        found = losses(test_rows, fit_many(fit_rows, target, classes, binning, settings), unknown)
        trials += [(number, s, loss) for s, loss in zip(settings, found, strict=True)]
        best = settings[int(np.argmin(found))]
    return best, trials
