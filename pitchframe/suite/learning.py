"""Clusters, classifiers, searches and regressors."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchframe.operators import boosting, metrics, models
from pitchframe.operators.encode import balance_classes
from pitchframe.operators.ordered import written
from pitchframe.operators.split import ordered_split
from pitchframe.operators.standardize import standard_scale
from pitchframe.plans.features import pitch_outcome_set
from pitchframe.plans.scores import contact_scores, strike_scores, strike_zones
from pitchframe.sources.tables import read_table
from pitchframe.suite import register
from pitchframe.suite.features import hit_class_rows, pitch_sequence_rows
from pitchframe.suite.standin import PITCH_SQL, pitches

_NUMERIC = ["release_speed", "release_spin_rate", "plate_x", "plate_z", "strikes", "balls"]
_TARGET = "pitch_outcome"
_ORDER = ["game_date", "game_pk", "at_bat_number", "pitch_number"]


def _split(spark, folder):
    return _later(pitch_outcome_set(pitches(spark, folder)), _ORDER)


@register("M6 A1 M4")
def strike_zone_clusters(spark, folder):
    zones = strike_zones(pitches(spark, folder), digits=None)
    return models.cluster(zones, ["sz_top", "sz_bot"], 10, seed=1).select("batter", "cluster")


@register(
    "M6 A1 M4",
    f"""WITH {PITCH_SQL} SELECT batter, true AS is_nearest FROM pitches WHERE sz_top IS NOT NULL AND sz_bot IS NOT NULL GROUP BY batter""",
)
def strike_zone_centres(spark, folder):
    """Every batter's zone is nearest to the mean of its own cluster, in standardised columns."""
    names = ["sz_top", "sz_bot"]
    found = standard_scale(models.cluster(strike_zones(pitches(spark, folder), digits=None), names, 10, seed=1), names)
    scaled = [f"{c}_scaled" for c in names]
    centres = found.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in scaled])
    listed = centres.agg(F.collect_list(F.struct("cluster", *scaled))).scalar()  # ten entries
    far = lambda c: F.pow(F.col(scaled[0]) - c[scaled[0]], 2) + F.pow(F.col(scaled[1]) - c[scaled[1]], 2)
    placed = found.withColumn("_centres", listed)
    least = F.array_min(F.transform("_centres", far))
    own = F.filter("_centres", lambda c: c["cluster"] == F.col("cluster"))
    return placed.select("batter", (far(F.get(own, F.lit(0))) <= least + 1e-9).alias("is_nearest"))


@register("M11 M15")
def pitch_outcome_probabilities(spark, folder):
    """Class probabilities of the later fifth of the pitches, one row per pitch and class."""
    train, test = _split(spark, folder)
    fitted = models.fit_classifier(train, _TARGET, _NUMERIC, ["p_throws"])
    return fitted.long_probabilities(test, ["game_pk", "at_bat_number", "pitch_number"])


@register("M11 M15 M16")
def drawn_pitch_outcomes(spark, folder):
    """One outcome per later pitch, drawn from its probabilities with batter rates as features."""
    from pitchframe.operators.sampling import hashed_uniform, pick_class

    train, test = _split(spark, folder)
    classes = ["ball", "foul", "hit_by_pitch", "hit_into_play", "strike"]
    rates = [f"rate_{c}" for c in classes]
    # A training row takes its batter's rates from the other folds, a later row from all training rows.
    own = models.out_of_fold_rates(train, "batter", _TARGET, classes, F.col("at_bat_number") % 5)
    own = written(own.select(_TARGET, *_NUMERIC, *rates, "p_throws"), "rated")
    fitted = models.fit_classifier(own, _TARGET, [*_NUMERIC, *rates], ["p_throws"], models.softmax(maxIter=20))
    scored = fitted.probabilities(models.entity_rates(train, test, "batter", _TARGET, classes))
    u = hashed_uniform("game_pk", "at_bat_number", "pitch_number", seed=5)
    drawn = scored.withColumn("drawn", pick_class(F.col("probabilities"), fitted.classes, u))
    return drawn.groupBy(_TARGET, "drawn").agg(F.count(F.lit(1)).alias("n"))


_CLASSES = ["ball", "foul", "hit_by_pitch", "hit_into_play", "strike"]
_OUTCOME_SQL = """CASE WHEN description IN ('called_strike', 'foul_tip') THEN 'strike' WHEN description = 'foul' THEN 'foul'
      WHEN description IN ('ball', 'blocked_ball') THEN 'ball' WHEN description IN ('hit_by_pitch', 'hit_into_play') THEN description END"""


@register(
    "M11 A2",
    f"""WITH {PITCH_SQL},
    p AS (SELECT batter, at_bat_number, pitch_number, at_bat_number % 5 AS fold, {_OUTCOME_SQL} AS c FROM pitches
      WHERE release_speed IS NOT NULL AND release_spin_rate IS NOT NULL AND plate_x IS NOT NULL AND plate_z IS NOT NULL AND p_throws IS NOT NULL AND strikes IS NOT NULL AND balls IS NOT NULL),
    q AS (SELECT * FROM p WHERE c IS NOT NULL),
    f AS (SELECT batter, fold, count(*) AS n, {", ".join(f"count(*) FILTER (c = '{c}') AS c{i}" for i, c in enumerate(_CLASSES))} FROM q GROUP BY ALL),
    o AS (SELECT *, sum(n) OVER (PARTITION BY batter) - n AS n_o, {", ".join(f"sum(c{i}) OVER (PARTITION BY batter) - c{i} AS o{i}" for i in range(5))} FROM f),
    a AS (SELECT fold, (SELECT sum(n) FROM f) - sum(n) AS n_a, {", ".join(f"(SELECT sum(c{i}) FROM f) - sum(c{i}) AS a{i}" for i in range(5))} FROM f GROUP BY fold)
    SELECT at_bat_number, pitch_number, {", ".join(f"round((o{i} + a{i} / n_a * 20) / (n_o + 20), 9) AS rate_{c}" for i, c in enumerate(_CLASSES))}
    FROM q JOIN o USING (batter, fold) JOIN a USING (fold)""",
)
def out_of_fold_batter_rates(spark, folder):
    """A batter's smoothed outcome shares without the pitches of the row's own fold."""
    rows = pitch_outcome_set(pitches(spark, folder))
    rated = models.out_of_fold_rates(rows, "batter", _TARGET, _CLASSES, F.col("at_bat_number") % 5)
    return rated.select("at_bat_number", "pitch_number", *[F.round(f"rate_{c}", 9).alias(f"rate_{c}") for c in _CLASSES])


def _against_frequencies(train, test, target, fitted, name):
    """Whether the later rows are likelier under the model than under the training frequencies, and all probabilities add up."""
    scored = metrics.with_baseline_probability(train, fitted.with_true_probability(test), target)
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p)
    loss = lambda p: F.avg(-F.log(F.greatest(p, F.lit(1e-15))))
    return scored.agg(
        F.lit(name).alias("model"),
        (loss(F.col("p_true")) < loss(F.coalesce("p_baseline", F.lit(0.0)))).alias("below_baseline"),
        (F.max(F.abs(total - 1)) < 1e-9).alias("sums_to_one"),
    )


def _later(rows, order):
    """Earlier and later rows. The marked rows are written, as every step of a fit reads them: the split is ordered once."""
    marked = written(ordered_split(rows, [], order, 0.2), "split")
    return marked.where("is_train").drop("is_train"), marked.where("NOT is_train").drop("is_train")


@register("M11 M15 M17 M18", "SELECT 'hit class' AS model, true AS below_baseline, true AS sums_to_one")
def boosted_hit_classes(spark, folder):
    """Boosted trees over the hit class set with its missing speeds and fielding strengths."""
    numeric = ["outs_when_up", "on_1b", "on_2b", "on_3b", "launch_speed", "launch_angle", "spray_angle", "speed", "oaa"]
    train, test = _later(hit_class_rows(spark, folder), _ORDER)
    fitted = boosting.fit_boosted(train, "simplified_outcome", numeric, ["stand"], boosting.Setting(n_estimators=8))
    return _against_frequencies(train, test, "simplified_outcome", fitted, "hit class")


@register("M11 M15 M17 M18", "SELECT 'pitch choice' AS model, true AS below_baseline, true AS sums_to_one")
def boosted_pitch_choice(spark, folder):
    """Boosted trees over the pitch sequence set, whose previous pitch and scores are often missing.

    The stand-in's pitch types are drawn evenly, so a preference by count is put in: with two strikes mostly the second type.
    """
    rows = pitches(spark, folder)
    leaning = F.when((F.col("strikes") == 2) & (F.col("event_id") % 5 > 0) & F.col("pitch_type").isNotNull(), "SL").otherwise(F.col("pitch_type"))
    rows = rows.withColumn("pitch_type", leaning)
    built = pitch_sequence_rows(rows, strike_scores(rows, minimum=15), contact_scores(rows, minimum=3))
    scores = [c for c in built.columns if c.endswith(("_strike", "_woba"))]
    numeric = ["strikes", "balls", "outs_when_up", "on_1b", "on_2b", "on_3b", "cumulative_pitch_number", *scores]
    train, test = _later(built, _ORDER)
    fitted = boosting.fit_boosted(train, "pitch_type", numeric, ["stand", "prev_pitch"], boosting.Setting(n_estimators=6))
    return _against_frequencies(train, test, "pitch_type", fitted, "pitch choice")


@register("M12 M17")
def greedy_parameter_search(spark, folder):
    train, test = _split(spark, folder)
    groups = [
        {"maxDepth": [2, 4], "minInstancesPerNode": [1, 5]},
        {"subsamplingRate": [0.5, 0.9]},
        {"numTrees": [5, 10]},
    ]
    _, trials = models.greedy_search(train, test, _TARGET, _NUMERIC, ["p_throws"], groups)
    rows = [(group, str(sorted(setting.items())), loss) for group, setting, loss in trials]
    return spark.createDataFrame(rows, "parameter_group int, setting string, log_loss double")


@register(
    "M12 M14 M17",
    "SELECT CAST(g AS INTEGER) AS parameter_group, CAST(9 AS BIGINT) AS fits, true AS best_is_carried FROM (VALUES (0), (1), (2)) t(g)",
)
def full_parameter_search(spark, folder):
    """All 27 fits of the greedy search, after each side has got the classes it lacks; the numbers of trees are small ones."""
    train, test = _split(spark, folder)
    train, test = balance_classes(train, test, _TARGET, _ORDER)
    groups = [*boosting.GREEDY_GROUPS[:2], {"learning_rate": [0.01, 0.05, 0.1], "n_estimators": [2, 4, 6]}]
    best, trials = boosting.greedy_search(train, test, _TARGET, _NUMERIC, ["p_throws"], groups, boosting.Setting(n_estimators=3))
    rows = []
    for number, group in enumerate(groups):
        own = [(s, loss) for g, s, loss in trials if g == number]
        chosen = min(own, key=lambda t: t[1])[0]
        later = [s for g, s, _ in trials if g > number] + [best]
        rows.append((number, len(own), all(getattr(s, name) == getattr(chosen, name) for s in later for name in group)))
    return spark.createDataFrame(rows, "parameter_group int, fits long, best_is_carried boolean")


@register("M13")
def cross_validated_search(spark, folder):
    train, _ = _split(spark, folder)
    _, results = models.cross_validate(
        train, _TARGET, _NUMERIC, ["p_throws"], models.forest(numTrees=5), {"maxDepth": [2, 4]}, folds=3
    )
    return spark.createDataFrame([(str(sorted(s.items())), m) for s, m in results], "setting string, log_loss double")


_LATER_SQL = f"""p AS (SELECT game_pk, at_bat_number, pitch_number, game_date, {_OUTCOME_SQL} AS c FROM pitches
      WHERE release_speed IS NOT NULL AND release_spin_rate IS NOT NULL AND plate_x IS NOT NULL AND plate_z IS NOT NULL AND p_throws IS NOT NULL),
    o AS (SELECT *, row_number() OVER (ORDER BY game_date, game_pk, at_bat_number, pitch_number) > count(*) OVER () - ceil(count(*) OVER () * 0.2E0) AS later FROM p WHERE c IS NOT NULL)"""


@register(
    "M11 M15",
    f"""WITH {PITCH_SQL}, {_LATER_SQL} SELECT game_pk, at_bat_number, pitch_number, CAST(5 AS BIGINT) AS classes, 1.0E0 AS total FROM o WHERE later""",
)
def pitch_outcome_totals(spark, folder):
    """The class probabilities of every later pitch add up to one."""
    keys = ["game_pk", "at_bat_number", "pitch_number"]
    inside = F.count_if(F.col("probability").between(0, 1)).alias("classes")
    return pitch_outcome_probabilities(spark, folder).groupBy(*keys).agg(inside, F.round(F.sum("probability"), 9).alias("total"))


@register(
    "M18 M17 M11",
    f"""WITH {PITCH_SQL}, {_LATER_SQL},
    b AS (SELECT c, count(*) / (SELECT count(*) FROM o WHERE NOT later) AS p FROM o WHERE NOT later GROUP BY c)
    SELECT count(*) AS n, round(sum(ln(greatest(coalesce(p, 1e-15), 1e-15))), 4) AS baseline_log_likelihood, true AS model_is_better FROM o LEFT JOIN b ON o.c = b.c WHERE later""",
)
def model_against_baseline(spark, folder):
    """Log likelihood of the training frequencies on the later pitches, and whether the classifier's is higher."""
    train, test = _split(spark, folder)
    fitted = models.fit_classifier(train, _TARGET, _NUMERIC, ["p_throws"])
    scored = metrics.with_baseline_probability(train, fitted.with_true_probability(test), _TARGET)
    floor = F.lit(1e-15)
    likelihood = lambda p: F.sum(F.log(F.greatest(p, floor)))
    base = likelihood("p_baseline")
    return scored.agg(
        F.count(F.lit(1)).alias("n"), F.round(base, 4).alias("baseline_log_likelihood"), (likelihood("p_true") > base).alias("model_is_better")
    )


@register("M22")
def feature_importances(spark, folder):
    train, _ = _split(spark, folder)
    return models.fit_classifier(train, _TARGET, _NUMERIC, ["p_throws"]).importances(spark)


@register("M23")
def regression_quality(spark, folder):
    """R squared and error of a tree and a ridge model per target."""
    lines = read_table(spark, folder, "lineitem")
    targets, features = ["l_extendedprice", "l_tax"], ["l_quantity", "l_discount", "l_linenumber"]
    reports = []
    for kind in ("tree", "ridge"):
        fitted = models.fit_regressors(lines, targets, features, kind)
        scored = models.residuals(lines, fitted, features)
        reports.append(models.regression_report(scored, targets).withColumn("kind", F.lit(kind)))
    return reports[0].unionByName(reports[1])


@register(
    "M23",
    """WITH m AS (SELECT avg(l_extendedprice) AS my, stddev_pop(l_extendedprice) AS sy, avg(l_quantity) AS ma, stddev_pop(l_quantity) AS sa, avg(l_discount) AS mb, stddev_pop(l_discount) AS sb,
           corr(l_extendedprice, l_quantity) AS ya, corr(l_extendedprice, l_discount) AS yb, corr(l_quantity, l_discount) AS ab, 1 + 0.1E0 / stddev_pop(l_extendedprice) AS d FROM lineitem),
    w AS (SELECT *, (ya * d - ab * yb) / (d * d - ab * ab) * sy / sa AS wa, (yb * d - ab * ya) / (d * d - ab * ab) * sy / sb AS wb FROM m),
    h AS (SELECT l_orderkey, l_linenumber, l_extendedprice, my + wa * (l_quantity - ma) + wb * (l_discount - mb) AS y FROM lineitem, w)
    SELECT l_orderkey, l_linenumber, l_extendedprice, round(y, 3) AS l_extendedprice_hat, round(l_extendedprice - y, 3) AS l_extendedprice_residual FROM h""",
)
def price_residuals(spark, folder):
    """Ridge regression, the same as the normal equations of standardised columns give it."""
    lines = read_table(spark, folder, "lineitem")
    features = ["l_quantity", "l_discount"]
    fitted = models.fit_regressors(lines, ["l_extendedprice"], features, "ridge", regParam=0.1)
    scored = models.residuals(lines, fitted, features)
    rounded = [F.round(c, 3).alias(c) for c in ("l_extendedprice_hat", "l_extendedprice_residual")]
    return scored.select("l_orderkey", "l_linenumber", "l_extendedprice", *rounded)


@register("M11 M22")
def vector_label_importances(spark, folder):
    """Softmax weights of the embedding coordinates for the vector labels."""
    vectors = read_table(spark, folder, "embeddings")
    size = 64
    columns = [f"v{i}" for i in range(size)]
    rows = vectors.select(
        F.col("label").cast("string").alias("label"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)]
    ).dropna()
    return models.fit_classifier(rows, "label", columns, (), models.softmax(maxIter=10)).importances(spark)
