"""Hold-out studies of one wave: calibrated trees, the nested net ladder, comparisons."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.codes import (
    FIXED_SPEC_TARGET,
    FULL9,
    LADDER,
    LADDER4,
    LADDER5_HIDDEN,
    MIN_FEATURES,
    NET_THRESHOLD,
)
from tidegauge.functions.rates import rate_columns
from tidegauge.functions.recode import age_band_a
from tidegauge.operators import boosting, calibrate, learners, nets, sampling, scorecard
from tidegauge.operators.cells import WEIGHT, analytic, compress
from tidegauge.operators.prep import usable_features
from tidegauge.operators.ranking import best_f1, best_f1_from_counts, metrics_from_counts, score_counts
from tidegauge.operators.thresholds import nearest_specificity
from tidegauge.plans.guards import estimable
from tidegauge.session import attach, cut_lineage, small_table

DEMOGRAPHICS = ("male", "age", "veteran", "lgbtq", "income", "education", "married")
Z_LIMIT = 1.96


@dataclass
class Parts:
    """Split rows of one wave, kept in the shared folder: every fit of a study reads them."""

    rows: DataFrame

    @property
    def train(self) -> DataFrame:
        return self.rows.filter(~F.col("is_test"))

    @property
    def test(self) -> DataFrame:
        return self.rows.filter("is_test")

    def train_cells(self, features: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
        return compress(self.train, [*extra, *features, "y"])

    def test_cells(self, features: Sequence[str]) -> DataFrame:
        return compress(self.test, [*features, "y"])


def split(
    clean: DataFrame, wave: int | None, columns: Sequence[str], seed: int = 42,
    employed_only: bool = True, with_folds: bool = False,
) -> Parts:
    rows = analytic(clean, employed_only=employed_only)
    if wave is not None:
        rows = rows.filter(F.col("wave") == wave)
    columns = list(dict.fromkeys(columns))
    rows = sampling.holdout(rows.select("row_id", "wave", "y", *columns), "row_id", ["wave", "y"], seed)
    if with_folds:
        rows = sampling.folds(rows, "row_id", ["wave", "is_test", "y"], seed=seed)
    return Parts(cut_lineage(rows))


def trees(rounds: int) -> Callable[[DataFrame, Sequence[str]], boosting.OneGroup]:
    return lambda cells, features: boosting.fit_one(cells, features, rounds=rounds)


def test_metrics(
    model, train: DataFrame, test: DataFrame, weight: str | None, threshold: float | None = None
) -> DataFrame:
    """AUC, sensitivity and specificity on the test part; max-F1 threshold of the training part
    unless one is given."""
    if threshold is None:
        seen = cut_lineage(score_counts(model.score(train), "score", "y", weight=weight))
        threshold = best_f1_from_counts(seen).first()["thr"]
    counts = score_counts(model.score(test), "score", "y", weight=weight)
    rates = rate_columns("null")
    return metrics_from_counts(counts, F.lit(float(threshold))).select(
        "auc", rates["sens"].alias("sensitivity"), rates["spec"].alias("specificity"),
        "n_positive", "n_total", F.lit(float(threshold)).alias("threshold"),
    )


def within_waves(
    clean: DataFrame, features: Sequence[str], waves: Sequence[int] | None = None, rounds: int = 150, seed: int = 42
) -> DataFrame:
    """Calibrated trees on 70 % of every estimable wave: hold-out metrics and cross-validated AUC.

    All waves and folds are one grouped fit. (wave, auc, sensitivity, specificity, n_positive,
    n_total, threshold, cv_mean, cv_sd); the threshold is the training part's max-F1 one.
    """
    rows = clean if waves is None else clean.filter(F.col("wave").isin(list(waves)))
    features = usable_features(rows, features)
    rows = split(rows, None, features, seed, with_folds=True).rows
    cells = cut_lineage(compress(rows, ["wave", "is_test", "fold", *features, "y"]))
    fit_on = estimable(cells.filter(~F.col("is_test")), features, weight=WEIGHT).filter("estimable").select("wave").collect()
    cells = cells.filter(F.col("wave").isin([r["wave"] for r in fit_on]))  # one row per wave
    train = cells.filter(~F.col("is_test"))
    model = calibrate.fit_calibrated_by(train, features, ["wave"], rounds=rounds)
    counts = cut_lineage(score_counts(model.score(cells), "score", "y", ["wave", "is_test"], WEIGHT))
    best = best_f1_from_counts(counts.filter(~F.col("is_test")).drop("is_test"), ["wave"]).select("wave", F.col("thr").alias("threshold"))
    marked = attach(counts.filter("is_test").drop("is_test"), small_table(best), ["wave"])
    rates = rate_columns("null")
    metrics = metrics_from_counts(marked, F.col("threshold"), ["wave"]).select(
        "wave", "auc", rates["sens"].alias("sensitivity"), rates["spec"].alias("specificity"), "n_positive", "n_total"
    )
    cv = model.fold_auc(train).groupBy("wave").agg(F.avg("auc").alias("cv_mean"), F.stddev_pop("auc").alias("cv_sd"))
    return attach(attach(metrics, small_table(best), ["wave"]), small_table(cv), ["wave"])


def within_wave_scorecard(clean: DataFrame, features: Sequence[str], seed: int = 42) -> DataFrame:
    """Hold-out metrics of every wave at once, with the scorecard as learner."""
    parts = split(clean, None, features, seed)
    cells = cut_lineage(compress(parts.rows, ["wave", "is_test", *features, "y"]))
    model = small_table(
        scorecard.fit(cells.filter(~F.col("is_test")), features, by=["wave"], weight=WEIGHT)
    )
    scored = scorecard.score(cells, model, features, ["wave"])
    best = best_f1(scored.filter(~F.col("is_test")), "score", "y", ["wave"], WEIGHT)
    counts = score_counts(scored.filter("is_test"), "score", "y", ["wave"], WEIGHT)
    marked = attach(counts, small_table(best.select("wave", "thr")), ["wave"])
    rates = rate_columns("null")
    return metrics_from_counts(marked, F.col("thr"), ["wave"]).select(
        "wave", "auc", rates["sens"].alias("sensitivity"), rates["spec"].alias("specificity"),
        "n_positive", "n_total",
    )


def ladder(
    clean: DataFrame, wave: int, rounds: int = 500, seed: int = 42, parts: Parts | None = None
) -> DataFrame:
    """Nested nets at the fixed threshold; the fifth uses the terms with |z| > 1.96."""
    parts = parts or split(clean, wave, LADDER4, seed)
    usable = set(usable_features(parts.rows, LADDER4))
    configs = {
        name: ([f for f in feats if f in usable], hidden) for name, (feats, hidden) in LADDER.items()
    }
    z = learners.wald_table(compress(parts.rows, [*configs["Model_4_Psych"][0], "y"]), configs["Model_4_Psych"][0])
    picked = [t for t, _, _, zv in z if t != "intercept" and abs(zv) > Z_LIMIT]
    configs["Model_5_Optimized"] = (picked, LADDER5_HIDDEN)
    configs = {k: v for k, v in configs.items() if len(v[0]) >= MIN_FEATURES}
    columns = list(dict.fromkeys(f for feats, _ in configs.values() for f in feats))
    shapes = {name: nets.Shape(tuple(feats), hidden) for name, (feats, hidden) in configs.items()}
    models = nets.fit_nets(parts.train_cells(columns), shapes, rounds=rounds, seed=seed)
    test, out = cut_lineage(parts.test_cells(columns)), None
    for (_, name), model in models.nets.items():
        row = test_metrics(model, test, test, WEIGHT, NET_THRESHOLD).select(
            F.lit(name).alias("model"),
            F.lit(",".join(model.features)).alias("features"),
            "auc", "sensitivity", "specificity", "threshold",
        )
        out = row if out is None else out.unionByName(row)
    return out


def compare_with_trees(
    clean: DataFrame, wave: int, net_rounds: int = 500, tree_rounds: int = 150, seed: int = 42
) -> DataFrame:
    """The ladder next to boosted trees at their max-F1 threshold, on one split."""
    parts = split(clean, wave, [*LADDER4, *FULL9], seed)
    features = usable_features(parts.rows, FULL9)
    cells = parts.train_cells(features)
    model = trees(tree_rounds)(cells, features)
    row = test_metrics(model, cells, parts.test_cells(features), WEIGHT).select(
        F.lit("Boosted_Trees").alias("model"), F.lit(",".join(features)).alias("features"),
        "auc", "sensitivity", "specificity", "threshold",
    )
    return ladder(clean, wave, net_rounds, seed, parts).unionByName(row)


def both_predictions(
    clean: DataFrame, wave: int, net_rounds: int = 500, tree_rounds: int = 150, seed: int = 42
) -> DataFrame:
    """Hold-out scores of both models with demographics, aligned by row id."""
    columns = dict.fromkeys([*FULL9, *LADDER4, *DEMOGRAPHICS])
    parts = split(clean, wave, columns, seed, with_folds=True)
    tree_feats = usable_features(parts.rows, FULL9)
    net_feats = usable_features(parts.rows, LADDER4)
    cells = cut_lineage(parts.train_cells(tree_feats, ["wave", "fold"]))
    forest = calibrate.fit_calibrated_by(cells, tree_feats, ["wave"], rounds=tree_rounds)
    net = nets.fit_one(parts.train_cells(net_feats), net_feats, LADDER["Model_4_Psych"][1], rounds=net_rounds, seed=seed)
    scored = net.score(forest.score(parts.test, "p_trees"), "p_net")
    return scored.select(
        "row_id", *DEMOGRAPHICS, age_band_a(F.col("age")).alias("age_band"), "y", "p_trees", "p_net"
    )


def at_fixed_specificity(
    clean: DataFrame, wave: int, target: float = FIXED_SPEC_TARGET, net_rounds: int = 500,
    tree_rounds: int = 150, seed: int = 42,
) -> DataFrame:
    """Trees and net on the same features, each at the grid threshold nearest the target."""
    parts = split(clean, wave, LADDER4, seed)
    features = usable_features(parts.rows, LADDER4)
    forest = trees(tree_rounds)(parts.train_cells(features), features)
    net = nets.fit_one(parts.train_cells(features), features, LADDER["Model_4_Psych"][1], rounds=net_rounds, seed=seed)
    scored = net.score(forest.score(parts.test, "p_trees"), "p_net")
    long = scored.select(
        "y", F.expr("stack(2, 'trees', p_trees, 'net', p_net) as (model, score)")
    )
    points = nearest_specificity(long, "score", "y", target, by=["model"])
    from tidegauge.operators.ranking import auc

    return attach(points, auc(long, "score", "y", ["model"]).select("model", "auc"), ["model"])
