"""Feature sets, learners, saved pipelines and searches."""

import json
import re

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from propensity.appointments import appointments
from propensity.functions import linear_score
from propensity.operators import with_balanced_weights
from propensity.plans import (
    coefficient_table,
    compare_learners,
    cross_validate,
    feature_names,
    feature_stages,
    fit_out_of_fold,
    full_logistic_grid,
    gradient_boosted_trees,
    leaderboard,
    logistic_regression,
    model_metrics,
    prepare,
    random_forest,
    search_table,
    training_pipeline,
)
from propensity.schema import BASE_COLUMNS, LABEL
from propensity.session import scratch_path
from propensity.sources import load_pipeline, save_pipeline

SIGNAL_TABLES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def data(spark, tables):
    return prepare(appointments(spark, tables))


@pytest.fixture(scope="module")
def larger(spark):
    return prepare(appointments(spark, SIGNAL_TABLES))


def auc_of(predictions):
    return model_metrics(predictions, "m").filter("metric = 'auc'").first()["value"]


@pytest.mark.parametrize("feature_set, width", [("base8", 8), ("backup17", 20), ("full", 21)])
def test_feature_sets(data, feature_set, width):
    # the one-hot vector of five genders has four elements
    model = training_pipeline(logistic_regression(max_iter=1), feature_set).fit(data.train)
    scored = model.transform(data.test)
    names = feature_names(scored)
    assert len(names) == width == model.stages[-1].numFeatures
    assert names[:8] == BASE_COLUMNS
    assert ("neighborhood_te" in names) == (feature_set == "full")
    assert scored.filter("gender is null or age is null").isEmpty()
    with pytest.raises(ValueError):
        feature_stages("everything")


def test_only_the_training_side_is_weighted(data):
    assert "weight_col" in data.train.columns and "weight_col" not in data.test.columns
    assert data.train.filter(F.col(LABEL).isNull()).isEmpty()


def test_scaler_learns_from_training_rows_only(data):
    stages = feature_stages("base8", scale=True)
    model = training_pipeline(logistic_regression(max_iter=1, features="scaled_features"), "base8", scale=True)
    fitted = model.fit(data.train)
    scaled = fitted.transform(data.train).select(F.explode(vector_to_array("scaled_features")).alias("x"))
    assert scaled.select(F.min("x"), F.max("x")).first() == (0.0, 1.0)
    scaler = fitted.stages[len(stages) - 1]
    assert scaler.originalMax[0] == data.train.filter("gender is not null").select(F.max("age")).first()[0]


def test_predictions_do_not_depend_on_layout(data):
    def scores(n):
        model = training_pipeline(logistic_regression()).fit(data.train.repartition(n))
        rows = model.transform(data.test).select(
            "appointment_id", vector_to_array("probability")[1].alias("p"), "prediction"
        )
        return {row[0]: row[1:] for row in rows.collect()}

    one, seven = scores(1), scores(7)
    assert one.keys() == seven.keys()
    for key, (probability, prediction) in one.items():
        assert probability == pytest.approx(seven[key][0], abs=1e-8) and prediction == seven[key][1]


def test_converged_regression_is_stationary(spark, larger):
    """The gradient of the weighted loss plus the penalty on standardized coefficients vanishes."""
    strength = 0.1
    learner = logistic_regression(reg_param=strength, max_iter=200).setTol(1e-10)
    train = larger.train
    model = training_pipeline(learner, "base8").fit(train)
    fitted = model.stages[-1]
    rows = VectorAssembler(inputCols=BASE_COLUMNS, outputCol="x", handleInvalid="skip").transform(
        train.filter("gender is not null")
    )
    table = np.array(rows.select(*BASE_COLUMNS, LABEL, "weight_col").collect(), dtype=float)
    x, y, w = table[:, :8], table[:, 8], table[:, 9]
    beta = fitted.coefficients.toArray()
    error = w * (1 / (1 + np.exp(-(x @ beta + fitted.intercept))) - y)
    mean = np.average(x, axis=0, weights=w)
    variance = ((w[:, None] * (x - mean) ** 2).sum(axis=0)) / (w.sum() - (w**2).sum() / w.sum())
    gradient = (x * error[:, None]).sum(axis=0) / w.sum() + strength * beta * variance
    scale = np.sqrt(variance)
    assert np.abs(gradient / scale).max() < 1e-4
    assert abs(error.sum() / w.sum()) < 1e-6
    effects = dict(zip(BASE_COLUMNS, beta))
    assert effects["date_diff"] < 0 < effects["sms_received"]


def test_scoring_equals_the_linear_score_of_the_coefficients(spark, data):
    model = training_pipeline(logistic_regression(), "base8").fit(data.train)
    scored = model.transform(data.test)
    table = {r["feature"]: r["coefficient"] for r in coefficient_table(spark, model, feature_names(scored)).collect()}
    intercept = table.pop("(intercept)")
    ours = linear_score(table, intercept)
    gap = F.abs(ours["probability"] - vector_to_array("probability")[1])
    assert scored.filter((gap > 1e-12) | (ours["prediction"] != F.col("prediction"))).isEmpty()


@pytest.mark.parametrize(
    "learner", [logistic_regression, random_forest, gradient_boosted_trees], ids=lambda make: make.__name__
)
def test_learners_find_the_planted_signal(larger, learner):
    model = training_pipeline(learner()).fit(larger.train)
    assert auc_of(model.transform(larger.test)) > 0.58


def test_unregularized_and_unweighted_variants(data):
    free = training_pipeline(logistic_regression(reg_param=0.0), "backup17").fit(data.train)
    held = training_pipeline(logistic_regression(reg_param=0.1), "backup17").fit(data.train)
    norm = lambda model: np.linalg.norm(model.stages[-1].coefficients.toArray())
    assert norm(free) > norm(held)
    plain = training_pipeline(logistic_regression(weight=None), "backup17").fit(data.train)
    missed = lambda model: model.transform(data.test).filter("prediction = 0").count()
    assert missed(held) > missed(plain)


def test_balanced_weights_train(spark, tables):
    balanced = prepare(appointments(spark, tables), weights="balanced").train
    sums = [r["w"] for r in balanced.groupBy(LABEL).agg(F.sum("weight_col").alias("w")).collect()]
    assert sums[0] == pytest.approx(sums[1])
    lazily = with_balanced_weights(balanced.drop("weight_col"), LABEL)
    assert lazily.select(*balanced.columns).exceptAll(balanced).isEmpty()
    with pytest.raises(ValueError):
        prepare(appointments(spark, tables), weights="none")


def test_loaded_pipeline_takes_raw_columns(spark, data):
    model = training_pipeline(logistic_regression(), scale=True).fit(data.train)
    path = scratch_path(spark, "pipeline")
    save_pipeline(model, path)
    save_pipeline(model, path)
    loaded = load_pipeline(path)
    with pytest.raises(ValueError, match="another path"):
        save_pipeline(loaded, path)
    fields = ["appointment_id", "rawPrediction", "prediction"]
    assert model.transform(data.test).select(fields).collect() == loaded.transform(data.test).select(fields).collect()


def test_leaderboard_ranks_by_area(data):
    good = training_pipeline(logistic_regression(), "base8").fit(data.train).transform(data.test)
    bad = good.withColumn(LABEL, 1 - F.col(LABEL))
    rows = leaderboard({"inverted": bad, "fitted": good}).collect()
    assert [row["rank"] for row in rows] == [1] * 6 + [2] * 6
    areas = [row["value"] for row in rows if row["metric"] == "auc"]
    assert areas[0] > areas[1] and sum(areas) == pytest.approx(1)
    assert {row["metric"] for row in rows} == {
        "auc", "accuracy", "f1", "weighted_precision", "weighted_recall", "recall_negative"
    }


def test_metrics_score_the_rows_once(data):
    model = training_pipeline(logistic_regression(), "base8").fit(data.train)
    metrics = model_metrics(model.transform(data.test), "m")
    metrics.collect()
    assert "ReusedExchange" in metrics._jdf.queryExecution().executedPlan().toString()


def test_metrics_shuffle_score_rows_twice(data):
    model = training_pipeline(logistic_regression(), "base8").fit(data.train)
    metrics = model_metrics(model.transform(data.test), "m")
    metrics.collect()
    final = metrics._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    exchanges = [line for line in final.splitlines() if re.search(r"[- ]Exchange ", line) and "Broadcast" not in line]
    reused = [line for line in final.splitlines() if "ReusedExchange" in line]
    wide = [line for line in exchanges if "SinglePartition" not in line]
    assert len(reused) == 1 and len(wide) <= 2 and "rangepartitioning" not in final


def test_full_grid_has_all_distinct_points(spark):
    points = full_logistic_grid(logistic_regression())
    texts = {json.dumps({p.name: v for p, v in point.items()}, sort_keys=True) for point in points}
    assert len(points) == len(texts) == 244


def test_search_fits_the_encoders_once_per_fold(data, monkeypatch):
    from propensity.operators.target_encoding import AutoTargetEncoder

    fits = []
    fit = AutoTargetEncoder._fit
    monkeypatch.setattr(AutoTargetEncoder, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    learner = logistic_regression(max_iter=5)
    grid = ParamGridBuilder().addGrid(learner.regParam, [0.1, 10.0]).build()
    model = cross_validate(training_pipeline(learner), grid, data.train, folds=2)
    assert len(fits) == 3  # two folds and the refit
    rows = search_table(data.train.sparkSession, model).collect()
    assert [row["rank"] for row in rows] == [1, 2]
    assert [row["avg_metric"] for row in rows] == sorted(model.avgMetrics, reverse=True)
    assert json.loads(rows[0]["params"])["regParam"] == model.bestModel.stages[-1].getRegParam()


def test_shared_encoders_give_the_metrics_of_separate_fits(data):
    """Each grid point's mean area equals that of a plain pipeline fitted per fold."""
    from propensity.operators import with_fold

    learner = logistic_regression(max_iter=5)
    grid = ParamGridBuilder().addGrid(learner.regParam, [0.01, 1.0]).build()
    model = cross_validate(training_pipeline(learner), grid, data.train, folds=2)
    folded = with_fold(data.train, "appointment_id", 2)
    areas = []
    for fold in range(2):
        one = training_pipeline(logistic_regression(max_iter=5, reg_param=0.01)).fit(folded.filter(F.col("fold") != fold))
        areas.append(auc_of(one.transform(folded.filter(F.col("fold") == fold))))
    assert model.avgMetrics[0] == pytest.approx(np.mean(areas), abs=1e-9)


@pytest.mark.parametrize("learner", [random_forest, gradient_boosted_trees], ids=lambda make: make.__name__)
def test_trees_do_not_depend_on_layout(larger, learner):
    """At this size Spark samples split candidates, and rows for each tree, per partition."""

    def scores(n):
        model = training_pipeline(learner(), "base8").fit(larger.train.repartition(n))
        rows = model.transform(larger.test).select("appointment_id", vector_to_array("probability")[1]).collect()
        return dict(map(tuple, rows))

    one = scores(1)
    for n in (4, 7):
        other = scores(n)
        assert one.keys() == other.keys() and len(one) > 2500
        assert max(abs(one[key] - other[key]) for key in one) < 1e-9


def test_indexer_does_not_read_through_the_encoder(data, monkeypatch):
    from pyspark.ml.feature import StringIndexer

    plans = []
    fit = StringIndexer._fit
    monkeypatch.setattr(
        StringIndexer, "_fit", lambda self, df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or fit(self, df)
    )
    training_pipeline(logistic_regression(max_iter=1)).fit(data.train)
    assert len(plans) == 1 and "Join" not in plans[0]


def test_compared_learners_share_the_encoders(data, monkeypatch):
    from propensity.operators.target_encoding import AutoTargetEncoder

    fits = []
    fit = AutoTargetEncoder._fit
    monkeypatch.setattr(AutoTargetEncoder, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    learners = {"one": logistic_regression(), "two": logistic_regression(reg_param=1.0)}
    scored = compare_learners(learners, data)
    assert len(fits) == 1
    alone = training_pipeline(logistic_regression()).fit(data.train).transform(data.test)
    assert auc_of(scored["one"]) == pytest.approx(auc_of(alone), abs=1e-9)


def test_search_leaves_no_folds_behind(spark, data):
    from pathlib import Path

    from propensity.session import shared_folder

    def tables():
        return {p.name for p in Path(shared_folder(spark).removeprefix("file:")).iterdir()}

    before = tables()
    learner = logistic_regression(max_iter=2)
    cross_validate(training_pipeline(learner), [{learner.regParam: 0.1}], data.train, folds=2)
    # the kept model reads its category counts
    assert {name.rsplit("-", 1)[0] for name in tables() - before} == {"category-counts"}


def test_out_of_fold_encoding_in_a_search(data):
    """Scores of the search are those of honest encodings: meaningless categories do not help."""
    noise = F.concat(F.lit("n"), F.pmod(F.hash("appointment_id"), F.lit(400)))
    train = data.train.withColumn("neighborhood", noise)

    def searched(**options):
        learner = logistic_regression()
        model = cross_validate(training_pipeline(learner, **options), [{learner.regParam: 0.1}], train, folds=2)
        names = feature_names(model.bestModel.transform(train))
        return model.avgMetrics[0], abs(model.bestModel.stages[-1].coefficients[names.index("neighborhood_te")])

    plain_area, plain_trust = searched()
    honest_area, honest_trust = searched(out_of_fold=3)
    assert honest_area > plain_area and honest_trust < plain_trust / 3


def test_rows_without_key_are_refused(spark, tables):
    keyless = appointments(spark, tables).withColumn(
        "appointment_id", F.when(F.col("appointment_id") % 50 > 0, F.col("appointment_id"))
    )
    with pytest.raises(ValueError, match="rows have no"):
        prepare(keyless)


def test_grid_over_a_feature_stage_falls_back_to_full_fits(data):
    pipeline = training_pipeline(logistic_regression(max_iter=2))
    encoder = pipeline.getStages()[0]
    grid = ParamGridBuilder().addGrid(encoder.smoothing, ["auto", 20.0]).build()
    model = cross_validate(pipeline, grid, data.train, folds=2)
    assert len(model.avgMetrics) == 2


def test_out_of_fold_fit_does_not_trust_meaningless_categories(spark, data):
    """Categories of two or three rows say nothing here, but a plain encoding of a row repeats its label."""
    noise = F.concat(F.lit("n"), F.pmod(F.hash("appointment_id"), F.lit(400)))
    train = data.train.withColumn("neighborhood", noise)
    test = data.test.withColumn("neighborhood", noise)

    def fitted(model):
        names = feature_names(model.transform(test))
        return model, abs(model.stages[-1].coefficients[names.index("neighborhood_te")])

    plain, plain_trust = fitted(training_pipeline(logistic_regression()).fit(train))
    honest, honest_trust = fitted(fit_out_of_fold(logistic_regression(), train))
    assert honest_trust < plain_trust / 3
    assert auc_of(plain.transform(train)) > 0.85 > auc_of(honest.transform(test))
    path = scratch_path(spark, "honest")
    save_pipeline(honest, path)
    assert load_pipeline(path).transform(test).count() == honest.transform(test).count()


def test_models_are_compared_in_one_scan_with_the_metrics_of_each(data):
    from propensity.plans import compare_models, fit_learners

    learners = {"lr": logistic_regression(), "weak": logistic_regression(reg_param=50.0), "forest": random_forest(4)}
    fitted = fit_learners(learners, data, "backup17")
    board = compare_models(fitted.models, fitted.held_out)
    rows = board.collect()
    plan = board._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") + plan.count("Scan parquet") >= 1
    one_by_one = leaderboard({name: model.transform(fitted.held_out) for name, model in fitted.models.items()}).collect()
    assert [tuple(r)[:3] for r in rows] == [tuple(r)[:3] for r in one_by_one]
    assert [r["value"] for r in rows] == pytest.approx([r["value"] for r in one_by_one], abs=1e-12)
    inputs = fitted.held_out.inputFiles()
    assert board.inputFiles() == inputs or set(board.inputFiles()) == set(inputs)
    logical = board._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("Relation [") <= 2  # counts and areas come from the same grouping, whose exchange is shared


def test_a_search_counts_and_writes_the_rows_once(data, monkeypatch):
    """One table of counts and one of rows serve all folds; the encodings of a fold are those of an encoder fitted without it."""
    from propensity.operators import AutoTargetEncoder, with_fold
    from propensity.plans import tuning

    written = []
    for name in ("stage", "stage_spread"):
        kept = getattr(tuning, name)
        monkeypatch.setattr(tuning, name, lambda df, to, *more, kept=kept, **options: written.append(to) or kept(df, to, *more, **options))
    view = tuning._fold_of
    checked = []

    def compare(pipeline, wide, fold, columns):
        folded = with_fold(data.train, "appointment_id", 3)
        encoder = AutoTargetEncoder(inputCol="neighborhood", outputCol="te", labelCol=LABEL)
        expected = encoder.fit(folded.filter(F.col("fold") != fold)).transform(folded).select("appointment_id", "te")
        gap = wide.join(expected, "appointment_id").filter(F.abs(F.get("__encodings", F.lit(fold)) - F.col("te")) > 1e-12)
        checked.append((gap.isEmpty(), wide.count() == folded.count()))
        return view(pipeline, wide, fold, columns)

    monkeypatch.setattr(tuning, "_fold_of", compare)
    learner = logistic_regression(max_iter=3)
    cross_validate(training_pipeline(learner), [{learner.regParam: 0.1}, {learner.regParam: 1.0}], data.train, folds=3)
    assert sorted(written) == ["fold-counts", "fold-rows"]
    assert checked == [(True, True)] * 3
