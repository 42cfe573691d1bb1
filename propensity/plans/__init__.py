"""Feature sets, training, tuning and evaluation."""

from propensity.plans.evaluation import compare_models, leaderboard, model_metrics, with_score
from propensity.plans.features import (
    FEATURE_SETS,
    feature_names,
    feature_stages,
    needed_columns,
    scaled_features,
)
from propensity.plans.forests import KeyedForest, poisson_draw, prefix_areas
from propensity.plans.learners import (
    coefficient_table,
    gradient_boosted_trees,
    logistic_regression,
    random_forest,
)
from propensity.plans.paths import Penalty, fit_paths, linear_areas
from propensity.plans.training import (
    PreparedData,
    compare_learners,
    fit_learners,
    fit_out_of_fold,
    prepare,
    training_pipeline,
)
from propensity.plans.tuning import (
    TrainingPipeline,
    cross_validate,
    full_logistic_grid,
    search_logistic_grid,
    search_table,
)

__all__ = [
    "FEATURE_SETS",
    "KeyedForest",
    "Penalty",
    "PreparedData",
    "TrainingPipeline",
    "coefficient_table",
    "compare_learners",
    "compare_models",
    "cross_validate",
    "feature_names",
    "feature_stages",
    "fit_learners",
    "fit_out_of_fold",
    "fit_paths",
    "full_logistic_grid",
    "gradient_boosted_trees",
    "leaderboard",
    "linear_areas",
    "logistic_regression",
    "model_metrics",
    "needed_columns",
    "poisson_draw",
    "prefix_areas",
    "prepare",
    "random_forest",
    "scaled_features",
    "search_logistic_grid",
    "search_table",
    "training_pipeline",
    "with_score",
]
