"""DataFrame operators and custom ML stages."""

from propensity.operators.binning import QuantileBins, quantile_edges
from propensity.operators.cleaning import (
    cast_to_double,
    columns_of_type,
    drop_null_labels,
    drop_sparse_columns,
    drop_sparse_rows,
    rename_columns,
    skip_invalid_rows,
)
from propensity.operators.curves import curve_areas
from propensity.operators.cyclical_dates import CyclicalDateTransformer
from propensity.operators.indexing import FrequencyIndexer, FrequencyIndexerModel, frequency_ranks
from propensity.operators.lookup import join_lookup, map_values
from propensity.operators.metrics import (
    area_of_scores,
    area_under_roc,
    binary_metrics,
    confusion_matrix,
    per_class_metrics,
    score_counts,
    weighted_metrics,
)
from propensity.operators.profiling import class_balance, missing_report, row_count
from propensity.operators.splitting import (
    random_split,
    sample_rows,
    split_sizes,
    train_test_split,
    with_fold,
    with_split,
)
from propensity.operators.target_encoding import (
    AutoTargetEncoder,
    AutoTargetEncoderModel,
    out_of_fold_encode,
)
from propensity.operators.weighting import balanced_weights, with_balanced_weights, with_class_weights

__all__ = [
    "AutoTargetEncoder",
    "AutoTargetEncoderModel",
    "CyclicalDateTransformer",
    "FrequencyIndexer",
    "FrequencyIndexerModel",
    "QuantileBins",
    "area_of_scores",
    "area_under_roc",
    "balanced_weights",
    "binary_metrics",
    "cast_to_double",
    "class_balance",
    "columns_of_type",
    "confusion_matrix",
    "curve_areas",
    "drop_null_labels",
    "drop_sparse_columns",
    "drop_sparse_rows",
    "frequency_ranks",
    "join_lookup",
    "map_values",
    "missing_report",
    "out_of_fold_encode",
    "per_class_metrics",
    "quantile_edges",
    "random_split",
    "rename_columns",
    "row_count",
    "sample_rows",
    "score_counts",
    "skip_invalid_rows",
    "split_sizes",
    "train_test_split",
    "weighted_metrics",
    "with_balanced_weights",
    "with_class_weights",
    "with_fold",
    "with_split",
]
