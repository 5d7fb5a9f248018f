from .evaluation import auc, auc_by_group, auc_evaluator, confusion, join_truth, regression_metrics
from .filters import FilterSpec, apply_filters, drop_outliers, predicate
from .kpis import default_rate, portfolio_kpis
from .profile import (
    bounds,
    box_stats,
    counts,
    describe_numeric,
    describe_text,
    distinct_values,
    histogram,
    level_counts,
    schema_report,
    summary_quartiles,
)
from .quantiles import exact_quantiles
from .sampling import (
    first_rows,
    is_train,
    sample_n,
    split,
    stratified_split,
    with_folds,
    with_key,
    with_stratified_split,
)
from .sketches import merge_profiles, profile_parts, store_profiles, stored_profiles
from .trees import forest_probabilities, grow, walk
from .validation import (
    check_columns,
    is_compatible,
    label_frame,
    nonnumeric_counts,
    unknown_categories,
    validate,
)

__all__ = [
    "FilterSpec", "apply_filters", "auc", "auc_by_group", "auc_evaluator", "bounds", "box_stats", "check_columns", "confusion",
    "counts", "default_rate", "describe_numeric", "describe_text", "distinct_values", "drop_outliers", "exact_quantiles",
    "first_rows", "forest_probabilities", "grow", "histogram", "is_compatible", "is_train", "join_truth", "label_frame", "level_counts",
    "merge_profiles", "nonnumeric_counts", "portfolio_kpis", "predicate", "profile_parts", "regression_metrics", "sample_n", "schema_report", "split",
    "store_profiles", "stored_profiles", "stratified_split", "summary_quartiles", "unknown_categories", "validate", "walk",
    "with_folds", "with_key", "with_stratified_split",
]
