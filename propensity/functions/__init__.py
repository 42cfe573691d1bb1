"""Column expressions."""

from propensity.functions.dates import cyclical, date_part, days_between
from propensity.functions.keyhash import hash_bucket, key_hash
from propensity.functions.literals import literal_map
from propensity.functions.scoring import linear_score
from propensity.functions.vectors import vector_elements

__all__ = [
    "cyclical",
    "date_part",
    "days_between",
    "hash_bucket",
    "key_hash",
    "linear_score",
    "literal_map",
    "vector_elements",
]
