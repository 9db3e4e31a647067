"""The registered queries over the driver tables, and their SQL twins."""

from ledgerloom.catalog import (  # noqa: F401  (importing registers the queries)
    column_queries,
    feature_queries,
    impute_queries,
    model_queries,
    profile_queries,
    score_queries,
)
from ledgerloom.catalog.registry import REGISTRY

__all__ = ["REGISTRY"]
