"""Registered queries, one module per operator family."""

from . import aggregate_queries, cohort_queries, feature_queries, inference_queries, metrics_queries, model_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
