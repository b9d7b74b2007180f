"""All registered queries."""

from cohortloom.plans import (  # noqa: F401
    cohort_queries, matrix_queries, model_queries, release_queries, result_queries, source_queries, split_queries,
    tangent_queries,
)
from cohortloom.plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
