"""All registered queries of the core engine with their oracle SQL, gathered from the plan modules."""

from plumbline.plans import attribution, cohort, detectors, evaluation, experiments, labels, ranking, replication, textual, vectors  # noqa: F401
from plumbline.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
