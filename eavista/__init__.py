"""Spark-native reporting over projects stored as entity-attribute-value rows."""

from eavista.plans.registry import REPORTS, run_report
from eavista.sources.tables import Tables

__all__ = ["REPORTS", "Tables", "run_report"]
