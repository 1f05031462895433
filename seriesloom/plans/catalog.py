"""Imports every query module, so that the registry is complete."""

from seriesloom.plans import audit_queries, detector_queries, feature_queries, forecast_queries, panel_queries, rule_queries, serving_queries, session_queries, threshold_queries  # noqa: F401
from seriesloom.plans.registry import ORACLES, QUERIES  # noqa: F401
