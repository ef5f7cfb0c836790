"""Registered queries and their SQL oracles."""

from barwright.catalog.base import QUERIES, SQL, Tables  # noqa: F401
from barwright.catalog import q_sessions, q_factors, q_features, q_evaluate, q_select, q_models  # noqa: F401
