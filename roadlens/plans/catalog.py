"""All registered queries."""

from . import corridor_queries, detect_queries, forecast_queries, grid_queries, rider_queries, table_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
