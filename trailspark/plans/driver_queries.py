"""Registered queries over the driver's tables, and the SQL that each must agree with."""

from __future__ import annotations

from trailspark.plans import q_aggregates, q_finder, q_functions, q_graph, q_jobs, q_maintenance, q_planning, q_spatial, q_streaming  # noqa: F401  they register their queries
from trailspark.plans.bindings import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
