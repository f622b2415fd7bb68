"""Registered queries over the driver tables, each with its SQL twin where one exists."""

from clueweave.plans import (  # noqa: F401  (importing registers the queries)
    graph_plans,
    grid_plans,
    layout_plans,
    ml_plans,
    page_plans,
    search_plans,
    source_plans,
    taxonomy_plans,
    text_plans,
)
from clueweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
