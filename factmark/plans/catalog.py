"""All registered queries: importing a module registers what it defines."""
from . import (  # noqa: F401
    cost_queries, fact_queries, price_queries, search_queries, source_queries)
from .registry import ORACLES, QUERIES  # noqa: F401
