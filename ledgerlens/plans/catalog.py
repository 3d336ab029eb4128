"""All registered queries."""

from ledgerlens.plans import (  # noqa: F401
    queries_derive, queries_models, queries_order, queries_profiles, queries_rings, queries_sources,
    queries_streaming,
)
from ledgerlens.plans.registry import QUERIES, SQL  # noqa: F401
