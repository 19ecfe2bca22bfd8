"""Registered queries over the logical tables; importing a module registers its queries."""

from cinderloom.plans import catalog_and_events, details, learning_and_operations, recall_and_rank, records, serving_chain  # noqa: F401
from cinderloom.plans.registry import QUERIES, SQL  # noqa: F401
