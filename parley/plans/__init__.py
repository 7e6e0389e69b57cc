"""Registered queries over the given tables."""

from parley.plans import analytics, archive, dialogue, draws, events, gold, packets, paging, phrases, profiled, relations, rules, semantics, threads
from parley.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analytics", "archive", "dialogue", "draws", "events", "gold", "packets", "paging", "phrases", "profiled", "relations", "rules", "semantics", "threads"]
