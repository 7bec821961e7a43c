"""Every query by name, and its SQL."""

from __future__ import annotations

from quillon.plans import audits, batches, decisions, facts, feeds, ledger, lifecycle, matches, runs, sources, streams
from quillon.plans.catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "audits", "batches", "decisions", "facts", "feeds", "ledger", "lifecycle", "matches", "runs", "sources", "streams"]
