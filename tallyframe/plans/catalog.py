"""All registered queries."""

from __future__ import annotations

from tallyframe.plans import q_bootstrap, q_compare, q_counting, q_frames, q_io, q_metrics, q_pool, q_runs, q_sources, q_text  # noqa: F401
from tallyframe.plans.registry import QUERIES, oracle_text

__all__ = ["QUERIES", "oracle_text"]
