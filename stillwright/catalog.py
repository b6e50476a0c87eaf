"""The registered queries and the SQL that each is checked against."""

from __future__ import annotations

from stillwright.plans import frames, identities, scans, texts  # noqa: F401  they enter their queries
from stillwright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
