"""Every query of the telemetry engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import fleet, governance, joins, logs, paths, placement, reviews, search, sets, streams, windows
from .base import ORACLES, QUERIES

__all__ = ["MODULES", "ORACLES", "QUERIES"]
MODULES = (fleet, governance, joins, logs, paths, placement, reviews, search, sets, streams, windows)
