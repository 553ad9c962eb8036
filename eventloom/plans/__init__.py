"""Registered queries of the event operators and the SQL that each must equal."""

from __future__ import annotations

from . import behaviour, structure
from .common import Query

QUERIES: dict[str, Query] = structure.QUERIES | behaviour.QUERIES
ORACLES: dict[str, str] = structure.ORACLES | behaviour.ORACLES
