"""One query for each operator over the sales tables, and SQL that gives the same rows."""

from __future__ import annotations

from . import oracles
from .spark import QUERIES

ORACLES = oracles.ORACLES
