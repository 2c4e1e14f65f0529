"""Registered queries over the driver's tables, and the SQL that gives the same rows.

Doubles are rounded to six places on both sides, since engines add in different orders.
"""

from . import gait, history, metrics, runs, tables, who  # noqa: F401  each registers its queries
from .registry import ORACLES, QUERIES  # noqa: F401
