"""Registered queries: each area module pairs Spark plans with equivalent SQL."""

from panelcast.plans import alignment, backtests, checks, curated, decisions, features, pooling, profiling, reshaping, screens, uncertainty  # noqa: F401
from panelcast.plans.registry import ORACLE, QUERIES  # noqa: F401
