"""Registered queries."""

from riskframe.plans import basic, features, learn, rebalance, scores  # noqa: F401
from riskframe.plans.registry import ORACLES, QUERIES  # noqa: F401
