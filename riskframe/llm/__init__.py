"""Operators and pipeline for preparing large text corpora."""

from riskframe.llm.queries import ORACLES, QUERIES  # noqa: F401
