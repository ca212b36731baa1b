"""Imports every query module, so that all queries are registered."""

from plumbline.plans import browsing, chain, comparing, extracting, reporting, selecting  # noqa: F401
from plumbline.plans.registry import ORACLE, QUERIES  # noqa: F401
