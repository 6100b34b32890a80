"""Loads every query module and exposes the registry."""

from crossgrid.plans import accuracy, composite, importance, inference, keys, spatial, streaming, vectors  # noqa: F401
from crossgrid.plans.registry import ORACLES, QUERIES  # noqa: F401
