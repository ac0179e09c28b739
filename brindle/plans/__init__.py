"""Query plans by subject; importing this package registers them all."""

from . import documents, evaluate, relational, search  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
