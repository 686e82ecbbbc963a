"""All queries: importing the modules registers them."""

from . import pipelines, sources, stores  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
