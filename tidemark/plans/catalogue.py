"""All registered queries."""

from . import data_queries, model_queries  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
