"""All registered queries; importing the modules registers them."""

from . import fields, groups, models, searches, storage  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
