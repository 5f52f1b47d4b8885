"""The catalog of named queries."""

from tradeglass.catalog import findings, functions, history, linkage, oracle, quality, rules  # noqa: F401  (registration)
from tradeglass.catalog import components, references  # noqa: F401  (registration)
from tradeglass.catalog.binding import Bound
from tradeglass.catalog.registry import ORACLES, QUERIES, oracle_text

__all__ = ["ORACLES", "QUERIES", "Bound", "oracle_text"]
