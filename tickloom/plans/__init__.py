"""Queries over the operators; importing this package registers them all."""

from tickloom.plans import arrivals, exchanges, feed, macro, news, reading, streams, technical, upkeep, vendors  # noqa: F401
from tickloom.plans.registry import ORACLES, QUERIES  # noqa: F401
