"""Registered queries; importing the package registers them all."""

from . import choosing, facts, more, periods, selection, storing, strategies, streams, testing, transforms, weighting  # noqa: F401
