"""Imports the modules that register queries."""

from hazeloom.plans import aggregates, calibrate, composed, files_and_streams, joins, scalars, series, stats  # noqa: F401
