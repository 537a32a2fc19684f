"""Runs: configuration, sinks, command line, and the queries over the driver's tables."""
