"""Registered queries over the driver's tables, each with its SQL twin where SQL can express it."""

from tallyspark.plans import attendance, joins, panels, sequences, sourced, streams, tallies, texts

MODULES = (attendance, tallies, sequences, texts, joins, panels, sourced, streams)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
