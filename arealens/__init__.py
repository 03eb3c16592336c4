"""Area-level price analytics on Spark: cleaning, area rollups, joins,
feature construction, predictor audits and distributed model fitting."""

__version__ = "0.1.0"
