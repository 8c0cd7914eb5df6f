"""gridpulse: geotagged complaint rollups and serving queries on Spark."""

__version__ = "0.1.0"
